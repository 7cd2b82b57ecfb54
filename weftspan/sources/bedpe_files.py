"""A Spark data source for many interaction files at once, each with a header, count column and skipped rows of its own.

    spark.dataSource.register(BedpeSource)
    spark.read.format("bedpe").option("chunk", 1 << 25).load("folder/of/files")

Files are cut into ranges of bytes that begin and end at line ends; compressed ones are one range. A partition is one range,
or several where they are many: small files are read together, and small ranges of one file as one. The task that reads a range looks at the head of its file by itself, so the driver lists files and reads none. Lines are
split and cast as Arrow columns. Paths are local or of a store that pyarrow opens (such as hdfs or s3); for stores that
only Spark's own readers can open there is ``bedpe.read_contacts`` with one path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftspan.sources.bedpe import CORE, filter_contacts, sniff

#: Bytes of a range, unless the option ``chunk`` says otherwise.
CHUNK = 1 << 25
#: Partitions that ranges are dealt to at least, if there are so many; more bytes than CHUNK are not put together.
PARTITIONS = 1 << 6
#: Bytes that opening a file counts for.
OPENING = 1 << 12
#: Files up to which what is known of each is sent to all executors.
SENT_FILES = 1 << 19
#: Endings of files that have to be read from their beginning.
WHOLE = (".gz", ".bz2", ".zst", ".lz4")
#: What a file may have of its own in the option ``own``, by its name or that of a folder that it is in.
OWN = {"skiprows", "petcount_col", "sep", "comment"}


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; ``file:/x`` and plain paths are local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    try:
        return pafs.FileSystem.from_uri(path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"this source cannot open {path}; read_contacts with one path reads it through Spark") from e


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder; names that begin with a dot or _ are left out."""
    fs, inner = open_store(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == pafs.FileType.File:
        return [(prefix + inner, info.size)]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and f.size)


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; the lines that begin in them are its rows. An end below 0 is the file's."""

    path: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads."""

    ranges: list[Range]


def together(found: Sequence[tuple[Range, int]], chunk: int) -> list[Ranges]:
    """Ranges and their sizes as partitions; neighbours in one file become one range."""
    cost = sum(size for _, size in found) + OPENING * len({r.path for r, _ in found})
    most = min(max(cost // PARTITIONS, chunk), max(CHUNK, chunk))
    out, held = [], 0
    for r, size in found:
        last = out[-1].ranges[-1] if out else None
        follows = last is not None and last.path == r.path and last.end == r.start
        held += size if follows else OPENING + size
        if last is None or held > most:
            out.append(Ranges([r]))
            held = OPENING + size
        elif follows:
            last.end = r.end
        else:
            out[-1].ranges.append(r)
    return out


class _Lines:
    """Lines of a file from a place on, with the bytes they begin at."""

    def __init__(self, path: str, start: int = 0, block: int = 1 << 20):
        fs, inner = open_store(path)
        self.file = fs.open_input_stream(inner, compression="detect") if path.endswith(WHOLE) else fs.open_input_file(inner)
        if start:
            self.file.seek(start)
        self.at, self.block, self.held = start, block, b""

    def __enter__(self) -> _Lines:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(place, bytes of whole lines), until the file ends; the last line may lack its end."""
        while more := self.file.read(self.block):
            whole = more.rfind(b"\n") + 1
            if not whole:
                self.held += more
                continue
            data, self.held, at = self.held + more[:whole], more[whole:], self.at
            self.at += len(data)
            yield at, data
        if self.held:
            yield self.at, self.held

    def lines(self) -> Iterator[tuple[int, bytes]]:
        for at, data in self.blocks():
            for line in data.splitlines(keepends=True):
                yield at, line
                at += len(line)


def head(path: str, sep: str = "\t", comment: str = "#", skiprows: int = -1, petcount_col: int = -1) -> tuple[int, int | None]:
    """(byte at which rows begin, index of the count column or None) of one file, from as few lines as it takes."""
    first, at, end = None, 0, 0
    with _Lines(path, block=1 << 16) as source:
        for i, (at, line) in enumerate(source.lines()):
            text = line.decode().rstrip("\r\n")
            first = text if first is None else first
            end = at + len(line)
            if skiprows >= 0:
                if i >= skiprows:
                    break
            elif text.strip() and not text.startswith(comment):
                header, count = sniff([first, text], sep, comment)
                return (at if header is None else end), (petcount_col if petcount_col >= 0 else count)
        else:
            at = end
    names = first if first and len(first.split(sep)) >= 3 else ""
    count = sniff([names], sep, "\0")[1] if names and skiprows >= 0 else None
    return at, (petcount_col if petcount_col >= 0 else count)


def columns(data: bytes, at: int, sep: str, comment: str, wanted: Sequence[tuple[int | None, pa.DataType]]) -> tuple[list[pa.Array], pa.Array]:
    """The wanted fields of whole lines as columns (None: a column of nulls), and the byte at which each line begins."""
    text = data.decode()
    lines = pc.list_flatten(pc.split_pattern(pa.array([text[:-1] if text.endswith("\n") else text], pa.large_string()), "\n"))
    size = pc.add(pc.binary_length(lines), 1)
    begins = pc.add(pc.subtract(pc.cumulative_sum(size), size), at)
    bare = pc.utf8_rtrim(lines, "\r")
    if comment in text:
        bare = pc.list_element(pc.split_pattern(bare, comment, max_splits=1), 0)
    kept = pc.greater(pc.utf8_length(pc.utf8_trim(bare, " ")), 0)
    bare, begins = bare.filter(kept), begins.filter(kept)
    most = max((i for i, _ in wanted if i is not None), default=0)
    padded = pc.binary_join_element_wise(bare, pa.scalar(sep * most, pa.large_string()), pa.scalar("", pa.large_string()))  # so that every line has the last field
    fields, out = pc.split_pattern(padded, sep, max_splits=most + 1), []
    for i, kind in wanted:
        if i is None:
            out.append(pa.nulls(len(bare), kind))
            continue
        value = pc.list_element(fields, i)
        blank = pc.equal(value, "")
        out.append(pc.cast(pc.if_else(blank, pa.scalar(None, pa.large_string()), value), kind))
    return out, begins


class BedpeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        given = options.get("files")
        self.paths = json.loads(given) if given else [options["path"]]
        self.own = json.loads(options.get("own", "{}"))
        self.extra = [tuple(x) for x in json.loads(options.get("extra", "[]"))]
        if unknown := {k for o in self.own.values() for k in o} - OWN:
            raise ValueError(f"unknown settings of a file: {sorted(unknown)}")

    def partitions(self) -> Sequence[Ranges]:
        chunk, found = int(self.options.get("chunk", CHUNK)), []
        for path in self.paths:
            for name, size in listed(path):
                whole = name.endswith(WHOLE) or "nrows" in self.options
                found += [(Range(name, 0, -1), size)] if whole else [(Range(name, a, min(a + chunk, size)), min(chunk, size - a)) for a in range(0, size, chunk)]
        return together(found, chunk) or [Ranges([])]

    def settings(self, path: str) -> dict:
        default = {"sep": self.options.get("sep", "\t"), "comment": self.options.get("comment", "#"), "skiprows": int(self.options.get("skiprows", -1)), "petcount_col": int(self.options.get("petcount_col", -1))}
        return default | next((self.own[part] for part in reversed(path.split("/")) if part in self.own), {})

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from self.prefixes(r) if "prefixes" in self.options else self.rows(r, to_arrow_schema(self.schema))

    def prefixes(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Of each block of lines, whether all names have the prefix; null if there are none."""
        names = pa.schema([("chromosome_A", pa.string()), ("chromosome_B", pa.string()), ("place", pa.int64()), ("file", pa.string())])
        for batch in self.rows(partition, names):
            have = pc.and_kleene(*(pc.starts_with(batch[c], "chr") for c in ("chromosome_A", "chromosome_B")))
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([pc.all(have).as_py()], pa.bool_())], schema=to_arrow_schema(self.schema))

    def rows(self, partition: Range, names: pa.Schema) -> Iterator[pa.RecordBatch]:
        own = self.settings(partition.path)
        begin, count = head(partition.path, **own)
        index = dict(zip(CORE, range(6), strict=True)) | {"petcount": count} | {name: i for i, name, _ in self.extra}
        fields = [f for f in names if f.name not in ("file", "place")]
        wanted = [(index[f.name], f.type) for f in fields]
        left = int(self.options.get("nrows", -1))
        # The line that begins before a range belongs to the range before it; so reading starts one byte earlier.
        start = max(partition.start - 1, 0) if partition.start > begin else begin
        skip = partition.start > begin
        if partition.path.endswith(WHOLE):
            start, skip = 0, False
        with _Lines(partition.path, start) as source:
            for at, data in source.blocks():
                if skip:
                    cut = data.find(b"\n") + 1
                    at, data, skip = at + cut, data[cut:], False
                if at < begin:  # of a compressed file, whose place cannot be sought
                    at, data = (begin, data[begin - at :]) if at + len(data) > begin else (at + len(data), b"")
                if 0 <= partition.end < at + len(data):
                    inside = data.rfind(b"\n", 0, max(partition.end - at, 0)) + 1 if partition.end > at else 0
                    # The line that goes on beyond the end has begun in this range.
                    if at + inside < partition.end:
                        inside = data.find(b"\n", inside) + 1 or len(data)
                    data, last = data[:inside], True
                else:
                    last = False
                if data:
                    found, places = columns(data, at, own["sep"], own["comment"], wanted)
                    made = dict(zip((f.name for f in fields), found, strict=True)) | {"place": places.cast(pa.int64()), "file": pa.array([partition.path] * len(places), pa.string())}
                    batch = pa.RecordBatch.from_arrays([made[n].cast(names.field(n).type) for n in names.names], schema=names)
                    if left >= 0:
                        batch = batch.slice(0, left)
                        left -= len(batch)
                    yield batch
                if last or left == 0 or 0 <= partition.end <= at + len(data):
                    return


class BedpeSource(DataSource):
    """Interactions of one or many files: the core columns, petcount (null in files without one), extra columns, and
    where a row comes from: ``file``, and ``place``, the byte at which its line begins.

    Options: ``files`` (a list, as JSON) or a path; ``sep``, ``comment``, ``skiprows`` and ``petcount_col`` for all
    files, ``own`` (JSON: settings by the name of a file or folder) for some; ``extra`` (JSON: [index, name, type]); ``nrows`` for
    the first rows of each file; ``chunk`` for the bytes of a range. With ``prefixes`` rows are (file, _have): whether all
    names of a block of lines begin with chr.
    """

    @classmethod
    def name(cls) -> str:
        return "bedpe"

    def schema(self) -> str:
        if "prefixes" in self.options:
            return "file string, _have boolean"
        extra = json.loads(self.options.get("extra", "[]"))
        core = [f"{c} {k}" for c, k in zip(CORE, ("string", "long", "long") * 2, strict=True)]
        return ", ".join([*core, "petcount long", *(f"`{n}` {k}" for _, n, k in extra), "file string", "place long"])

    def reader(self, schema: StructType) -> BedpeReader:
        return BedpeReader(schema, self.options)


def read_files(spark: SparkSession, paths: Sequence[str], *extra: tuple[int, str, str], own: dict[str, dict] | None = None, sep: str = "\t", skiprows: int = -1, comment: str = "#", petcount_col: int = -1, nrows: int | None = None, fix_chromosome: bool = True, prefixed: bool | None = None, chunk: int = CHUNK, min_petcount: int = 0, chromosomes: str | Sequence[str] | None = None, intrachromosomal: bool = True, interchromosomal: bool = True) -> DataFrame:
    """Interactions of many files, with ``file`` and ``place``; parameters as in ``bedpe.read_contacts``.

    Each file has its own header, count column and skipped rows (``own`` sets them by the name of a file or folder), takes its own first
    ``nrows``, and gets the prefix chr unless all of its names have it. A file without a count column has null counts,
    which ``min_petcount`` lets pass. Empty files give no rows.
    """
    taken = set(range(6)) | ({petcount_col} if petcount_col >= 0 else set())
    for i, name, _ in extra:
        if i in taken:
            raise ValueError(f"column {i} ({name}) is taken already")
        taken.add(i)
    spark.dataSource.register(BedpeSource)
    options = {"files": json.dumps(list(paths)), "extra": json.dumps(extra), "own": json.dumps(own or {}), "sep": sep, "comment": comment, "skiprows": skiprows, "petcount_col": petcount_col, "chunk": chunk}
    options |= {} if nrows is None else {"nrows": nrows}
    rows = spark.read.format("bedpe").options(**options).load()
    if fix_chromosome:
        named = ("chromosome_A", "chromosome_B")
        if prefixed is None:
            have = spark.read.format("bedpe").options(**options, prefixes=True).load().groupBy("file").agg(F.bool_and("_have").alias("_have"))
            few = sum(len(listed(p)) for p in paths) <= SENT_FILES
            rows = rows.join(F.broadcast(have) if few else have, "file")
        else:
            rows = rows.withColumn("_have", F.lit(prefixed))
        rows = rows.withColumns({c: F.when(F.col("_have"), F.col(c)).otherwise(F.concat(F.lit("chr"), F.col(c))) for c in named}).drop("_have")
    if min_petcount > 0:
        rows = rows.filter(F.col("petcount").isNull() | (F.col("petcount") >= min_petcount))
    rows = filter_contacts(rows, -1, chromosomes, intrachromosomal, interchromosomal)
    return rows.select(*CORE, "petcount", *(n for _, n, _ in extra), "file", "place")
