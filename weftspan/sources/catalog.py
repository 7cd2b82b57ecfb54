"""A catalog of files by patterns: keys are the named groups of a regular expression over their paths."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.lineage import number_rows
from weftspan.operators.joins import align

log = logging.getLogger(__name__)

#: What a null key is called in a file name.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Source:
    """Files under ``root`` whose path matches ``pattern``; ``types`` casts keys, ``defaults`` fills absent groups.

    ``encoded``: text keys stand in the path as ``split_write`` puts them there, and are decoded.
    """

    name: str
    root: str
    pattern: str
    types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    filters: tuple[Callable[[DataFrame], Column], ...] = ()
    fix: Callable[[DataFrame], DataFrame] | None = None
    action: Callable[[Column], Column] | None = None
    encoded: bool = False


class Catalog:
    """Named sources that share their key columns; several sources may have one name."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.sources: list[Source] = []

    def add(self, name: str, pattern: str, directory: str = "", root: str | None = None, anywhere: bool = True, **options) -> Catalog:
        """Register a source. With ``anywhere`` the pattern may begin in any folder, else it matches the whole path."""
        re.compile(pattern)
        at = (root or self.root).rstrip("/") + (f"/{directory.strip('/')}" if directory else "")
        self.sources.append(Source(name, at, f"^(?:.*/)?{pattern}$" if anywhere else f"^{pattern}$", **options))
        return self

    def _matched(self, s: Source, files: DataFrame) -> DataFrame:
        """(keys, path, file): those of the files (path) that belong to a source."""
        groups = re.compile(s.pattern).groupindex
        number = iter(range(1, len(groups) + 1))
        java = re.sub(r"\(\?P<\w+>", lambda _: f"(?<g{next(number)}>", s.pattern)  # names in Java have no underscores
        rows = files.filter(F.col("path").rlike(java)).withColumn("file", F.col("path"))
        for k in self.keys:
            value = F.regexp_extract("path", java, groups[k]) if k in groups else F.lit(s.defaults.get(k))
            if s.encoded and k in groups:
                value = F.when(value != NULL_NAME, F.try_url_decode(value))
            rows = rows.withColumn(k, value.cast(s.types.get(k, "string")))
        if s.fix:
            rows = s.fix(rows)
        for f in s.filters:
            rows = rows.filter(f(rows))
        if s.action:
            rows = rows.withColumn("path", s.action(F.col("path")))
        return rows.select(*self.keys, "path", "file")

    def _listed(self, s: Source) -> DataFrame:
        """Matching files. Only their names are read, by Spark's own listing."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(s.root)
        return self._matched(s, files.select(F.regexp_replace("path", "^file:/+", "/").alias("path")))

    def _named(self, name: str) -> list[Source]:
        found = [s for s in self.sources if s.name == name]
        if not found:
            raise KeyError(name)
        return found

    def keys_of(self, name: str, path: str) -> dict[str, object] | None:
        """The keys of one path, whether the file is there or not; None if it belongs to no source of that name."""
        one = self.spark.createDataFrame([(path,)], "path string")
        for s in self._named(name):
            for r in self._matched(s, one).collect():
                return {k: r[k] for k in self.keys}
        return None

    def keys_of_all(self, name: str, paths: DataFrame) -> DataFrame:
        """(path, keys) of a table of paths, whether the files are there or not; null keys where no source of that name
        has it, those of the first source where several do. Repeated paths are one; nothing is listed or read."""
        asked, out = paths.select("path").distinct(), None
        for i, s in enumerate(self._named(name)):
            found = self._matched(s, asked).select(F.col("file").alias("path"), F.struct(F.lit(i).alias("source"), *self.keys).alias("k"))
            out = found if out is None else out.unionByName(found)
        first = out.groupBy("path").agg(F.min("k").alias("k"))
        return asked.join(first, "path", "left").select("path", *(F.col(f"k.{k}").alias(k) for k in self.keys))

    def paths(self, name: str, limit_per_source: int | None = None, check_unique: bool = True) -> DataFrame:
        """(keys, path) of all sources of a name; keys that come twice, and files of several sources, are logged."""
        out = None
        for s in self._named(name):
            rows = self._listed(s)
            if limit_per_source is not None:
                rows = rows.orderBy("file").limit(limit_per_source)
            out = rows if out is None else out.unionByName(rows)
        if check_unique:
            for r in out.groupBy(*self.keys).count().filter("count > 1").limit(20).collect():
                log.warning("several files of %s have the keys %s", name, tuple(r)[:-1])
            for r in out.groupBy("file").count().filter("count > 1").limit(20).collect():
                log.warning("several sources of %s have the file %s", name, r["file"])
        return out.select(*self.keys, "path")

    def table(self, missing: str = "") -> DataFrame:
        """All sources side by side on their keys, with ``missing`` where a source has no file."""
        names = list(dict.fromkeys(s.name for s in self.sources))
        return align({n: self.paths(n) for n in names}, self.keys, missing)


def file_of() -> Column:
    """The path of the file that a row is read from, as a catalog lists it."""
    plain = F.try_url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(plain, F.input_file_name()), "^file:/+", "/")


def read_and_concat(spark: SparkSession, paths: DataFrame, keys: Sequence[str], read: Callable[[SparkSession, list[str]], DataFrame], fix: Callable[[DataFrame], DataFrame] = lambda d: d, row_number: str | None = None, alike: bool = True) -> DataFrame:
    """The files of a catalog listing by column name, each row with its file's keys; optionally numbered from 0.

    ``read`` is given all paths at once, so that they are one scan; keys are joined to its rows by file. ``fix`` sees
    the rows of all files, with their file in the column ``_file``, which it is to keep. Without ``alike``, files may
    differ in their columns: each is then read on its own, and columns that it lacks are null.
    """
    named = paths.select(*keys, F.col("path").alias("_file"))
    files = [r["_file"] for r in named.select("_file").distinct().orderBy("_file").collect()]
    if not files:
        raise ValueError("no files to read")
    rows = None
    for some in [files] if alike else [[f] for f in files]:
        part = fix(read(spark, some).withColumn("_file", file_of()))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if not row_number:
        return rows.join(named, "_file").drop("_file")
    rows = rows.withColumn("_place", F.monotonically_increasing_id()).join(named, "_file")
    return number_rows(rows, [*keys, "_file", "_place"], row_number).drop("_file", "_place")


#: Text of a value of each type, as Spark casts it. Other types are text.
_INTEGER, _DECIMAL = r"-?[0-9]+", r"-?(?:[0-9]+(?:\.[0-9]+)?(?:E-?[0-9]+)?|Infinity|NaN)"
VALUES = {"tinyint": _INTEGER, "smallint": _INTEGER, "int": _INTEGER, "bigint": _INTEGER, "float": _DECIMAL, "double": _DECIMAL, "boolean": "(?:true|false)", "date": r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}"}


def name_part(value: Column, sep: str) -> Column:
    """A key's value as a part of a file name: characters with a meaning in paths, and those of ``sep``, are encoded."""
    text = F.url_encode(value.cast("string"))
    for c in dict.fromkeys(sep):
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(text, F.lit(NULL_NAME))


def restore_pattern(kinds: dict[str, str], prefix: str, sep: str, suffix: str) -> str:
    """The pattern whose groups are the keys (name to type) of the names that ``split_write`` gives.

    It follows from the types: encoded text holds no character of the separator, and numbers are what a cast makes.
    Where a separator may occur in a number (as "-" does), names still have one reading, unless it is a digit.
    """
    text = f"[^/{''.join(map(re.escape, dict.fromkeys(sep)))}]+"
    value = {k: VALUES.get(kind, _DECIMAL if kind.startswith("decimal") else text) for k, kind in kinds.items()}
    groups = (f"(?P<{k}>{v}|{NULL_NAME})" for k, v in value.items())
    return f"{re.escape(prefix)}{re.escape(sep).join(groups)}{re.escape(suffix)}/part-[^/]*$"


def split_write(
    df: DataFrame, prefix: str, by: Sequence[str], sep: str = "_", suffix: str = "", format: str = "csv", fix: Callable[[DataFrame], DataFrame] = lambda d: d,
    write: Callable[[DataFrameWriter, str], None] | None = None, skip_empty: bool = False, **options,
) -> tuple[str, str, tuple[str, ...]]:
    """Write one table for each value of the keys, called prefix + values joined by ``sep`` + suffix.

    Returns (root folder, pattern that restores the keys from paths, types of the keys). All tables are written in one
    pass and then given their names. ``fix`` changes rows and is to keep the keys; values of which it leaves no row get
    an empty table unless ``skip_empty``. ``write`` saves a writer to a path, by default in ``format`` with ``options``.
    """
    spark, (root, _, name) = df.sparkSession, prefix.rpartition("/")
    kinds = {k: df.schema[k].dataType.simpleString() for k in by}
    called = F.concat(F.lit(name), F.concat_ws(sep, *(name_part(F.col(k), sep) for k in by)), F.lit(suffix))
    save = write or (lambda w, path: w.format(format).options(**options).save(path))
    fixed = fix(df)
    staging = f"{root or '.'}/.split-{uuid.uuid4()}"
    save(fixed.withColumn("_name", called).drop(*by).write.partitionBy("_name"), staging)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    moved = set()
    for status in fs.listStatus(path(staging)):
        folder = status.getPath().getName()
        if folder.startswith("_name="):
            target = unquote(folder.removeprefix("_name="))  # what Spark has escaped in the folder's name
            # The old table is set aside until the new one is in its place.
            place, aside = path(f"{root or '.'}/{target}"), path(f"{staging}/.old-{folder}")
            if fs.exists(place):
                fs.rename(place, aside)
            fs.rename(status.getPath(), place)
            fs.delete(aside, True)
            moved.add(target)
    fs.delete(path(staging), True)
    if not skip_empty:
        for r in df.select(called.alias("_name")).distinct().collect():  # as many as there are tables
            if r["_name"] not in moved:
                save(fixed.drop(*by).limit(0).write, f"{root or '.'}/{r['_name']}")
    return root, restore_pattern(kinds, name, sep, suffix), tuple(kinds.values())
