"""Paired-anchor interaction tables (BEDPE and its relatives), read as text and cast by position."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six columns every file begins with.
CORE = ("chromosome_A", "start_A", "end_A", "chromosome_B", "start_B", "end_B")
#: Header names of a count column, in the order in which they are looked for.
COUNT_NAMES = ("count", "numColapsed", "petcount")


def _is_int(text: str) -> bool:
    try:
        int(text)
    except ValueError:
        return False
    return True


def sniff(lines: Sequence[str], sep: str = "\t", comment: str = "#") -> tuple[str | None, int | None]:
    """(header line or None, index of the count column or None) from the first lines of a file.

    Comment lines are passed over; the first other line is a header if its second and third fields are no integers.
    The count column is looked for by name in the very first line, be it a comment or not. So a file's very first line
    and its first line that is no comment are all that need be given.
    """
    header = None
    for line in lines:
        if line.startswith(comment):
            continue
        fields = line.split(sep)
        if len(fields) < 3:
            raise ValueError(f"a line has {len(fields)} fields; at least 3 are needed: {line[:80]!r}")
        if not (_is_int(fields[1]) and _is_int(fields[2])):
            header = line
        break
    names = lines[0].rstrip("\n").split(sep) if lines else []
    count = next((names.index(n) for n in COUNT_NAMES if n in names), None)
    return header, count


def _parts(spark: SparkSession, text: DataFrame) -> list[str]:
    """The files that a table of lines is read from, by name."""
    jvm = spark._jvm
    return sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in text.inputFiles())


def read_contacts(spark: SparkSession, path: str | list[str], *extra: tuple[int, str, str], sep: str = "\t", skiprows: int = -1, comment: str = "#", min_petcount: int = 0, chromosomes: str | Sequence[str] | None = None, intrachromosomal: bool = True, interchromosomal: bool = True, nrows: int | None = None, petcount_col: int = -1, fix_chromosome: bool = True, prefixed: bool | None = None) -> DataFrame:
    """Interactions of a file: six core columns, petcount if there is one, and extra columns (index, name, type).

    With ``skiprows`` below 0 a header is found by looking at the first lines, otherwise so many lines are passed over;
    likewise ``petcount_col`` below 0 looks for a count column by name. What follows a comment sign is cut off a line.
    If not all chromosome names begin with chr, all get that prefix; that takes a look at all rows when the result is
    computed, unless ``prefixed`` says whether they do. ``chromosomes``: one name (on either side), or
    several (on both). ``nrows`` takes the first rows of the file, before any filter. A folder is one file written in parts,
    in the order of their names; what is passed over with ``skiprows`` lies in the first one. A list of several files is read by
    the data source in ``bedpe_files``: each has a head and a prefix of its own, and gives its own first rows.
    """
    if not isinstance(path, str) and len(path) > 1:
        from weftspan.sources.bedpe_files import read_files

        options = dict(sep=sep, skiprows=skiprows, comment=comment, petcount_col=petcount_col, nrows=nrows, fix_chromosome=fix_chromosome, prefixed=prefixed)
        return read_files(spark, path, *extra, **options, min_petcount=min_petcount, chromosomes=chromosomes, intrachromosomal=intrachromosomal, interchromosomal=interchromosomal).drop("file", "place")
    taken = set(range(6)) | ({petcount_col} if petcount_col >= 0 else set())
    for i, name, _ in extra:
        if i in taken:
            raise ValueError(f"column {i} ({name}) is taken already")
        taken.add(i)
    text = spark.read.text(path)
    parts = _parts(spark, text)
    lead = spark.read.text(parts[0]) if len(parts) > 1 else text
    first = [r["value"] for r in lead.limit(max(1, skiprows)).collect()]
    if skiprows < 0:
        said = ~F.col("value").startswith(comment)
        body = lead.filter(said).first()  # however many comments come before it
        if body is None and len(parts) > 1:  # comments only, up to a later part
            body = next(filter(None, (spark.read.text(p).filter(said).first() for p in parts[1:])), None)
        header, found = sniff([*first, *([body["value"]] if body else [])], sep, comment)
    else:
        header, found = None, sniff(first[:1], sep, "\0")[1] if first and len(first[0].split(sep)) >= 3 else None
    count = petcount_col if petcount_col >= 0 else found
    placed = lambda t: t if nrows is None else t.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    lines = placed(text)
    if skiprows > 0:
        early = placed(lead).withColumn("_n", F.monotonically_increasing_id())
        lines = early.filter(~((F.col("_n") < skiprows) & F.col("value").isin(first[:skiprows]))).drop("_n")
        if len(parts) > 1:
            lines = lines.unionByName(placed(spark.read.text(parts[1:])))
    elif header is not None:
        lines = lines.filter(F.col("value") != header)
    body = F.substring_index("value", comment, 1)
    lines = lines.withColumn("value", body).filter(F.trim("value") != "")
    if nrows is not None:  # by their places: a limit takes the rows of whichever task is done first
        lines = lines.orderBy("_file", "_block", "_line").limit(nrows)
    field = F.split("value", re.escape(sep))
    kinds = ("string", "long", "long") * 2
    columns = [F.get(field, i).cast(kind).alias(n) for i, (n, kind) in enumerate(zip(CORE, kinds, strict=True))]
    if count is not None:
        columns.append(F.get(field, count).cast("long").alias("petcount"))
    columns += [F.get(field, i).cast(kind).alias(n) for i, n, kind in extra]
    rows = lines.select(*columns)
    if fix_chromosome:
        rows = with_prefix(rows, prefixed)
    return filter_contacts(rows, min_petcount, chromosomes, intrachromosomal, interchromosomal)


def with_prefix(rows: DataFrame, prefixed: bool | None = None) -> DataFrame:
    """Chromosome names with chr before them, unless all have it already; ``prefixed`` gives the answer if it is known."""
    if prefixed is None:
        every = F.bool_and(F.col("chromosome_A").startswith("chr") & F.col("chromosome_B").startswith("chr"))
        have = rows.agg(F.coalesce(every, F.lit(True))).scalar()
    else:
        have = F.lit(prefixed)
    return rows.withColumns({c: F.when(have, F.col(c)).otherwise(F.concat(F.lit("chr"), F.col(c))) for c in ("chromosome_A", "chromosome_B")})


def filter_contacts(rows: DataFrame, min_petcount: int = 0, chromosomes: str | Sequence[str] | None = None, intrachromosomal: bool = True, interchromosomal: bool = True) -> DataFrame:
    """Rows by count, by whether both anchors are on one chromosome, and by chromosome."""
    a, b = F.col("chromosome_A"), F.col("chromosome_B")
    if "petcount" in rows.columns and min_petcount >= 0:
        rows = rows.filter(F.col("petcount") >= min_petcount)
    if not intrachromosomal:
        rows = rows.filter(a != b)
    if not interchromosomal:
        rows = rows.filter(a == b)
    if isinstance(chromosomes, str):
        rows = rows.filter((a == chromosomes) | (b == chromosomes))
    elif chromosomes is not None:
        rows = rows.filter(a.isin(*chromosomes) & b.isin(*chromosomes))
    return rows
