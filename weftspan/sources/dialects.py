"""Readers and writers of stripe tables in the dialects of viewers and other callers. All are tab-separated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.chromosomes import add_prefix, chromosome_index, strip_prefix
from weftspan.functions.lineage import number_rows

VIEWER = ("chr", "pos1", "pos2", "chr2", "pos3", "pos4")


#: Where a row stands: its file, the part of it that one task reads, and its place there.
PLACE = ["_file", "_part_start", "_line"]


def _read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a file or folder of files, with their place."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]), F.monotonically_increasing_id().alias(PLACE[2]))


def _numbered(rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Rows with a running ``stripe_id`` from 0: in the order of the files, or of some columns and then that. No task
    has all rows; those of one read are numbered alike in the next."""
    return number_rows(rows.drop("stripe_id"), [*order, *PLACE], "stripe_id").drop(*PLACE)


def _in_natural_order(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"_c1": chromosome_index("chr"), "_c2": chromosome_index("chr2")})
    return _numbered(rows, ["_c1", "pos1", "pos2", "_c2", "pos3", "pos4"]).drop("_c1", "_c2").orderBy("stripe_id")


def _typed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("long") for c in ("pos1", "pos2", "pos3", "pos4")}).withColumns({c: add_prefix(c) for c in ("chr", "chr2")})


def read_viewer_positions(spark: SparkSession, path: str) -> DataFrame:
    """Viewer files as they are: positions with prefixed chromosomes, sorted and numbered; the colour goes."""
    return _in_natural_order(_typed(_read(spark, path))).drop("color")


def read_viewer_stripes(spark: SparkSession, path: str) -> DataFrame:
    """Viewer files as stripes, numbered as their rows stand: R if the far positions are nearer to the first anchor's
    start than to its end."""
    rows = _numbered(_typed(_read(spark, path)))
    right = F.abs(F.col("pos3") - F.col("pos1")) < F.abs(F.col("pos4") - F.col("pos2"))
    return rows.select(
        "stripe_id", F.col("chr").alias("chromosome"), F.when(right, "R").otherwise("L").alias("direction"), F.col("pos1").alias("anchor_start"), F.col("pos2").alias("anchor_end"),
        (F.col("pos2") - F.col("pos1")).alias("width"), F.col("pos3").alias("start"), F.col("pos4").alias("end"), (F.col("pos4") - F.col("pos3")).alias("length"),
    )


def read_third_party(spark: SparkSession, path: str) -> DataFrame:
    """Another caller's table: L if the anchor's middle lies beyond that of the far positions."""
    rows = _in_natural_order(_typed(_read(spark, path)).withColumns({c: F.col(c).cast("long") for c in ("length", "width")}))
    left = (F.col("pos2") + F.col("pos1")) - (F.col("pos4") + F.col("pos3")) > 0
    return rows.withColumn("direction", F.when(left, "L").otherwise("R"))


def viewer_rows(stripes: DataFrame, color: str = "#009900", pad_w: int = 0, pad_l: int = 0) -> DataFrame:
    """Stripes in the viewer's columns; R anchors begin one position earlier, as the viewer draws them."""
    right = F.col("direction") == "R"
    name = strip_prefix("chromosome")
    return stripes.select(
        name.alias("chr"), (F.col("anchor_start") - pad_w - F.when(right, 1).otherwise(0)).alias("pos1"), (F.col("anchor_end") + pad_w).alias("pos2"), name.alias("chr2"),
        (F.col("start") - F.when(right, pad_l).otherwise(pad_w)).alias("pos3"), (F.col("end") + F.when(right, pad_w).otherwise(pad_l)).alias("pos4"), F.lit(color).alias("color"), "stripe_id", "direction",
    )


def domain_rows(stripes: DataFrame, pad_w: int = 0, pad_l: int = 0) -> DataFrame:
    right = F.col("direction") == "R"
    return stripes.select(F.col("chromosome").alias("chr"), (F.col("start") - F.when(right, pad_l).otherwise(pad_w)).alias("start"), (F.col("end") + F.when(right, pad_w).otherwise(pad_l)).alias("end"))


def write_tsv(df: DataFrame, path: str, header: bool = True, single: bool = True) -> None:
    """Unquoted tab-separated text; in one part if ``single`` (stripe tables are small)."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep="\t", header=header, quote="", emptyValue="", nullValue="")


def save_stripes(stripes: DataFrame, path: str) -> None:
    write_tsv(stripes, path)


def save_viewer_stripes(stripes: DataFrame, path: str, **options) -> None:
    write_tsv(viewer_rows(stripes, **options), path)


def save_domains(stripes: DataFrame, path: str, **options) -> None:
    write_tsv(domain_rows(stripes, **options), path, header=False)
