"""Interactions and intervals derived from the star-schema tables, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def contacts(spark: SparkSession, folder: str, oriented: bool = True) -> DataFrame:
    """Interactions from lineitem: 22 chromosomes, positions by arithmetic on the keys, lengths of 1, 3 or 5 thousand.

    Without ``oriented`` either anchor may be the first.
    """
    rows = table(spark, folder, "lineitem").selectExpr(
        "concat('chr', cast(1 + l_orderkey % 22 as string)) as chromosome_A", "(l_partkey * 7919 + l_linenumber * 131) % 4001 * 2500 as p",
        "(l_suppkey * 104729 + l_orderkey * 17) % 4001 * 2500 as q", "cast(1000 + (l_linenumber % 3) * 2000 as bigint) as w", "cast(l_quantity as bigint) as petcount",
    )
    a, b = (F.least("p", "q"), F.greatest("p", "q")) if oriented else (F.col("p"), F.col("q"))
    return rows.select("chromosome_A", a.alias("start_A"), (a + F.col("w")).alias("end_A"), F.col("chromosome_A").alias("chromosome_B"), b.alias("start_B"), (b + F.col("w")).alias("end_B"), "petcount")


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """(key, id, start, end): an interval for each event, in 50 groups of users; some are empty, some begin below 0."""
    rows = table(spark, folder, "events")
    start = F.col("event_id") * 7919 % 20011 - 500
    length = F.floor(F.abs(F.coalesce("value", F.lit(0.0)))).cast("long") % 97
    return rows.select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("id"), start.alias("start"), (start + length).alias("end"))


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """(key, id, start, end): a second set of intervals, from orders, in the same groups and range."""
    rows = table(spark, folder, "orders")
    start = F.col("o_orderkey") * 104729 % 20011 - 500
    return rows.select((F.col("o_custkey") % 50).alias("key"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + F.col("o_orderkey") % 41).alias("end"))
