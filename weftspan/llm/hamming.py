"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of a few bits less than log2 of the rows' number, each with an index from its values to the
codes that have them: one table of (segment, value, code) that all queries are joined with. A query looks up all values
within a growing radius of its own in every segment. When all segments have been searched to radius r, and the first m of
them to r + 1, each code within Hamming distance ``segments * (r + 1) + m - 1`` has been seen. The k-th nearest row seen so
far bounds how far a query has to look: rows beyond it are not kept, and of the next radius only as many segments are
searched as the bound asks for. Only queries that are not done go on to the next radius.

A pair of codes meets in the segment where they differ least (the first of these) and at that radius, so each pair is
verified and kept once. Equal codes are one code with up to k ids. Everything is joins and sums on DataFrames: what a
query costs depends on the radius it needs, not on how many rows there are besides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.llm.common import cut

#: Bits of a segment at least and at most; between them SPARED less than log2 of the rows. A value then has a few codes,
#: which the join compares in passing; a value that is looked up costs a row of its own, and wide segments have many.
NARROWEST, WIDEST, SPARED = 4, 30, 2


def sign_bits(vector: str) -> Column:
    """One bit for each number of a vector: whether it is over 0. Null numbers and NaN give 0."""
    return F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x.cast("double")), 1).otherwise(0))


def segments(bits: Column, width: int) -> Column:
    """The values of a code's segments, from the array of its bits: as few segments as have at most ``width`` bits."""
    size = F.size(bits)
    count = F.greatest(F.lit(1), F.ceil(size / width)).cast("int")

    def value(j: Column) -> Column:
        start, end = F.floor(size * j / count).cast("int"), F.floor(size * (j + 1) / count).cast("int")
        return F.aggregate(F.slice(bits, start + 1, end - start), F.lit(0), lambda x, b: F.shiftleft(x, 1).bitwiseOR(b))

    return F.transform(F.sequence(F.lit(0), count - 1), value)


def _width(size: str, code: str, j: str) -> Column:
    """Bits of segment j of a code."""
    count = F.size(code)
    return F.floor(F.col(size) * (F.col(j) + 1) / count).cast("int") - F.floor(F.col(size) * F.col(j) / count).cast("int")


def _wider(probes: DataFrame) -> DataFrame:
    """The values one bit further away: each probe with every bit above its last one (``top``) turned in addition."""
    turned = probes.filter(F.col("top") < F.col("b") - 1).withColumn("bit", F.explode(F.sequence(F.col("top") + 1, F.col("b") - 1)))
    value = F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("bit")))
    return turned.withColumns({"value": value, "top": F.col("bit")}).drop("bit")


def _seen(found: DataFrame, k: int) -> DataFrame:
    """(size, q, far, all): the distance of the k-th nearest row found (null: fewer are), and how many are found."""
    upto = Window.partitionBy("size", "q").orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    sums = found.groupBy("size", "q", "distance").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    return sums.groupBy("size", "q").agg(F.min(F.when(F.col("upto") >= k, F.col("distance"))).alias("far"), F.max("upto").alias("all"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each query its k nearest rows in Hamming distance of sign codes.

    Ties go to the smaller id; a query that is itself among the rows is found like any other. Rows and queries
    without a key or vector take no part; codes of another length are no neighbours. Fewer than k rows give fewer
    answers; repeated rows count each, and repeated queries are answered each. Very long vectors have more segments.
    Empty tables give no rows. Keys are integers; other columns may have any names.
    """
    spark = rows.sparkSession
    bits = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null").select("id", F.size("v").alias("size"), sign_bits("v").alias("bits"))
    base, asked = bits(rows), bits(queries)
    width = min(WIDEST, max(NARROWEST, math.ceil(math.log2(max(2, base.count()))) - SPARED))
    coded = lambda df: df.select("id", "size", segments(F.col("bits"), width).alias("code"))
    own = Window.partitionBy("size", "code").orderBy("id")
    ids = cut(coded(base).withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k).drop("place"))
    codes = cut(ids.groupBy("size", "code").agg(F.count("*").alias("n")))
    index = codes.select("size", "n", "code", F.posexplode("code").alias("j", "value"))
    totals = codes.groupBy("size").agg(F.sum("n").alias("total"))
    asked = cut(coded(asked).select(F.col("id").alias("query_id"), "size", F.col("code").alias("q")))
    open_ = cut(asked.select("size", "q").distinct().join(totals, "size").withColumn("far", F.lit(None).cast("int")))
    probes = open_.select("size", "q", F.posexplode("q").alias("j", "value")).withColumn("b", _width("size", "q", "j").cast("int"))
    probes = probes.select("size", "q", F.lit(None).cast("int").alias("far"), "j", "b", "value", F.lit(-1).alias("top"))
    found, radius = None, 0
    while not open_.isEmpty():
        met = probes.select("size", "q", "far", "j", "value").join(index, ["size", "j", "value"]).withColumn("apart", F.zip_with("q", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y))))
        first = (F.array_min("apart") == radius) & (F.array_position("apart", F.lit(radius)) == F.col("j") + 1)
        met = met.filter(first).withColumn("distance", F.aggregate("apart", F.lit(0), lambda x, y: x + y))
        new = cut(met.filter(F.col("far").isNull() | (F.col("distance") <= F.col("far"))).select("size", "q", "code", "n", "distance"))
        found = new if found is None else found.unionByName(new)
        radius += 1
        covered = F.size("q") * radius - 1  # every code at this distance or nearer has been seen, or is beyond ``far``
        left = open_.drop("far").join(_seen(found, k), ["size", "q"], "left")
        # A query that searched only some segments was to see all up to ``far``, which is then below ``covered``: it is done.
        done = F.coalesce(F.col("far") <= covered, F.lit(False)) | (F.coalesce("all", F.lit(0)) >= F.col("total")) | (covered >= F.col("size"))
        open_ = cut(left.filter(~done).select("size", "q", "total", "far"))
        asks = F.coalesce(F.col("far") - covered, F.size("q"))  # segments to be searched at the next radius
        probes = cut(_wider(probes.drop("far").join(open_.drop("total"), ["size", "q"]).filter(F.col("j") < asks)))
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, neighbour_id long, distance int")
    best = Window.partitionBy("size", "q").orderBy("distance", "id")
    near = found.join(ids, ["size", "code"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return asked.join(near.select("size", "q", "rank", "id", "distance"), ["size", "q"]).select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")
