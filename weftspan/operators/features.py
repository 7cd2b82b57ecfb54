"""Scores of loop clusters: lengths, gaps, quantile-normalised gap scores, and running scores along a stripe.

``compat="reference"`` keeps two properties of the scores that callers rely on: R stripes see no orthogonal scores
(w_score is 0), and cross_score is that of a stripe's last loop cluster throughout. ``compat="fixed"`` computes both
for every loop cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from weftspan.functions.lineage import cut
from weftspan.operators.stripes import CLUSTER

#: Lengths and gaps count as this at least.
LEAST = 1000
#: An orthogonal score counts as this at least.
LEAST_W = 0.01


def _order() -> WindowSpec:
    return Window.partitionBy(*CLUSTER).orderBy("lc_idx")


def _so_far() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _whole() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def lengths_and_gaps(rows: DataFrame) -> DataFrame:
    """Loop clusters with length from the stripe's anchor, gap to the previous cluster, orientation and raw gap score."""
    right = F.col("direction") == "R"
    first, last = F.min("anchor_start").over(_whole()), F.max("anchor_end").over(_whole())
    length = F.when(right, F.col("leafs_end") - first).otherwise(last - F.col("leafs_start"))
    gap = F.when(right, F.col("leafs_start") - F.coalesce(F.lag("leafs_end").over(_order()), first)).otherwise(F.coalesce(F.lag("leafs_start").over(_order()), last) - F.col("leafs_end"))
    rows = rows.withColumns({"length": length, "gap_size": gap, "orientation_score": F.try_divide((F.col("leafs_end") - F.col("leafs_start")).cast("double"), (F.col("anchor_end") - F.col("anchor_start")).cast("double"))})
    ratio = F.greatest("gap_size", F.lit(LEAST)).cast("double") / F.greatest("length", F.lit(LEAST)).cast("double")
    return rows.withColumn("raw_gap_score", F.greatest(F.lit(0.0), -F.log10(ratio)))


def quantiles(rows: DataFrame, levels: Sequence[float]) -> DataFrame:
    """(feature, level, q): exact quantiles of the values ``v`` of each ``feature``, linear between neighbours.

    Equal values are counted first, then sorted by range; the running count of a value is what its partition has before
    it and what the partitions before that have, so no task sees more than its range. Null values are left out.
    """
    counted = rows.filter("v is not null").groupBy("feature", "v").agg(F.count("*").alias("n"))
    placed = cut(counted.orderBy("feature", "v").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("feature", "part").agg(F.sum("n").alias("s"))
    own = Window.partitionBy("feature").orderBy("part")
    sums = sums.select("feature", "part", F.coalesce(F.sum("s").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("s").over(Window.partitionBy("feature")).alias("total"))
    within = Window.partitionBy("feature", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.withColumn("upto", F.sum("n").over(within)).join(sums, ["feature", "part"])
    last, first = F.col("ahead") + F.col("upto"), F.col("ahead") + F.col("upto") - F.col("n")
    # The value of rank r (from 0) is the one with first <= r < last; each level asks for the two ranks around it.
    asked = F.array(*(F.struct(F.lit(float(q)).alias("level"), (F.lit(float(q)) * (F.col("total") - 1)).alias("at")) for q in levels))
    holds = lambda r: (first <= r) & (r < last)
    met = upto.select("feature", "v", F.explode(F.filter(asked, lambda x: holds(F.floor(x["at"])) | holds(F.ceil(x["at"])))).alias("x"), first.alias("first"), last.alias("last"))
    part = F.max(F.col("x.at") - F.floor("x.at"))
    low, high = F.min("v"), F.max("v")
    return met.groupBy("feature", F.col("x.level").alias("level")).agg((low + (high - low) * part).alias("q"))


def quantile_knots(rows: DataFrame, levels: int = 50, column: str = "raw_gap_score") -> DataFrame:
    """(q, level): quantiles of all values at levels + 2 even steps from 0 to 1; equal quantiles keep the lowest level.

    Without values all quantiles are null, so there is one knot, (null, 0)."""
    steps = [i / (levels + 1) for i in range(levels + 2)]
    found = quantiles(rows.select(F.lit("").alias("feature"), F.col(column).alias("v")), steps)
    every = rows.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in steps))).alias("level"))
    return every.join(found, "level", "left").groupBy(F.round("q", 12).alias("q")).agg(F.min("level").alias("level"))


def interpolate(value: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through the sorted points (xs, ys), constant beyond them."""
    k, n = F.size(F.filter(xs, lambda x: x <= value)), F.size(xs)
    x0, x1, y0, y1 = F.try_element_at(xs, k), F.try_element_at(xs, k + 1), F.try_element_at(ys, k), F.try_element_at(ys, k + 1)
    inner = y0 + (y1 - y0) / F.when(x1 > x0, x1 - x0) * (value - x0)
    return F.when(k <= 0, F.get(ys, F.lit(0))).when(k >= n, F.get(ys, n - 1)).otherwise(inner)


def gap_scores(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """Loop clusters with gap_score: the quantile level of the raw score. The knots are at most some fifty rows."""
    sorted_knots = F.array_sort(F.collect_list(F.struct("q", "level")))
    one = knots.agg(sorted_knots.alias("_k")).select(F.col("_k.q").alias("_xs"), F.col("_k.level").alias("_ys"))
    return rows.join(F.broadcast(one)).withColumn("gap_score", interpolate(F.round("raw_gap_score", 12), F.col("_xs"), F.col("_ys"))).drop("_xs", "_ys")


def running_scores(rows: DataFrame, exponent: float = 2.0) -> DataFrame:
    """Loop clusters with worst_gap_score (running minimum), stripe_score (running power mean) and l_score."""
    mean = F.avg(F.pow("gap_score", F.lit(exponent))).over(_so_far())
    return rows.withColumns({
        "worst_gap_score": F.min("gap_score").over(_so_far()),
        "stripe_score": F.pow(mean, F.lit(1 / exponent)),
        "l_score": F.greatest("gap_score", F.lead("gap_score").over(_order())),
        "_least": F.least("gap_score", F.lead("gap_score").over(_order())),
    })


def cross_scores(rows: DataFrame, links: DataFrame, compat: str = "reference") -> DataFrame:
    """Loop clusters with w_score, the lower score at the crossing cluster of the other direction, and cross_score."""
    other = rows.select("graph", F.when(F.col("direction") == "R", "L").otherwise("R").alias("direction"), F.col("fan_cluster").alias("other_cluster"), F.col("lc_idx").alias("other_idx"), F.col("_least").alias("_w"))
    crossing = links.join(other, ["graph", "direction", "other_cluster", "other_idx"]).select(*CLUSTER, "lc_idx", "_w")
    scored = rows.join(crossing, [*CLUSTER, "lc_idx"], "left")
    seen = F.coalesce("_w", F.lit(0.0))
    if compat == "reference":
        scored = scored.withColumn("w_score", F.when(F.col("direction") == "R", 0.0).otherwise(seen))
        cross = F.last("l_score").over(_whole()) / F.greatest(F.last("w_score").over(_whole()), F.lit(LEAST_W))
    elif compat == "fixed":
        scored = scored.withColumn("w_score", seen)
        cross = F.col("l_score") / F.greatest("w_score", F.lit(LEAST_W))
    else:
        raise ValueError(f"unknown compat: {compat}")
    return scored.withColumn("cross_score", cross).drop("_w", "_least")


#: Levels of ``describe``; part of the semantics.
DESCRIBED = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")


def describe(rows: DataFrame, columns: Sequence[str], levels: Sequence[float] = DESCRIBED) -> DataFrame:
    """(feature, count, mean, std, min, percentiles, max): one row for each column."""
    long = _long(rows, columns)
    facts = long.groupBy("feature").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    steps = quantiles(long, levels).groupBy("feature").agg(*(F.max(F.when(F.col("level") == float(q), F.col("q"))).alias(f"p{round(100 * q)}") for q in levels))
    return facts.join(steps, "feature", "left").select("feature", "count", "mean", "std", "min", *(f"p{round(100 * q)}" for q in levels), "max")


def histograms(rows: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """(feature, bin, low, high, n): counts of each column in even bins between its least and largest value."""
    long = _long(rows, columns).filter("v is not null")
    facts = long.groupBy("feature").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("least")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = long.join(facts, "feature").groupBy("feature", at.alias("bin"), "least", width.alias("width")).agg(F.count("*").alias("n"))
    return counted.select("feature", "bin", (F.col("least") + F.col("bin") * F.col("width")).alias("low"), (F.col("least") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n")


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, n): counts in even bins from low to high; values beyond go to the first or last bin."""
    at = F.least(F.greatest(F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    return rows.groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
