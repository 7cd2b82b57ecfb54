"""From scored loop clusters to the final stripes: trimming, filtering, merging, and the result table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.functions.chromosomes import chromosome_index
from weftspan.operators.stripes import extents, signed

STRIPE = ["graph", "direction", "stripe_id"]
#: Stripe ids in a block that is looked at together.
BLOCK = 1 << 14
#: Columns of the result, in order.
RESULT = ("chromosome", "direction", "stripe_id", "anchor_start", "anchor_end", "width", "start", "end", "length", "n_fans", "n_loop_clusters", "n_leafs", "n_edges", "stripe_score", "mean_cross_score")


def trim(rows: DataFrame, min_length: int = 20000, max_length: int | None = None, gap_threshold: float = 0.0) -> DataFrame:
    """L stripes without the loop clusters from the first on that is at least ``min_length`` away and either over
    ``max_length`` or below the gap threshold; a stripe of which nothing is left goes. R stripes stay whole."""
    far = F.lit(False) if max_length is None else F.col("length") > max_length
    stop = (F.col("direction") == "L") & (F.col("length") >= min_length) & (far | (F.col("worst_gap_score") < gap_threshold))
    cut = F.min(F.when(stop, F.col("lc_idx"))).over(Window.partitionBy(*STRIPE))
    return rows.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col("lc_idx") < F.col("_cut"))).drop("_cut")


def summarise(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """One row for each stripe: extents, counts, the last cluster's scores, mean cross score, best orientation."""
    order = F.col("lc_idx") if order is None else order
    scores = rows.groupBy(*STRIPE).agg(F.max_by("stripe_score", order).alias("stripe_score"), F.max_by("worst_gap_score", order).alias("last_gap_score"), F.avg("cross_score").alias("mean_cross_score"), F.max("orientation_score").alias("best_orientation"))
    return extents(rows, STRIPE).join(scores, STRIPE)


def filter_stripes(stripes: DataFrame, min_length: int = 20000, min_clusters: int = 2, min_leafs: int = 2, min_edges: int = 2, min_gap_score: float = 0.0, min_stripe_score: float = 0.0, min_cross_score: float = 0.0, min_orientation_score: float = 0.5) -> DataFrame:
    """Rows of ``summarise`` that reach every limit."""
    least = {"length": min_length, "n_loop_clusters": min_clusters, "n_leafs": min_leafs, "n_edges": min_edges, "last_gap_score": min_gap_score, "stripe_score": min_stripe_score, "mean_cross_score": min_cross_score, "best_orientation": min_orientation_score}
    for column, limit in least.items():
        stripes = stripes.filter(F.col(column) >= limit)
    return stripes


def pieces(stripes: DataFrame, threshold: int = 0, max_width: int = 80000) -> DataFrame:
    """``stripes`` with ``piece``, the id of the first of those around them that a run could reach.

    A run holds the stripe before the next one, so its anchors begin no later and end no earlier than that one's. The
    next cannot join if its end is more than ``max_width`` beyond the other's start, or if its start is more than
    ``threshold`` before the other's end; there, whatever the run has become, a new piece begins. Stripes are looked at
    in blocks of ids, and blocks pass on their last stripe and the piece it is in, so that no task has a chromosome.
    """
    side = ["direction", "graph"]
    rows = stripes.withColumn("_block", F.floor(F.col("stripe_id") / BLOCK))
    within = Window.partitionBy(*side, "_block").orderBy("stripe_id")
    across = Window.partitionBy(*side).orderBy("_block")
    last = F.struct("stripe_id", "anchor_start", "anchor_end")
    ends = rows.groupBy(*side, "_block").agg(F.max(last).alias("_last")).select(*side, "_block", F.lag("_last").over(across).alias("_earlier"))
    rows = rows.join(ends, [*side, "_block"])
    before = F.coalesce(F.lag(F.struct("stripe_id", "anchor_start", "anchor_end")).over(within), F.col("_earlier"))
    rows = rows.withColumn("_p", before)
    apart = F.col("_p").isNull() | (F.col("anchor_end") - F.col("_p.anchor_start") > max_width) | (F.col("_p.anchor_end") - F.col("anchor_start") > threshold)
    rows = rows.withColumn("_first", F.when(apart, F.col("stripe_id")))
    # The id of the latest first one: of the same block, else of the latest block before that has one.
    known = rows.groupBy(*side, "_block").agg(F.max("_first").alias("_f")).select(*side, "_block", F.max("_f").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    rows = rows.join(known, [*side, "_block"])
    return rows.withColumn("piece", F.coalesce(F.max("_first").over(within), "_carried")).select(*stripes.columns, "piece")


def _runs(threshold: int, max_width: int, max_length_diff: int):
    """Walks each piece once, in order of stripe id: which stripes merge into which run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rid, a0, a1, s, e = None, -1, 0, 0, 0, 0
        for b in batches:
            out = []
            for g, c, d, i, x0, x1, y0, y1 in zip(b["piece"], b["graph"], b["direction"], b["stripe_id"], b["anchor_start"], b["anchor_end"], b["start"], b["end"], strict=True):
                joins = group == (g, c, d) and a1 - x0 <= threshold and x1 - a0 <= max_width and abs((y1 - y0) - (e - s)) <= max_length_diff
                if joins:
                    a0, a1 = min(a0, x0), max(a1, x1)
                    s, e = (a0, max(e, y1)) if d == "R" else (min(s, y0), a1)
                else:
                    group, rid, a0, a1, s, e = (g, c, d), i, x0, x1, y0, y1
                out.append(rid)
            yield b[["graph", "direction", "stripe_id"]].assign(run_id=out)

    return run


def merge_runs(stripes: DataFrame, threshold: int = 0, max_width: int = 80000, max_length_diff: int = 200000, compat: str = "reference") -> DataFrame:
    """(graph, direction, stripe_id, run_id): neighbouring stripes that merge share the id of the first of them.

    Stripes are walked in pieces that no merge can cross (see ``pieces``), dealt to tasks one by one.
    With ``compat="reference"`` the last run of every chromosome but a direction's last one is left out.
    """
    rows = stripes.select(*STRIPE, "anchor_start", "anchor_end", "start", "end")
    dealt = pieces(rows, threshold, max_width).repartition("graph", "direction", "piece").sortWithinPartitions("graph", "direction", "piece", "stripe_id")
    runs = dealt.mapInPandas(_runs(threshold, max_width, max_length_diff), "graph string, direction string, stripe_id long, run_id long")
    if compat == "fixed":
        return runs
    ends = runs.groupBy("graph", "direction").agg(F.max("run_id").alias("_last"))
    after = Window.partitionBy("direction").orderBy(chromosome_index("graph"), "graph")
    lost = ends.withColumn("_more", F.lead("graph").over(after).isNotNull()).filter("_more").select("graph", "direction", F.col("_last").alias("run_id"))
    return runs.join(lost, ["graph", "direction", "run_id"], "left_anti").select(*STRIPE, "run_id")


def merge(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Loop clusters of the stripes in ``runs`` under their run's id, renumbered by the start of their leafs (from the
    far end for L); scores move with their clusters and are not computed again."""
    joined = rows.join(runs, STRIPE)
    order = Window.partitionBy("graph", "direction", "run_id").orderBy(signed("leafs_start"), "stripe_id", "lc_idx")
    return joined.withColumn("_idx", (F.row_number().over(order) - 1).cast("long")).drop("lc_idx", "stripe_id").withColumnsRenamed({"_idx": "lc_idx", "run_id": "stripe_id"})


def result(stripes: DataFrame) -> DataFrame:
    """The 15 columns of a stripe table; no stripes give no rows."""
    return stripes.withColumn("chromosome", F.col("graph")).select(*RESULT)
