"""Anchored span clusters: within a group, in order of position, a row joins the current cluster if it is at most
``gap`` away from the cluster's first row; otherwise it opens the next one.

That is not a gap between neighbours (which a lag would find), so rows are read in order. A group is first cut where
neighbours are over ``gap`` apart, which always opens a cluster; the pieces are dealt out to tasks, and each task walks
its pieces once, in order, in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _walk(gap: int):
    """Adds the first position of each row's cluster; rows come sorted by piece and position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, first = None, 0
        for b in batches:
            pieces, at = b["_piece"].to_numpy(), b["_at"].to_numpy()
            out, i, n = np.empty(len(b), np.int64), 0, len(b)
            change = np.append(np.flatnonzero(pieces[1:] != pieces[:-1]) + 1, n) if n else []
            for stop in change:
                if pieces[i] != piece:
                    piece, first = pieces[i], int(at[i])
                while i < stop:
                    j = i + int(np.searchsorted(at[i:stop], first + gap, side="right"))
                    out[i:j] = first
                    i = j
                    if i < stop:
                        first = int(at[i])
            yield b.assign(_first=out)

    return run


def span_clusters(df: DataFrame, keys: Sequence[str], position: str | Column, gap: int, out: str = "cluster_start") -> DataFrame:
    """``df`` with the position of the first row of each row's cluster, which names the cluster within its keys.

    ``position`` is an integer column; negate it to cluster from the far end. No rows give no rows.
    """
    at = F.col(position) if isinstance(position, str) else position
    order = Window.partitionBy(*keys).orderBy("_at")
    points = df.select(*keys, at.cast("long").alias("_at")).distinct()
    opens = F.col("_at") - F.lag("_at").over(order) > gap
    begin = F.last(F.when(F.coalesce(opens, F.lit(True)), F.col("_at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = points.withColumn("_begin", begin).withColumn("_piece", F.xxhash64(*keys, "_begin"))
    # Two pieces whose hashes agree would be walked as one; sorting by the keys keeps the rows of each together.
    dealt = pieces.repartition("_piece").sortWithinPartitions("_piece", *keys, "_at")
    schema = T.StructType([*dealt.schema.fields, T.StructField("_first", T.LongType())])
    named = dealt.mapInPandas(_walk(gap), schema).select(*keys, "_at", F.col("_first").alias(out))
    joined = df.withColumn("_at", at.cast("long"))
    cond = joined["_at"] == named["_at"]
    for k in keys:
        cond = cond & joined[k].eqNullSafe(named[k])
    return joined.join(named, cond).select(*(joined[c] for c in df.columns), named[out])


def sort_order(df: DataFrame, keys: Sequence[str], position: str, order: str) -> DataFrame:
    """(keys, order): Constant, Ascending, Descending or Unsorted, of the positions in the order of another column."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(position) - F.lag(position).over(w)
    facts = df.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.min("_step"), F.lit(0)).alias("low"), F.coalesce(F.max("_step"), F.lit(0)).alias("high"))
    kind = F.when((F.col("low") == 0) & (F.col("high") == 0), "Constant").when(F.col("low") >= 0, "Ascending").when(F.col("high") <= 0, "Descending").otherwise("Unsorted")
    return facts.select(*keys, kind.alias("order"))


def first_unsorted(df: DataFrame, keys: Sequence[str], order: str, *positions: str) -> DataFrame:
    """(keys, at): the first value of ``order`` whose positions come before those of the row ahead of it; null if sorted."""
    w = Window.partitionBy(*keys).orderBy(order)
    here, ahead = F.struct(*positions), F.lag(F.struct(*positions)).over(w)
    return df.withColumn("_bad", F.when(here < ahead, F.col(order))).groupBy(*keys).agg(F.min("_bad").alias("at"))
