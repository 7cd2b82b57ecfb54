"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.common import cut

#: Nodes up to which their neighbours are sent to all tasks; more are joined by a shuffle.
SENT = 1 << 18


def _neighbours(links: DataFrame) -> DataFrame:
    """(u, m, top, lo, hi) for each node: its smallest and largest neighbour, and those of its neighbours below it."""
    ends = links.select("u", "v", F.col("v").alias("low")).unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")), allowMissingColumns=True)
    return ends.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"), F.min("low").alias("lo"), F.max("low").alias("hi"))


def _contracted(links: DataFrame, near: DataFrame, small: bool) -> DataFrame:
    """A large and a small star. ``links`` (u, v) has u > v; links may be repeated, and never become more.

    Large star: every neighbour above a node moves to the node's smallest neighbour. Small star: a node
    and its neighbours below it move to the smallest of them. Each is a grouped minimum and a join back on
    the node, so that a node with very many links is summed up before the shuffle and split in the join; a
    ``small`` table of nodes is sent to all tasks, and links are not moved.
    """
    sent = F.broadcast if small else lambda df: df
    least = near.select("u", F.least("u", "m").alias("m"))
    moved = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(sent(least), "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    least = moved.groupBy("u").agg(F.min("v").alias("m"))
    both = moved.join(sent(least), "u").select("u", "v", "m")
    # The link to the smallest one stays; the others move to it.
    return both.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Rounds go on until all links are stars: each node has one link, to its component's smallest node, or is that node.
    They are logarithmic in the length of the longest chain; every one is written to the shared checkpoint folder. Self
    links and repeated links are allowed; null ends are dropped. The first round reads ``edges`` three times, so these
    should be written rows.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    while True:
        near = cut(_neighbours(links))
        if near.filter("lo <> hi or lo is not null and top > u").isEmpty():
            return near.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        links = cut(_contracted(links, near, near.count() <= SENT))
