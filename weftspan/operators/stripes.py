"""Stripes: fans of contacts on one side of an anchor, clustered by anchor, then by the position of their leafs.

A blade is a contact seen from one of its two nodes, the fan's anchor; its leaf is the other node. Direction R has the
leafs that start after the anchor, L those before. Everything is keyed by (graph, direction) and below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.functions.chromosomes import chromosome_index
from weftspan.operators.graph import sent
from weftspan.operators.spans import span_clusters

SIDE = ["graph", "direction"]
CLUSTER = [*SIDE, "fan_cluster"]


def blades(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each contact and each of its ends as the fan's anchor.

    A pair of nodes with contacts in both orders has two edges; each of its two blades then stands for the edge with
    the lower number (its nodes in their stored order), as a graph that looks an edge up by its nodes has it.
    """
    number = F.struct("node_id_A", "node_id_B")
    pair = ["graph", "low", "high"]
    ordered = edges.withColumns({"low": F.least("node_id_A", "node_id_B"), "high": F.greatest("node_id_A", "node_id_B")})
    looked = ordered.groupBy(*pair).agg(F.count("*").alias("times"), F.min_by(F.struct("node_id_A", "node_id_B", "n_contacts", "weight"), number).alias("e"))
    each = looked.select("graph", F.explode(F.array(F.struct(F.col("low").alias("anchor"), F.col("high").alias("leaf")), F.struct(F.col("high").alias("anchor"), F.col("low").alias("leaf")))).alias("x"), "times", "e.*")
    each = each.select("graph", "x.anchor", "x.leaf", "times", "node_id_A", "node_id_B", "n_contacts", "weight")
    known = sent(nodes)
    place = lambda p, n: known.select("graph", F.col("node_id").alias(n), F.col("chromosome").alias(f"{p}_chromosome"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))
    rows = each.join(place("anchor", "anchor"), ["graph", "anchor"]).join(place("leaf", "leaf"), ["graph", "leaf"])
    rows = rows.withColumn("direction", F.when(F.col("leaf_start") < F.col("anchor_start"), "L").otherwise("R"))
    position = F.when(F.col("direction") == "R", F.col("leaf_start")).otherwise(-F.col("leaf_end"))
    return rows.withColumn("position", position)


def fans(found: DataFrame, min_size: int = 1, max_size: int | None = None) -> DataFrame:
    """One row for each anchor and direction; leafs of a pair with two edges count twice."""
    rows = found.groupBy(*SIDE, "anchor").agg(F.first("anchor_chromosome").alias("chromosome"), F.first("anchor_start").alias("anchor_start"), F.first("anchor_end").alias("anchor_end"), F.min("leaf_start").alias("leafs_start"), F.max("leaf_end").alias("leafs_end"), F.sum("times").alias("size"))
    rows = rows.filter(F.col("size") >= min_size)
    return rows if max_size is None else rows.filter(F.col("size") <= max_size)


def cluster_blades(found: DataFrame, fan_gap: int = 15000, loop_gap: int = 15000) -> DataFrame:
    """Blades with the fan cluster (first anchor start) and the loop cluster (first position) that they belong to."""
    fan = span_clusters(found, SIDE, "anchor_start", fan_gap, "fan_cluster")
    return span_clusters(fan, CLUSTER, "position", loop_gap, "loop_cluster")


def loop_clusters(clustered: DataFrame) -> DataFrame:
    """One row for each loop cluster: extents, counts, weight, and the edge of its first blade.

    Blades go by position, then by the fan's anchor. ``lc_idx`` counts the clusters of a stripe from its anchor on.
    """
    order = F.struct("position", "anchor_start", "leaf")
    rows = clustered.groupBy(*CLUSTER, "loop_cluster").agg(
        F.min("anchor_start").alias("anchor_start"), F.max("anchor_end").alias("anchor_end"), F.min("leaf_start").alias("leafs_start"), F.max("leaf_end").alias("leafs_end"),
        F.sum("times").alias("n_edges"), F.sum(F.col("weight") * F.col("times")).alias("weight"), F.sum(F.col("n_contacts") * F.col("times")).alias("loop_count"),
        F.min_by(F.struct("node_id_A", "node_id_B"), order).alias("first_edge"), F.collect_set("anchor").alias("fans"), F.collect_set("leaf").alias("leafs"),
    )
    w = Window.partitionBy(*CLUSTER).orderBy("loop_cluster")
    return rows.withColumn("lc_idx", (F.row_number().over(w) - 1).cast("long"))


def number_stripes(found: DataFrame) -> DataFrame:
    """(graph, direction, fan_cluster, stripe_id): chromosomes in natural order, R before L, then by anchor.

    Ids are a running count over all stripes: counts by (graph, direction) are added up first, so that only they, not
    the stripes, meet in one task.
    """
    stripes = found.select(*CLUSTER).distinct()
    side = F.when(F.col("direction") == "R", 0).otherwise(1)
    own = F.row_number().over(Window.partitionBy(*SIDE).orderBy("fan_cluster")) - 1
    across = Window.orderBy("_c", "graph", "_d").rowsBetween(Window.unboundedPreceding, -1)
    counts = stripes.groupBy(*SIDE).agg(F.count("*").alias("_n")).withColumns({"_c": chromosome_index("graph"), "_d": side})
    counts = counts.select(*SIDE, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    return stripes.withColumn("_own", own).join(counts, SIDE).select(*CLUSTER, (F.col("_own") + F.col("_before")).alias("stripe_id"))


def chromosome_of(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy(*CLUSTER).agg(F.first("anchor_chromosome").alias("chromosome"))


def orthogonal_links(clustered: DataFrame, found: DataFrame) -> DataFrame:
    """(graph, direction, fan_cluster, lc_idx, other_cluster, other_idx): the loop cluster of the opposite direction
    that holds the edge of a loop cluster's first blade."""
    index = found.select(*CLUSTER, "loop_cluster", "lc_idx")
    holds = clustered.select(*CLUSTER, "loop_cluster", "node_id_A", "node_id_B").join(index, [*CLUSTER, "loop_cluster"])
    turned = F.when(F.col("direction") == "R", "L").otherwise("R")
    other = holds.groupBy("graph", turned.alias("direction"), "node_id_A", "node_id_B").agg(F.max(F.struct("fan_cluster", "lc_idx")).alias("o"))
    ask = found.select(*CLUSTER, "lc_idx", "first_edge.*")
    return ask.join(other, ["graph", "direction", "node_id_A", "node_id_B"]).select(*CLUSTER, "lc_idx", F.col("o.fan_cluster").alias("other_cluster"), F.col("o.lc_idx").alias("other_idx"))


def extents(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each stripe of loop clusters ``rows``: anchors, leafs, length, counts."""
    right = F.col("direction") == "R"
    facts = rows.groupBy(*key).agg(
        F.min("anchor_start").alias("anchor_start"), F.max("anchor_end").alias("anchor_end"), F.min("leafs_start").alias("_low"), F.max("leafs_end").alias("_high"),
        F.size(F.array_distinct(F.flatten(F.collect_list("fans")))).cast("long").alias("n_fans"), F.count("*").alias("n_loop_clusters"),
        F.size(F.array_distinct(F.flatten(F.collect_list("leafs")))).cast("long").alias("n_leafs"), F.sum("n_edges").alias("n_edges"),
    )
    start = F.when(right, F.col("anchor_start")).otherwise(F.col("_low"))
    end = F.when(right, F.col("_high")).otherwise(F.col("anchor_end"))
    return facts.withColumns({"start": start, "end": end}).withColumns({"length": F.col("end") - F.col("start"), "width": F.col("anchor_end") - F.col("anchor_start")}).drop("_low", "_high")


def signed(column: str) -> Column:
    """Ascending for R, descending for L."""
    return F.when(F.col("direction") == "R", F.col(column)).otherwise(-F.col(column))
