"""Contact graphs: from interactions to distinct anchors, nodes and edges, one graph for each chromosome."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from weftspan.functions.intervals import Interval, floor_div
from weftspan.functions.lineage import cut
from weftspan.operators.islands import islands

SIDES = ("A", "B")
EDGE = ["graph", "node_id_A", "node_id_B"]
#: Anchors or nodes up to this number are sent to all executors for a join; of more, both sides are shuffled.
SENT_ROWS = 1 << 19


def prepare(df: DataFrame, bin_size: int = 5000, fix_bin_start: bool = True) -> DataFrame:
    """Interactions with a petcount (1.0 where there is none) and both anchors snapped to bins that begin at 1."""
    df = df.withColumn("petcount", F.col("petcount").cast("double") if "petcount" in df.columns else F.lit(1.0))
    for side in SIDES:
        start = F.col(f"start_{side}") + (1 if fix_bin_start else 0)
        df = Interval(start, F.col(f"end_{side}")).bin(bin_size, 1).assign_to(df, f"start_{side}", f"end_{side}")
    return df


def within_chromosomes(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of one chromosome each, which is what a graph is made of; with ``strict``, any other row fails the job."""
    same = F.col("chromosome_A") == F.col("chromosome_B")
    if strict:
        return df.withColumn("chromosome_B", F.when(same, F.col("chromosome_B")).otherwise(F.raise_error(F.lit("an interaction between chromosomes"))))
    return df.filter(same)


def contact_length() -> Column:
    return floor_div(F.abs(F.col("start_A") - F.col("start_B") + F.col("end_A") - F.col("end_B")), 2)


def anchors(df: DataFrame, numbered: bool = False) -> DataFrame:
    """(graph, chromosome, start, end, midpoint, length[, anchor_id]): the distinct anchors of prepared interactions.

    Length counts both ends. Ids, if asked for, number each graph's anchors by (chromosome, start, end).
    """
    ends = [F.struct(F.col("chromosome_A").alias("graph"), F.col(f"chromosome_{s}").alias("chromosome"), F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end")) for s in SIDES]
    rows = df.select(F.explode(F.array(*ends)).alias("a")).select("a.*").distinct()
    rows = rows.withColumn("midpoint", Interval.of().center()).withColumn("length", F.col("end") - F.col("start") + 1)
    if numbered:
        rows = rows.withColumn("anchor_id", (F.row_number().over(Window.partitionBy("graph").orderBy("chromosome", "start", "end")) - 1).cast("long"))
    return rows


def cluster_overlapping(expand_by: int = -1, from_midpoint: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Node strategy: anchors whose expanded intervals overlap are one node. By default adjacent bins stay apart."""

    def run(found: DataFrame) -> DataFrame:
        base = Interval.of("midpoint", None) if from_midpoint else Interval.of()
        wide = base.expand(expand_by).assign_to(found, "_start", "_end")
        # Distinct anchors are pairs of bin edges: a chromosome has as many as its length allows, however many contacts.
        return islands(wide, ["graph", "chromosome"], "_start", "_end", "node", tile=0).drop("_start", "_end")

    return run


def one_node_each(found: DataFrame) -> DataFrame:
    """Node strategy: every anchor is a node."""
    order = Window.partitionBy("graph", "chromosome").orderBy("start", "end")
    return found.withColumn("node", F.row_number().over(order) - 1)


def node_aggregates() -> dict[str, Column]:
    return {"start": F.min("start"), "end": F.max("end"), "max_length": F.max("length"), "n_anchors": F.count("*")}


def edge_aggregates() -> dict[str, Column]:
    return {"n_contacts": F.count("*"), "total_petcount": F.sum("petcount"), "min_petcount": F.min("petcount"), "max_petcount": F.max("petcount"), "min_length": F.min("length"), "max_length": F.max("length")}


def assign_nodes(found: DataFrame, strategy: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Anchors with the number of their node, counted on through the chromosomes of a graph."""
    placed = (strategy or cluster_overlapping())(found)
    return placed.withColumn("node_id", (F.dense_rank().over(Window.partitionBy("graph").orderBy("chromosome", "node")) - 1).cast("long")).drop("node")


def nodes(assigned: DataFrame, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """(graph, node_id, chromosome, start, end, max_length, n_anchors, midpoint): one row a node; ``aggregates`` add or replace columns."""
    specs = node_aggregates() | (aggregates or {})
    rows = assigned.groupBy("graph", "node_id").agg(F.first("chromosome").alias("chromosome"), *(c.alias(n) for n, c in specs.items()))
    return rows.withColumn("midpoint", Interval.of().center())


PAIR = [f"{n}_{s}" for s in SIDES for n in ("chromosome", "start", "end")]


def bin_pairs(df: DataFrame) -> DataFrame:
    """Prepared interactions summed by pair of anchors, with the columns of ``edge_aggregates``.

    This is the one pass over all contacts: counts merge map-side, and what follows has a row for each pair of bins.
    """
    return df.withColumn("length", contact_length()).groupBy(*PAIR).agg(*(c.alias(n) for n, c in edge_aggregates().items()))


@dataclass(frozen=True)
class Holistic:
    """An aggregate of an edge that no sums can be merged to, such as a median: a Python function of the distinct values
    of a column of the contacts, in ascending order, and of how often each occurs, as two numpy arrays. Contacts are
    counted by value before they are shuffled, so an edge costs as many rows as it has values, and a task calls the
    function for one edge after another. Nulls are not among the values; an edge without any has null.
    """

    function: Callable[[np.ndarray, np.ndarray], Any]
    column: str = "petcount"
    kind: str = "double"


def counted_quantile(q: float) -> Callable[[np.ndarray, np.ndarray], float]:
    """For Holistic: the quantile of counted values, linear between the two around it."""

    def run(values: np.ndarray, counts: np.ndarray) -> float:
        upto = counts.cumsum()
        at = q * (upto[-1] - 1)
        low, high = values[upto.searchsorted([math.floor(at), math.ceil(at)], side="right")]
        return float(low + (high - low) * (at - math.floor(at)))

    return run


def sent(rows: DataFrame) -> DataFrame:
    """A written table, marked to be sent to all executors if it is small enough."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def node_pairs(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pairs of anchors with their nodes' numbers; those within one node are left out."""
    rows, ids = pairs.withColumn("graph", F.col("chromosome_A")), sent(assigned)
    for s in SIDES:
        own = ids.select("graph", F.col("chromosome").alias(f"chromosome_{s}"), F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}"), F.col("node_id").alias(f"node_id_{s}"))
        rows = rows.join(own, ["graph", f"chromosome_{s}", f"start_{s}", f"end_{s}"])
    return rows.filter("node_id_A <> node_id_B")


def _holistic(contacts: DataFrame, found: dict[str, Holistic]) -> list[DataFrame]:
    """One table (EDGE, results) for each column that holistic aggregates read."""
    out = []
    for column in dict.fromkeys(h.column for h in found.values()):
        asked = {n: h for n, h in found.items() if h.column == column}
        schema = ", ".join(["graph string, node_id_A long, node_id_B long", *(f"`{n}` {h.kind}" for n, h in asked.items())])
        arrow = to_arrow_schema(StructType.fromDDL(schema))

        def run(batches: Iterator[pa.RecordBatch], functions=tuple(h.function for h in asked.values()), arrow=arrow) -> Iterator[pa.RecordBatch]:
            held = None
            for last, b in _with_end(batches):
                table = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
                edge = [table.column(c).to_numpy(zero_copy_only=False) for c in EDGE]
                value, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_value", "_n"))
                new = np.zeros(len(n), bool)
                new[:1] = True
                for c in edge:
                    new[1:] |= c[1:] != c[:-1]
                starts = np.append(np.flatnonzero(new), len(n))
                whole = len(starts) - (1 if last else 2)  # the last edge may go on in the next batch
                if whole > 0:
                    made = [[f(value[a:z], n[a:z]) for a, z in zip(starts[:whole], starts[1 : whole + 1], strict=True)] for f in functions]
                    first = pa.array(starts[:whole])
                    yield pa.RecordBatch.from_arrays([*(table.column(c).take(first).cast(arrow.field(c).type) for c in EDGE), *(pa.array(m, arrow.field(i + 3).type) for i, m in enumerate(made))], schema=arrow)
                held = None if last else table.slice(int(starts[max(whole, 0)]))

        values = contacts.filter(F.col(column).isNotNull()).groupBy(*EDGE, F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
        out.append(values.repartition(*EDGE).sortWithinPartitions(*EDGE, "_value").mapInArrow(run, schema))
    return out


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Each batch that has rows, and whether it is the last."""
    before = None
    for b in batches:
        if b.num_rows:
            if before is not None:
                yield False, before
            before = b
    if before is not None:
        yield True, before


def edges(df: DataFrame, assigned: DataFrame, aggregates: dict[str, Column | Holistic] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(graph, node_id_A, node_id_B, counts and extremes, is_contact, is_strand, weight): contacts summed by ordered node pair.

    ``df`` holds prepared interactions, or their ``bin_pairs`` if there are no aggregates of one's own. Those add
    columns or replace them: columns are aggregated over the contacts, ``Holistic`` ones over counted values. All else
    comes from the summed pairs (given, if they are written already), and contacts find their edge by their pair of
    anchors. Contacts within one node are left out.
    """
    if pairs is None:
        pairs = df if "n_contacts" in df.columns else cut(bin_pairs(df))
    aggregates = aggregates or {}
    placed = node_pairs(pairs, assigned)
    specs = {"n_contacts": F.sum("n_contacts"), "total_petcount": F.sum("total_petcount"), "min_petcount": F.min("min_petcount"), "max_petcount": F.max("max_petcount"), "min_length": F.min("min_length"), "max_length": F.max("max_length")}
    found = placed.groupBy(*EDGE).agg(*(c.alias(n) for n, c in specs.items() if n not in aggregates))
    if aggregates:
        plain, own = {n: c for n, c in aggregates.items() if not isinstance(c, Holistic)}, {n: c for n, c in aggregates.items() if isinstance(c, Holistic)}
        # The pair is one column, which is never null: asked whether each of its parts is, Spark would compute all six
        # from the contacts again for each row, below the join.
        both = df.withColumns({"length": contact_length(), "_pair": F.struct(*PAIR)}).join(placed.select(F.struct(*PAIR).alias("_pair"), *EDGE), "_pair").drop("_pair")
        contacts = cut(both) if own else both
        parts = [contacts.groupBy(*EDGE).agg(*(c.alias(n) for n, c in plain.items()))] if plain else []
        for part in [*parts, *_holistic(contacts, own)]:
            found = found.join(part, EDGE, "left")
        found = found.select(*EDGE, *(n for n in specs if n in found.columns), *(n for n in aggregates if n not in specs))
    return found.withColumns({"is_contact": F.lit(True), "is_strand": F.lit(False), "weight": F.col("total_petcount")})


def strand_edges(found: DataFrame) -> DataFrame:
    """(graph, node_id_A, node_id_B, length): edges between nodes that follow one another, as long as their midpoints are apart."""
    w = Window.partitionBy("graph").orderBy("node_id")
    rows = found.select("graph", F.col("node_id").alias("node_id_A"), F.lead("node_id").over(w).alias("node_id_B"), (F.lead("midpoint").over(w) - F.col("midpoint")).alias("length"))
    return rows.filter("node_id_B is not null").withColumns({"is_contact": F.lit(False), "is_strand": F.lit(True)})


def with_defaults(df: DataFrame, columns: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """``df`` with all ``columns``: those it lacks hold the default of their type (0, false, empty text; null for others)."""
    plain = {"long": 0, "bigint": 0, "int": 0, "double": 0.0, "float": 0.0, "boolean": False, "string": ""}
    return df.select(*(F.col(c) if c in df.columns else F.lit(plain.get(kinds[c])).cast(kinds[c]).alias(c) for c in columns))


def add_strand_edges(weight: float = 1.0) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Edge hook: all strand edges beside the contacts, with no contacts and the given weight."""

    def run(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in edges.schema} | {"length": "bigint"}
        both = [*edges.columns, *(["length"] if "length" not in edges.columns else [])]
        strands = with_defaults(strand_edges(nodes).withColumn("weight", F.lit(float(weight))), both, kinds)
        return with_defaults(edges, both, kinds).unionByName(strands)

    return run


def build(
    df: DataFrame, strategy: Callable[[DataFrame], DataFrame] | None = None, node_aggs: dict[str, Column] | None = None, edge_aggs: dict[str, Column] | None = None,
    extra_nodes: Callable[[DataFrame], DataFrame] | None = None, extra_edges: Callable[[DataFrame], DataFrame] | None = None, strands: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of prepared interactions; those between chromosomes are left out.

    Hooks, in this order: ``extra_nodes`` may add rows to the nodes and ``extra_edges`` to the edges; ``strands`` then
    gives the final edges from both (``add_strand_edges()`` adds those along the chromosome).
    """
    inside = within_chromosomes(df)
    pairs = cut(bin_pairs(inside))
    assigned = cut(assign_nodes(anchors(pairs), strategy))
    found = cut(nodes(assigned, node_aggs))
    found = extra_nodes(found) if extra_nodes else found
    linked = edges(inside, assigned, edge_aggs, pairs)
    linked = extra_edges(linked) if extra_edges else linked
    return found, strands(found, linked) if strands else linked
