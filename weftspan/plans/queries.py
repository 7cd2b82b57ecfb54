"""One registered query for each operator, on tables derived from the driver's; ``oracles`` has SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.chromosomes import chromosome_index
from weftspan.functions.intervals import Interval, floor_div, format_columns, parse_intervals
from weftspan.functions.lineage import number_rows
from weftspan.operators import compare, features, graph, islands, joins, refine, spans, stripes, viewdata
from weftspan.plans.pipeline import Call, StripeCaller
from weftspan.sources import adapters, dialects
from weftspan.sources.bedpe import filter_contacts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VIEW = viewdata.View((1000000, 4000000), (1000000, 4000000), 5000, "chr1", "chr1")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def call(spark: SparkSession, folder: str) -> Call:
    return StripeCaller().start(adapters.contacts(spark, folder))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return graph.prepare(adapters.contacts(spark, folder))


def paired(spark: SparkSession, folder: str) -> tuple[DataFrame, Interval, Interval]:
    """Intervals of both sets with one id, side by side."""
    a = adapters.spans(spark, folder).select("id", F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = adapters.regions(spark, folder).select("id", F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, "id"), Interval.of("s1", "e1"), Interval.of("s2", "e2")


def ends(i: Interval, name: str) -> list[Column]:
    return i.columns(f"{name}_start", f"{name}_end")


@query
def interval_bin(spark, folder):
    i = Interval.of()
    return adapters.spans(spark, folder).select("id", *ends(i.bin_indices(100, 1), "bin"), *i.bin(100, 1).columns())


@query
def interval_expand(spark, folder):
    i = Interval.of()
    return adapters.spans(spark, folder).select("id", *i.expand(-20, -5).columns(), *ends(i.shift(7), "shifted"))


@query
def interval_clip(spark, folder):
    return adapters.spans(spark, folder).select("id", *Interval.of().clip(0, 10000).columns())


@query
def interval_split_at(spark, folder):
    (a, b), (c, d) = Interval.of().split_at(5000), Interval.of().split_at_length(-10)
    return adapters.spans(spark, folder).select("id", *ends(a, "left"), *ends(b, "right"), *ends(c, "tail_left"), *ends(d, "tail_right"))


@query
def interval_split_ratio(spark, folder):
    a, b = Interval.of().split_at_ratio(0.5)
    return adapters.spans(spark, folder).select("id", *ends(a, "left"), *ends(b, "right"))


@query
def interval_measures(spark, folder):
    i = Interval.of()
    return adapters.spans(spark, folder).select("id", i.length().alias("length"), i.center().alias("center"), i.is_empty().alias("empty"), i.is_valid().alias("valid"))


@query
def interval_and_or_sup_gap(spark, folder):
    df, a, b = paired(spark, folder)
    left, right = a.unite(b)
    return df.select("id", *ends(a.intersect(b), "and"), *ends(a.sup(b), "sup"), *ends(a.gap_between(b), "gap"), *ends(left, "or_left"), *ends(right, "or_right"))


@query
def interval_offset_distance_overlap(spark, folder):
    df, a, b = paired(spark, folder)
    return df.select("id", a.offset(b).alias("offset"), a.distance(b).alias("distance"), a.overlap(b).alias("overlap"), a.offset(F.col("s2")).alias("point_offset"))


@query
def interval_predicates(spark, folder):
    df, a, b = paired(spark, folder)
    named = {"contains": a.contains(b), "superset": a.is_superset_of(b), "contained": a.is_contained_in(b), "subset": a.is_subset_of(b), "intersects": a.intersects(b), "separated": a.is_separated_from(b), "equal": a.equals(b), "differs": a.differs(b), "contains_point": a.contains(F.col("s2"))}
    return df.select("id", *(c.alias(n) for n, c in named.items()))


@query
def interval_format_parse(spark, folder):
    rows = adapters.spans(spark, folder).withColumn("chromosome", F.concat(F.lit("chr"), F.col("key").cast("string")))
    labelled = rows.select("id", Interval.of().to_string("chromosome", sep="..").alias("label"), format_columns("#{id} [{start:08d}]").alias("formatted"))
    (name,), i = parse_intervals("label", sep="..")
    return labelled.select("id", "label", name.alias("chromosome"), *i.columns(), "formatted")


@query
def interval_islands(spark, folder):
    return islands.islands(adapters.spans(spark, folder), ["key"], order=["id"]).select("key", "id", "start", "end", "island")


@query
def interval_union_self(spark, folder):
    return islands.union_self(adapters.spans(spark, folder), ["key"])


@query
def interval_union_other(spark, folder):
    return islands.union_other(adapters.spans(spark, folder), adapters.regions(spark, folder), ["key"])


@query
def interval_intersect_self(spark, folder):
    rows = adapters.spans(spark, folder).withColumn("part", floor_div(F.col("start"), 50))
    return islands.intersect_self(rows, ["key", "part"])


@query
def interval_intersect_other(spark, folder):
    return islands.intersect_other(adapters.spans(spark, folder), adapters.regions(spark, folder), ["key"])


@query
def interval_disjoint(spark, folder):
    return islands.is_disjoint(adapters.spans(spark, folder).withColumn("part", floor_div(F.col("start"), 200)), ["key", "part"])


@query
def interval_hull(spark, folder):
    return islands.hull(adapters.spans(spark, folder), ["key"])


@query
def interval_concat(spark, folder):
    return islands.concat({"spans": adapters.spans(spark, folder), "regions": adapters.regions(spark, folder)})


@query
def interval_head_tail(spark, folder):
    rows = adapters.spans(spark, folder).select("start", "end")
    return islands.concat({"head": islands.head(rows, 20), "tail": islands.tail(rows, 20)})


@query
def range_join(spark, folder):
    return joins.range_join(adapters.spans(spark, folder), adapters.regions(spark, folder), on=["key"])


@query
def range_join_tolerance(spark, folder):
    return joins.range_join(adapters.spans(spark, folder), adapters.regions(spark, folder), on=["key"], tolerance=5)


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.spans(spark, folder).withColumn("dataset", F.col("id") % 3)


def overlap_table(spark: SparkSession, folder: str) -> DataFrame:
    return compare.overlap_counts_single(datasets(spark, folder), ["dataset"], [], "id", inner_on=["key"])


@query
def overlap_counts(spark, folder):
    return rounded(overlap_table(spark, folder), "p_A", "p_B")


@query
def overlap_counts_two(spark, folder):
    a = adapters.spans(spark, folder).withColumn("part", F.col("id") % 3)
    b = adapters.regions(spark, folder).withColumn("part", F.col("id") % 2)
    return rounded(compare.overlap_counts(a, b, ["part"], ["part"], "id", inner_on=["key"]), "p_A", "p_B")


@query
def overlap_mapping_pivot(spark, folder):
    return compare.mapping_table(overlap_table(spark, folder), ["dataset"], [], values=["0", "1", "2"])


@query
def overlap_mapping_percentages(spark, folder):
    return compare.mapping_percentages(overlap_table(spark, folder), ["dataset"], [])


@query
def domain_compare(spark, folder):
    _, counts = compare.compare_domains(datasets(spark, folder), by=["dataset"], on=[], inner_on=["key"])
    return rounded(counts, "p_A", "p_B")


@query
def label_collapse(spark, folder):
    return compare.collapse_labels(overlap_table(spark, folder), ["dataset"], name="dataset_label", label=lambda c: F.concat(c, F.lit("/x"))).select("dataset_label_A", "dataset_label_B", "m_A")


@query
def chrom_natural_order(spark, folder):
    from pyspark.sql.window import Window

    rows = adapters.contacts(spark, folder).groupBy(F.col("chromosome_A").alias("graph")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("chrom_index", "graph")).cast("long")
    return rows.withColumn("chrom_index", chromosome_index("graph")).withColumn("place", place)


@query
def chrom_filters(spark, folder):
    return filter_contacts(adapters.contacts(spark, folder), min_petcount=25, chromosomes=["chr1", "chr2", "chr10"], interchromosomal=False)


@query
def bedpe_prepare(spark, folder):
    return prepared(spark, folder)


@query
def anchors_distinct(spark, folder):
    return graph.anchors(prepared(spark, folder), numbered=True).drop("chromosome")


@query
def nodes(spark, folder):
    return graph.nodes(graph.assign_nodes(graph.anchors(prepared(spark, folder)))).drop("chromosome")


@query
def nodes_one_each(spark, folder):
    placed = graph.assign_nodes(graph.anchors(prepared(spark, folder)), graph.one_node_each)
    return graph.nodes(placed).select("graph", "node_id", "start", "end")


@query
def edges(spark, folder):
    _, found = graph.build(prepared(spark, folder))
    return found.drop("is_contact", "is_strand", "weight")


@query
def edges_user_agg(spark, folder):
    _, found = graph.build(prepared(spark, folder), edge_aggs={"mean_petcount": F.avg("petcount")})
    return rounded(found.select("graph", "node_id_A", "node_id_B", "n_contacts", "mean_petcount"), "mean_petcount")


@query
def edges_holistic_agg(spark, folder):
    """Median and quartile of the counts of an edge's contacts, and how long they are by the middle one, beside plain columns."""
    own = {"median_petcount": graph.Holistic(graph.counted_quantile(0.5)), "q3_petcount": graph.Holistic(graph.counted_quantile(0.75)), "median_length": graph.Holistic(graph.counted_quantile(0.5), "length"), "mean_petcount": F.avg("petcount")}
    _, found = graph.build(prepared(spark, folder), edge_aggs=own)
    return rounded(found.select("graph", "node_id_A", "node_id_B", "n_contacts", "max_petcount", *own), *own)


@query
def strand_edges(spark, folder):
    found = graph.nodes(graph.assign_nodes(graph.anchors(prepared(spark, folder))))
    return graph.strand_edges(found).select("graph", "node_id_A", "node_id_B", "length")


@query
def fans(spark, folder):
    return stripes.fans(call(spark, folder).blades, 2, 50).drop("chromosome")


@query
def fan_span_clusters(spark, folder):
    found = call(spark, folder).blades.select("graph", "direction", "anchor_start").distinct()
    return spans.span_clusters(found, ["graph", "direction"], "anchor_start", 15000, "fan_cluster")


@query
def fan_sort_order(spark, folder):
    """All four answers: fans of a side by anchor, and intervals of small groups by id."""
    fans = spans.sort_order(stripes.fans(call(spark, folder).blades), ["graph", "direction"], "anchor_start", "anchor_start")
    rows = adapters.spans(spark, folder).withColumns({"graph": F.col("key").cast("string"), "direction": floor_div(F.col("id"), 200).cast("string")})
    return fans.unionByName(spans.sort_order(rows, ["graph", "direction"], "start", "id"))


@query
def loop_clusters(spark, folder):
    return call(spark, folder).loop_clusters.select("graph", "direction", "fan_cluster", "loop_cluster", "lc_idx", "stripe_id", "anchor_start", "anchor_end", "leafs_start", "leafs_end", "n_edges", "weight", "loop_count")


@query
def orthogonal_links(spark, folder):
    return call(spark, folder).links


@query
def lc_lengths_gaps(spark, folder):
    return rounded(call(spark, folder).loop_clusters.select("stripe_id", "lc_idx", "length", "gap_size", "orientation_score", "raw_gap_score"), "orientation_score", "raw_gap_score")


@query
def gap_quantile_knots(spark, folder):
    return rounded(call(spark, folder).knots, "q", "level")


@query
def gap_scores(spark, folder):
    found = call(spark, folder)
    return rounded(features.gap_scores(found.loop_clusters, found.knots).select("stripe_id", "lc_idx", "gap_score"), "gap_score")


@query
def stripe_scores(spark, folder):
    return rounded(call(spark, folder).scored.select("stripe_id", "lc_idx", "worst_gap_score", "stripe_score", "l_score"), "worst_gap_score", "stripe_score", "l_score")


@query
def cross_scores(spark, folder):
    return rounded(call(spark, folder).scored.select("stripe_id", "lc_idx", "w_score", "cross_score"), "w_score", "cross_score")


def table_of(df: DataFrame) -> DataFrame:
    return rounded(df, "stripe_score", "mean_cross_score")


@query
def stripes_raw(spark, folder):
    return table_of(call(spark, folder).raw)


@query
def stripes_trimmed(spark, folder):
    rows = refine.trim(call(spark, folder).scored, 20000, 4000000, 0.3)
    return table_of(refine.result(refine.summarise(rows)))


@query
def stripes_filtered(spark, folder):
    return table_of(refine.result(call(spark, folder).filtered))


@query
def stripes_merge_runs(spark, folder):
    return refine.merge_runs(call(spark, folder).filtered)


@query
def stripes_final(spark, folder):
    return table_of(call(spark, folder).final)


@query
def feature_describe(spark, folder):
    found = features.describe(call(spark, folder).loop_clusters, ["length", "gap_size", "loop_count"])
    return rounded(found, "mean", "std", "p1", "p5", "p25", "p50", "p75", "p95", "p99")


@query
def stripe_histogram(spark, folder):
    return features.histogram(call(spark, folder).loop_clusters, "length", 0.0, 10000000.0, 50, ("direction",))


@query
def stripe_counts(spark, folder):
    return viewdata.stripe_counts(call(spark, folder).raw)


@query
def viewer_export(spark, folder):
    return dialects.viewer_rows(call(spark, folder).raw, pad_w=10, pad_l=25)


@query
def bed_domains(spark, folder):
    return dialects.domain_rows(call(spark, folder).raw, pad_w=10, pad_l=25)


@query
def view_rectangles(spark, folder):
    found = viewdata.stripe_rectangles(call(spark, folder).raw, VIEW)
    return rounded(found.drop("chromosome_x", "chromosome_y", "direction"), "x_bin", "y_bin", "width_bins", "height_bins")


@query
def view_points(spark, folder):
    return rounded(viewdata.loops(adapters.contacts(spark, folder), VIEW).select("side", "x", "y", "x_bin", "y_bin"), "x_bin", "y_bin")


@query
def view_loop_clusters(spark, folder):
    found = call(spark, folder)
    rows = viewdata.loop_cluster_rectangles(found.scored.drop("chromosome"), found.raw, VIEW, "asis")
    return rounded(rows.select("stripe_id", "lc_idx", "start_x", "end_x", "start_y", "end_y", "score"), "score")


@query
def view_gap_segments(spark, folder):
    found = call(spark, folder)
    return viewdata.gap_segments(found.scored, found.raw, VIEW).drop("score")


@query
def view_matrix(spark, folder):
    return viewdata.contact_matrix(adapters.contacts(spark, folder), viewdata.View((0, 5000000), (0, 5000000), 50000, "chr1", "chr1"))


@query
def threeway_merge(spark, folder):
    t = lambda n: adapters.table(spark, folder, n)
    found = joins.merge_three(t("customer"), t("nation"), t("supplier"), ["n_nationkey"], ["n_nationkey"], ["c_nationkey"], ["s_nationkey"])
    return found.select("c_custkey", "c_nationkey", "n_nationkey", "n_regionkey", "n_name", "s_suppkey", "s_nationkey", "s_acctbal")


@query
def group_matching(spark, folder):
    a = adapters.table(spark, folder, "orders").select((F.col("o_custkey") % 997).alias("key"))
    b = adapters.table(spark, folder, "events").select((F.col("user_id") % 1009).alias("key"))
    return joins.match_groups(a, b, ["key"], "outer")


@query
def catalog_align(spark, folder):
    s = adapters.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("supplier/"), "s_suppkey").alias("path"))
    p = adapters.table(spark, folder, "part").select((F.col("p_partkey") * 3).alias("k"), F.concat(F.lit("part/"), "p_partkey").alias("path"))
    return joins.align({"supplier": s, "part": p}, ["k"])


@query
def interval_drop_empty(spark, folder):
    return islands.drop_empty(adapters.spans(spark, folder))


@query
def interval_sort(spark, folder):
    rows = islands.sort(adapters.spans(spark, folder), keys=["key"])
    return number_rows(rows, ["key", "start", "end", "id"], "place")


@query
def interval_sort_descending(spark, folder):
    """The order of all intervals from the far end, by what each follows."""
    from pyspark.sql.window import Window

    rows = islands.sort(adapters.spans(spark, folder), ascending=False)
    order = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("end"), "id")
    return rows.select("key", "id", F.lag("id").over(order).alias("after"))


@query
def interval_subset(spark, folder):
    rows = adapters.spans(spark, folder)
    taken = islands.subset(rows, [5, 3, 3, 77, 10**12, 9], "id").withColumn("how", F.lit("numbers"))
    masked = islands.subset(rows, F.col("key") < 7).withColumns({"place": F.lit(None).cast("long"), "how": F.lit("mask")})
    return taken.unionByName(masked)


@query
def interval_records(spark, folder):
    rows = adapters.spans(spark, folder)
    records = F.struct(F.concat(F.lit("chr"), "key"), F.col("id").cast("string"), F.col("start").cast("int"), F.col("end"))
    return islands.from_records(rows.select(F.when(F.col("id") % 5 > 0, records).alias("record")), "record", ["chromosome", "name"])


@query
def interval_accessors(spark, folder):
    rows = adapters.spans(spark, folder)
    return rows.groupBy("key").agg(F.count("start").alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.count_distinct("id").alias("ids"))


@query
def interval_global_islands(spark, folder):
    rows, keep = adapters.spans(spark, folder), ["key", "id", "island"]
    up = islands.global_islands(rows, ["key"], order=["id"]).select(*keep)
    down = islands.global_islands(rows, ["key"], order=["id"], ascending=False).select("id", F.col("island").alias("from_end"))
    return up.join(down, "id")


@query
def interval_merge_sorted(spark, folder):
    rows = islands.merge_sorted(adapters.spans(spark, folder), adapters.regions(spark, folder), ["key"])
    return number_rows(rows, ["key", "start", "end", "side"], "place")


@query
def unsorted_points(spark, folder):
    return spans.first_unsorted(adapters.spans(spark, folder).withColumn("part", floor_div(F.col("id"), 100)), ["part"], "id", "start")


@query
def unsorted_ranges(spark, folder):
    rows = adapters.spans(spark, folder).withColumns({"part": floor_div(F.col("id"), 50), "block": floor_div(F.col("start"), 5000)})
    return spans.first_unsorted(rows, ["part"], "id", "block", "end")


@query
def overlap_counts_threshold(spark, folder):
    counts = compare.overlap_counts_single(datasets(spark, folder), ["dataset"], [], "id", inner_on=["key"], tolerance=3, min_overlap=40)
    return rounded(counts, "p_A", "p_B")


@query
def overlap_counts_absent(spark, folder):
    """Datasets whose intervals lie far apart have rows with no overlap."""
    rows = adapters.spans(spark, folder).withColumn("dataset", floor_div(F.col("start"), 2000))
    return rounded(compare.overlap_counts_single(rows, ["dataset"], [], "id", inner_on=["key"], absent=True), "p_A", "p_B")


@query
def join_by_indices(spark, folder):
    a, b = adapters.spans(spark, folder).withColumnRenamed("id", "row_id"), adapters.regions(spark, folder).withColumnRenamed("id", "row_id")
    pairs = adapters.spans(spark, folder).select(F.col("id").alias("i"), (F.col("id") * 3 + 1).alias("j"))
    return joins.join_by_indices(a, b, pairs)


@query
def group_positions(spark, folder):
    return joins.group_members(adapters.spans(spark, folder), ["key"], "id")


@query
def nodes_sorted(spark, folder):
    found = graph.nodes(graph.assign_nodes(graph.anchors(prepared(spark, folder))))
    return number_rows(found.select("graph", "node_id", "max_length"), ["max_length", "graph", "node_id"], "place")


@query
def edges_with_strands(spark, folder):
    _, found = graph.build(prepared(spark, folder), strands=graph.add_strand_edges(2.0))
    return found.select("graph", "node_id_A", "node_id_B", "n_contacts", "total_petcount", "is_contact", "is_strand", "weight", "length")


@query
def graph_hooks(spark, folder):
    """A node of no contacts in each graph, and an edge from node 0 to it."""
    one = lambda d: d.select("graph").distinct().withColumns({"node_id": F.lit(-1).cast("long"), "chromosome": F.col("graph"), "start": F.lit(0).cast("long"), "end": F.lit(1).cast("long")})
    kinds = lambda d: {f.name: f.dataType.simpleString() for f in d.schema}
    more_nodes = lambda d: d.unionByName(graph.with_defaults(one(d), d.columns, kinds(d)))
    more_edges = lambda d: d.unionByName(graph.with_defaults(d.select("graph").distinct().withColumns({"node_id_A": F.lit(-1).cast("long"), "node_id_B": F.lit(0).cast("long")}), d.columns, kinds(d)))
    found, linked = graph.build(prepared(spark, folder), extra_nodes=more_nodes, extra_edges=more_edges)
    sides = found.groupBy("graph").agg(F.count("*").alias("nodes"), F.min("start").alias("first"), F.min("n_anchors").alias("least"))
    return sides.join(linked.groupBy("graph").agg(F.count("*").alias("edges"), F.sum("n_contacts").alias("contacts"), F.min("node_id_A").alias("low")), "graph")


@query
def stripe_histograms(spark, folder):
    return rounded(features.histograms(call(spark, folder).loop_clusters, ["length", "loop_count"]), "low", "high")


@query
def stripes_of_datasets(spark, folder):
    found = call(spark, folder)
    return compare.stripe_table({"raw": found.raw, "final": found.final}, ["dataset"]).groupBy("dataset", "chromosome", "direction").agg(F.count("*").alias("n"), F.min("anchor_start").alias("first"), F.sum("width").alias("width"))


@query
def stripes_compare(spark, folder):
    found = call(spark, folder)
    both = compare.stripe_table({"raw": found.raw, "final": found.final}, ["dataset"])
    _, counts = compare.compare_stripes(both, by=["dataset"], on=[], tolerance=1000)
    return rounded(counts, "p_A", "p_B")


@query
def view_regions(spark, folder):
    rows = call(spark, folder).raw.select("stripe_id", F.col("chromosome").alias("chromosome_x"), F.col("anchor_start").alias("start_x"), F.col("anchor_end").alias("end_x"), F.col("chromosome").alias("chromosome_y"), F.col("start").alias("start_y"), F.col("end").alias("end_y"))
    return viewdata.regions(rows, VIEW, "lower").select("stripe_id", "start_x", "end_x", "start_y", "end_y")


@query
def view_rectangles_padded(spark, folder):
    found = viewdata.stripe_rectangles(call(spark, folder).raw, VIEW, "asis", pad_w=2500, pad_l=7000)
    return found.select("stripe_id", "start_x", "end_x", "start_y", "end_y")


@query
def view_labels(spark, folder):
    found = call(spark, folder)
    return viewdata.stripe_labels(found.scored, found.raw)


@query
def view_colour_limit(spark, folder):
    return rounded(viewdata.colour_limit(view_matrix(spark, folder)), "limit")
