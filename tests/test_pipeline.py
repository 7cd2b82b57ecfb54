import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.helpers import CONTACT_SCHEMA, EDGES_20, EDGES_21, START_20, START_21, example_contacts
from weftspan.operators import graph, refine
from weftspan.plans.pipeline import Params, StripeCaller


@pytest.fixture(scope="module")
def call(spark):
    return StripeCaller().start(spark.createDataFrame(example_contacts(), CONTACT_SCHEMA))


def test_nodes_and_edges(call):
    nodes = {(r.graph, r.node_id): (r.start, r.end, r.n_anchors) for r in call.nodes.collect()}
    want = {("chr20", i): (s, s + 5000, 1) for i, s in enumerate(START_20)} | {("chr21", i): (s, s + 5000, 1) for i, s in enumerate(START_21)}
    assert nodes == want
    edges = {(r.graph, r.node_id_A, r.node_id_B): r.n_contacts for r in call.edges.collect()}
    assert edges == {("chr20", *k): n for k, n in EDGES_20.items()} | {("chr21", *k): n for k, n in EDGES_21.items()}


def test_loop_clusters_and_scores(call):
    rows = {(r.stripe_id, r.lc_idx): r for r in call.scored.collect()}
    want = {
        (0, 0): (20001, 35001, 3, 25000, 10000, 0.397940, 0.549020), (0, 1): (50001, 55001, 1, 45000, 15000, 0.477121, 0.745098),
        (0, 2): (70001, 85001, 4, 75000, 15000, 0.698970, 0.912795), (0, 3): (100001, 105001, 1, 95000, 15000, 0.801632, 1.0),
        (1, 0): (70001, 75001, 1, 25000, 20000, 0.096910, 0.362056), (2, 0): (10001, 25001, 3, 25000, 10000, 0.397940, 0.549020),
        (3, 0): (10001, 15001, 1, 45000, 40000, 0.051153, 0.180159), (4, 0): (50001, 55001, 1, 35000, 30000, 0.066947, 0.271383),
        (4, 1): (10001, 25001, 4, 75000, 25000, 0.477121, 0.745098), (5, 0): (20001, 25001, 1, 85000, 80000, 0.026329, 0.0),
        (6, 0): (80001, 85001, 2, 55000, 50000, 0.041393, 0.092741), (7, 0): (30001, 45001, 2, 55000, 40000, 0.138303, 0.451651),
    }
    assert set(rows) == set(want)
    for k, v in want.items():
        r = rows[k]
        assert (r.leafs_start, r.leafs_end, r.n_edges, r.length, r.gap_size) == v[:5], k
        assert r.raw_gap_score == pytest.approx(v[5], abs=1e-6) and r.gap_score == pytest.approx(v[6], abs=1e-6), k
    assert {r.direction for r in rows.values() if r.stripe_id in (0, 1, 6)} == {"R"}


def test_final_table(call):
    rows = sorted(call.final.collect(), key=lambda r: r.direction)
    assert call.final.columns == list(refine.RESULT)
    assert [tuple(r)[:13] for r in rows] == [("chr20", "L", 4, 70001, 85001, 15000, 10001, 85001, 75000, 2, 2, 3, 5), ("chr20", "R", 0, 10001, 25001, 15000, 10001, 105001, 95000, 2, 4, 6, 9)]
    assert rows[0].stripe_score == pytest.approx(0.560723, abs=1e-6) and rows[0].mean_cross_score == pytest.approx(0.816282, abs=1e-6)
    assert rows[1].stripe_score == pytest.approx(0.820029, abs=1e-6) and rows[1].mean_cross_score == pytest.approx(100.0)


def test_fixed_scores_use_both_directions(spark):
    call = StripeCaller(Params(compat="fixed")).start(spark.createDataFrame(example_contacts(), CONTACT_SCHEMA))
    assert all(r.w_score > 0 or r.gap_score >= 0 for r in call.scored.collect())
    assert any(r.direction == "R" and r.w_score > 0 for r in call.scored.collect())


def test_empty_input_and_self_loops(spark):
    empty = StripeCaller().full_pipeline(spark.createDataFrame([], CONTACT_SCHEMA))
    assert empty.count() == 0 and empty.columns == list(refine.RESULT)
    loops = StripeCaller().full_pipeline(spark.createDataFrame([("chr1", 10, 20, "chr1", 12, 22)], CONTACT_SCHEMA))
    assert loops.count() == 0


def test_interchromosomal_rows(spark):
    rows = spark.createDataFrame([*example_contacts(), ("chr20", 1000, 2000, "chr21", 90000, 91000)], CONTACT_SCHEMA)
    assert StripeCaller().full_pipeline(rows).count() == 2
    with pytest.raises(Exception, match="between chromosomes"):
        graph.within_chromosomes(rows, strict=True).collect()


def test_both_orientations_count_twice(spark):
    rows = [("chr1", 10000, 12000, "chr1", 50000, 52000), ("chr1", 50000, 52000, "chr1", 10000, 12000), ("chr1", 10000, 12000, "chr1", 50000, 52000)]
    call = StripeCaller().start(spark.createDataFrame(rows, CONTACT_SCHEMA))
    assert {(r.node_id_A, r.node_id_B): r.n_contacts for r in call.edges.collect()} == {(0, 1): 2, (1, 0): 1}
    assert {(r.direction, r.n_edges, r.loop_count) for r in call.loop_clusters.collect()} == {("R", 2, 4), ("L", 2, 4)}


def stripe(graph_, sid, anchor, length):
    return (graph_, "R", sid, anchor, anchor + 5000, anchor, anchor + length)


def test_merge_runs(spark):
    rows = [stripe("chr1", 0, 1, 30000), stripe("chr1", 1, 20001, 50000), stripe("chr1", 2, 90001, 40000), stripe("chr2", 3, 1, 30000)]
    df = spark.createDataFrame(rows, "graph string, direction string, stripe_id long, anchor_start long, anchor_end long, start long, end long")
    kept = {r.stripe_id: r.run_id for r in refine.merge_runs(df).collect()}
    assert kept == {0: 0, 1: 0, 3: 3}
    assert {r.stripe_id: r.run_id for r in refine.merge_runs(df, compat="fixed").collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def scored_rows(spark, direction):
    rows = [("chr1", direction, 7, i, 30000 * (i + 1), 0.9 - 0.3 * i) for i in range(3)] + [("chr1", direction, 8, 0, 90000, 0.1)]
    return spark.createDataFrame(rows, "graph string, direction string, stripe_id long, lc_idx int, length long, worst_gap_score double")


def test_trim(spark):
    kept = lambda rows: sorted((r.stripe_id, r.lc_idx) for r in rows.collect())
    assert kept(refine.trim(scored_rows(spark, "L"), gap_threshold=0.5)) == [(7, 0), (7, 1)]
    assert kept(refine.trim(scored_rows(spark, "L"), max_length=70000)) == [(7, 0), (7, 1)]
    assert len(kept(refine.trim(scored_rows(spark, "R"), gap_threshold=0.5))) == 4
    assert len(kept(refine.trim(scored_rows(spark, "L")))) == 4


def test_merge_renumbers_and_keeps_scores(spark):
    rows = [("chr1", d, s, i, leaf, s + i / 10) for d, sign in (("R", 1), ("L", -1)) for s, i, leaf in ((1, 0, 500), (1, 1, 700), (2, 0, 600), (2, 1, 700))]
    df = spark.createDataFrame(rows, "graph string, direction string, stripe_id long, lc_idx int, leafs_start long, stripe_score double")
    runs = spark.createDataFrame([("chr1", d, s, 1) for d in "RL" for s in (1, 2)], "graph string, direction string, stripe_id long, run_id long")
    got = {(r.direction, r.lc_idx): (r.stripe_id, r.stripe_score) for r in refine.merge(df, runs).collect()}
    assert [got["R", i] for i in range(4)] == [(1, 1.0), (1, 2.0), (1, 1.1), (1, 2.1)]
    assert [got["L", i] for i in range(4)] == [(1, 1.1), (1, 2.1), (1, 2.0), (1, 1.0)]


def test_merge_runs_in_pieces_is_the_plain_fold(spark, monkeypatch):
    """Cuts lie only where nothing can merge: the same runs as one walk through each chromosome, whatever the blocks."""
    rng, rows, sid = random.Random(8), [], 0
    for graph_ in ("chr1", "chr2", "chr10"):
        for direction in "RL":
            at = 0
            for _ in range(120):
                at += rng.choice((2000, 6000, 20000, 70000, 200000))
                width, length = rng.choice((4000, 10000, 30000)), rng.choice((30000, 60000, 400000))
                rows.append((graph_, direction, sid, at, at + width, *((at, at + length) if direction == "R" else (at + width - length, at + width))))
                sid += rng.choice((1, 1, 1, 5))
    df = spark.createDataFrame(rows, "graph string, direction string, stripe_id long, anchor_start long, anchor_end long, start long, end long")
    for threshold in (0, 5000):
        want, run = {}, None
        for g, d, i, x0, x1, y0, y1 in rows:
            if run and run[:2] == (g, d) and run[4] - x0 <= threshold and x1 - run[3] <= 80000 and abs((y1 - y0) - (run[6] - run[5])) <= 200000:
                a0, a1 = min(run[3], x0), max(run[4], x1)
                run = (g, d, run[2], a0, a1, *((a0, max(run[6], y1)) if d == "R" else (min(run[5], y0), a1)))
            else:
                run = (g, d, i, x0, x1, y0, y1)
            want[i] = run[2]
        for block in (1 << 14, 7, 1):
            monkeypatch.setattr(refine, "BLOCK", block)
            assert {r.stripe_id: r.run_id for r in refine.merge_runs(df, threshold, compat="fixed").collect()} == want, (threshold, block)
    sizes = [r["count"] for r in refine.pieces(df, 0).groupBy("piece").count().collect()]
    assert len(sizes) > 60 and max(sizes) < 60


def test_holistic_aggregates(spark):
    """Medians of counts and lengths beside plain columns, against statistics; edges that batches cut are whole."""
    rng, rows = random.Random(3), []
    for _ in range(900):
        a, b = sorted(rng.sample(range(5), 2))
        rows.append(("chr1", a * 20000, a * 20000 + 900, "chr1", b * 20000, b * 20000 + rng.choice((900, 5900)), rng.choice((1, 2, 3, 9, None))))
    df = graph.prepare(spark.createDataFrame(rows, CONTACT_SCHEMA + ", petcount long"))
    own = {"median": graph.Holistic(graph.counted_quantile(0.5)), "middle_length": graph.Holistic(graph.counted_quantile(0.5), "length"), "modes": graph.Holistic(lambda v, n: int((n == n.max()).sum()), kind="long"), "sum": F.sum("petcount")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    _, found = graph.build(df, edge_aggs=own)
    got = {(r.chromosome_A_, r.chromosome_B_): r for r in found.select("*", F.col("node_id_A").alias("chromosome_A_"), F.col("node_id_B").alias("chromosome_B_")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    starts = sorted({r[1] for r in rows} | {r[4] for r in rows})
    by = {}
    for r in df.collect():
        by.setdefault((r.start_A, r.start_B), []).append(r)
    assert len(got) == 10 and sum(r.n_contacts for r in got.values()) == 900 and len(starts) == 5
    for r in got.values():
        mine = [x for (a, b), v in by.items() for x in v if sorted({k[0] for k in by} | {k[1] for k in by}).index(a) == r.node_id_A and sorted({k[0] for k in by} | {k[1] for k in by}).index(b) == r.node_id_B]
        counts = [x.petcount for x in mine if x.petcount is not None]
        assert r["median"] == statistics.median(counts) and r["sum"] == sum(counts) and r.n_contacts == len(mine)
        assert r.middle_length == statistics.median(abs(x.start_A - x.start_B + x.end_A - x.end_B) // 2 for x in mine)
        most = max(counts.count(v) for v in set(counts))
        assert r.modes == sum(counts.count(v) == most for v in set(counts))


def test_edges_have_one_exchange_after_bin_pairs(spark):
    """Anchors and nodes are sent where they are few, else both sides are shuffled; the result is the same."""
    df = graph.prepare(spark.createDataFrame(example_contacts(), CONTACT_SCHEMA))
    _, found = graph.build(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 2
    before, graph.SENT_ROWS = graph.SENT_ROWS, -1
    try:
        _, other = graph.build(df)
        flat = lambda d: sorted(map(tuple, d.collect()))
        assert flat(other) == flat(found)
    finally:
        graph.SENT_ROWS = before
