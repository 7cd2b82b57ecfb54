import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import island_model, span_model
from weftspan.functions import chromosomes
from weftspan.functions.intervals import Interval, bin_coords, format_columns, parse_intervals, require_integers, require_valid
from weftspan.operators import islands, joins, spans

PAIR = "s1 long, e1 long, s2 long, e2 long"


def one(spark, row, schema, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


@pytest.mark.parametrize(("row", "want"), [((-7, 3), (-4, 2)), ((0, 0), (0, 1)), ((-1, -1), (-1, 0)), ((4, 9), (2, 5))])
def test_bins_floor_below_zero(spark, row, want):
    assert one(spark, row, "start long, end long", *Interval.of().bin_indices(2).columns()) == want
    with pytest.raises(ValueError):
        bin_coords(F.lit(1), 0)


def test_large_coordinates_stay_exact(spark):
    big = 2**61 + 1
    assert one(spark, (big, big + 2), "start long, end long", Interval.of().center(), bin_coords(F.col("start"), 2)) == (big + 1, 2**60)


def test_expand_clip_split(spark):
    row, schema = (10, 15), "start long, end long"
    assert one(spark, row, schema, *Interval.of().expand(-20, -5).columns()) == (15, 15)
    assert one(spark, row, schema, *Interval.of().clip(12, 13).columns()) == (12, 13)
    assert one(spark, row, schema, *Interval.of().clip(right=5).columns()) == (5, 5)
    with pytest.raises(ValueError):
        Interval.of().clip(5, 4)
    left, right = Interval.of().split_at_ratio(0.5)
    assert one(spark, row, schema, *left.columns("a", "b"), *right.columns("c", "d")) == (10, 12, 12, 15)  # 2.5 goes to 2
    left, right = Interval.of().split_at_ratio(0.5)
    assert one(spark, (10, 17), schema, *left.columns("a", "b"), *right.columns("c", "d")) == (10, 14, 14, 17)  # 3.5 goes to 4
    left, right = Interval.of().split_at_length(-2)
    assert one(spark, row, schema, *left.columns("a", "b"), *right.columns("c", "d")) == (10, 13, 13, 15)


def test_two_intervals(spark):
    A, B = Interval.of("s1", "e1"), Interval.of("s2", "e2")
    apart, touch = (1, 5, 9, 12), (1, 5, 5, 9)
    left, right = A.unite(B)
    assert one(spark, apart, PAIR, *left.columns("a", "b"), *right.columns("c", "d")) == (1, 5, 9, 12)
    assert one(spark, touch, PAIR, *left.columns("a", "b"), *right.columns("c", "d")) == (1, 9, 9, 9)
    assert one(spark, apart, PAIR, A.offset(B), A.distance(B), A.overlap(B), A.is_separated_from(B)) == (4, 4, 0, True)
    assert one(spark, touch, PAIR, A.offset(B), A.intersects(B), A.is_separated_from(B)) == (0, False, False)
    assert one(spark, (1, 9, 3, 5), PAIR, A.contains(B), B.is_contained_in(A), A.overlap(B), A.offset(B)) == (True, True, 2, -4)
    assert one(spark, (1, 9, 9, 9), PAIR, A.contains(B), A.is_superset_of(B), B.is_subset_of(A)) == (False, True, True)
    assert one(spark, (4, 4, 4, 4), PAIR, A.contains(B), A.equals(B), A.differs(B), A.contains(F.lit(4))) == (True, True, False, True)
    assert one(spark, apart, PAIR, *A.intersect(B).columns("a", "b"), *A.gap_between(B).columns("c", "d")) == (9, 9, 5, 9)


def test_text(spark):
    df = spark.createDataFrame([("chr1", 5, 9)], "chromosome string, start long, end long")
    assert df.select(Interval.of().to_string("chromosome")).first()[0] == "chr1:5-9"
    assert df.select(format_columns("{{x}} {chromosome}|{start:04d}")).first()[0] == "{x} chr1|0005"
    (name,), i = parse_intervals("t")
    assert one(spark, ("chrX:7-11",), "t string", name, *i.columns()) == ("chrX", 7, 11)
    for bad in ("chr1:5", "chr1:5-", "chr1:2:5-6"):
        with pytest.raises(Exception, match="not in parts"):
            one(spark, (bad,), "t string", name, *i.columns())


def test_validation(spark):
    df = spark.createDataFrame([(5, 4)], "start long, end long")
    with pytest.raises(TypeError):
        require_integers(df.withColumn("start", F.col("start").cast("double")), "start")
    with pytest.raises(Exception, match="ends before it starts"):
        require_valid(df).collect()


def test_chromosomes(spark):
    names = ["chr10", "chr2", "X", "chrM", "chrY", "scaffold", "chr1"]
    df = spark.createDataFrame([(n,) for n in names], "c string").orderBy(chromosomes.chromosome_index("c"), "c")
    assert [r.c for r in df.collect()] == ["chr1", "chr2", "chr10", "X", "chrY", "chrM", "scaffold"]
    assert one(spark, ("7",), "c string", chromosomes.chromosome_label("c"), chromosomes.strip_prefix(F.lit("chr7"))) == ("chr7", "7")


EDGES = [(1, 5), (5, 9), (9, 12), (12, 12), (12, 12), (20, 40), (21, 22), (30, 30), (39, 41), (41, 50), (-7, -3), (-4, 0)]


@pytest.mark.parametrize("tile", [None, 3, 10, 1000])
def test_islands(spark, tile):
    rng = random.Random(4)
    groups = {"edges": EDGES, "random": [(s, s + rng.randrange(12)) for s in (rng.randrange(-200, 200) for _ in range(150))], None: [(1, 3), (2, 5)]}
    rows = [(k, s, e) for k, v in groups.items() for s, e in v]
    got = islands.islands(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], tile=tile).collect()
    for k, v in groups.items():
        assert sorted(((r.start, r.end), r.island) for r in got if r.k == k) == sorted(island_model(v)), (k, tile)


def test_set_operations(spark):
    df = spark.createDataFrame([("a", s, e) for s, e in EDGES], "k string, start long, end long")
    other = spark.createDataFrame([("a", 4, 21), ("b", 1, 2)], "k string, start long, end long")
    flat = lambda d: sorted(tuple(r) for r in d.collect())
    assert flat(islands.union_self(df, ["k"])) == [("a", -7, 0), ("a", 1, 5), ("a", 5, 9), ("a", 9, 12), ("a", 12, 12), ("a", 12, 12), ("a", 20, 41), ("a", 41, 50)]
    assert ("b", 1, 2) in flat(islands.union_other(df, other, ["k"]))
    assert flat(islands.intersect_other(df, other, ["k"])) == [("a", 4, 5), ("a", 5, 9), ("a", 9, 12), ("a", 12, 12), ("a", 12, 12), ("a", 20, 21)]
    assert flat(islands.is_disjoint(df, ["k"])) == [("a", False)]
    assert flat(islands.hull(df.limit(0))) == [(0, 0, 0)]
    assert [r.start for r in islands.tail(df, 2).collect()] == [39, 41] and islands.head(df, 0).count() == 0
    numbered = islands.global_islands(df.unionByName(other), ["k"])
    assert max(r.island for r in numbered.filter("k = 'a'").collect()) + 1 == numbered.filter("k = 'b'").first().island
    assert islands.drop_empty(df).count() == len(EDGES) - 3
    assert [r.side for r in islands.merge_sorted(df.limit(1), df.limit(1), ["k"]).collect()] == [0, 1]


def brute_pairs(a, b, t=0):
    import math

    out = []
    for i, (k, s, e) in enumerate(a):
        s2, e2 = min(s - math.ceil(t / 2), e), None
        e2 = max(e + math.ceil(t / 2), s2)
        for j, (m, x, y) in enumerate(b):
            x2 = min(x - t // 2, y)
            y2 = max(y + t // 2, x2)
            if k == m and s2 < y2 and x2 < e2:
                out.append((i, j, -max(x - e, s - y)))
    return sorted(out)


@pytest.mark.parametrize("tolerance", [0, 5, 40])
def test_range_join(spark, tolerance):
    rng = random.Random(tolerance)
    make = lambda n: [(rng.choice("xy"), s, s + rng.choice([0, 1, 3, 30])) for s in (rng.randrange(-300, 300) for _ in range(n))]
    a, b = make(120), make(100)
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, start long, end long")
    for width in (None, 1, 7, 1000):
        got = joins.range_join(frame(a), frame(b), on=["k"], tolerance=tolerance, width=width)
        assert sorted((r.id_A, r.id_B, r.overlap) for r in got.collect()) == brute_pairs(a, b, tolerance), width
    assert joins.range_join(frame(a).limit(0), frame(b), on=["k"]).count() == 0


@pytest.mark.parametrize("gap", [0, 3, 25])
def test_span_clusters(spark, gap):
    rng = random.Random(gap)
    groups = {"a": [0, 10000, 20000, 30000], "b": [rng.randrange(400) for _ in range(300)], "c": [5], None: [7, 7, 90]}
    df = spark.createDataFrame([(k, p) for k, v in groups.items() for p in v], "k string, p long")
    got = spans.span_clusters(df, ["k"], "p", gap).collect()
    for k, v in groups.items():
        assert sorted((r.p, r.cluster_start) for r in got if r.k == k) == list(zip(sorted(v), span_model(sorted(v), gap))), k
    wide = spans.span_clusters(df.filter("k = 'a'"), ["k"], "p", 15000).collect()
    assert sorted((r.p, r.cluster_start) for r in wide) == [(0, 0), (10000, 0), (20000, 20000), (30000, 20000)]


def test_sort_order(spark):
    rows = [("up", 1, 1), ("up", 2, 1), ("up", 3, 4), ("down", 1, 3), ("down", 2, 2), ("flat", 1, 2), ("flat", 2, 2), ("none", 1, 2), ("none", 2, 5), ("none", 3, 1)]
    df = spark.createDataFrame(rows, "k string, i long, p long")
    assert {r.k: r.order for r in spans.sort_order(df, ["k"], "p", "i").collect()} == {"up": "Ascending", "down": "Descending", "flat": "Constant", "none": "Unsorted"}
    assert {r.k: r.at for r in spans.first_unsorted(df, ["k"], "i", "p").collect()} == {"up": None, "down": 2, "flat": None, "none": 3}


def test_three_tables_and_alignment(spark):
    left = spark.createDataFrame([(1, "l"), (2, "m")], "id long, v string")
    mid = spark.createDataFrame([(10, 1, 5), (11, 3, 6)], "id long, l long, r long")
    right = spark.createDataFrame([(5, "r")], "id long, v string")
    inner = joins.merge_three(left, mid, right, ["l"], ["r"], ["id"], ["id"])
    assert inner.columns == ["id_left", "v_left", "id", "l", "r", "id_right", "v_right"] and inner.count() == 1
    assert joins.merge_three(left, mid, right, ["l"], ["r"], ["id"], ["id"], inner=False).count() == 2
    a = spark.createDataFrame([(1, "p1")], "k long, path string")
    b = spark.createDataFrame([(2, "p2")], "k long, path string")
    assert [tuple(r) for r in joins.align({"a": a, "b": b}, ["k"]).collect()] == [(1, "p1", ""), (2, "", "p2")]
    rows = spark.createDataFrame([(0, "x"), (1, "y")], "row_id long, v string")
    pairs = spark.createDataFrame([(0, 1), (1, 1)], "i long, j long")
    assert sorted((r.v_A, r.v_B) for r in joins.join_by_indices(rows, rows, pairs).collect()) == [("x", "y"), ("y", "y")]


def _many(seed=1, n=6000):
    """Nine rows in ten of one group, half of all starts in a narrow place, one far out, one below; some null keys."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        start = int(rng.integers(5000, 9000) if i % 2 else rng.integers(0, 10**9))
        rows.append(("hot" if i % 10 else [None, "b", "c"][i // 10 % 3], start, start + int(rng.integers(0, 40))))
    return [*rows, ("hot", 10**15, 10**15 + 1), ("hot", -(10**14), 0)]


@pytest.mark.parametrize(("levels", "rows"), [(10, 1 << 15), (3, 1 << 15), (3, 50), (1, 1)])
def test_islands_by_ranges_match_one_walk(spark, monkeypatch, levels, rows):
    monkeypatch.setattr(islands, "LEVELS", levels)
    monkeypatch.setattr(islands, "RANGE_ROWS", rows)
    data = _many(n=1500)
    df = spark.createDataFrame(data, "k string, start long, end long")
    got = {}
    for r in islands.islands(df, ["k"]).collect():
        got.setdefault(r.k, []).append(((r.start, r.end), r.island))
    want = {k: sorted(island_model([(s, e) for x, s, e in data if x == k])) for k in ("hot", "b", "c", None)}
    assert {k: sorted(v) for k, v in got.items()} == want
    hulls = {}
    for k, v in want.items():
        for (s, e), i in v:
            a, b = hulls.get((k, i), (s, e))
            hulls[k, i] = (min(a, s), max(b, e))
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted(map(tuple, islands.union_self(df, ["k"]).collect()), key=key) == sorted(((k, *h) for (k, _), h in hulls.items()), key=key)


def test_no_range_has_much_more_than_its_part(spark):
    """One start at 10**15 and a group with nine rows in ten leave ranges even, and so the tasks they are dealt to."""
    df = spark.createDataFrame(_many(), "k string, start long, end long")
    sizes = [r["count"] for r in islands.with_range(df, "range").groupBy("range").count().collect()]
    assert len(sizes) > 900 and max(sizes) <= 25  # six rows each on average
    tasks = [r["count"] for r in islands._ranged(df, ["k"], "start", None).repartition(8, "_by").groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < 2 * sum(tasks) / 8


def test_range_joins_run_nothing_early(spark):
    """Classes of lengths are looked up when the join runs."""
    df = spark.range(5).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("early", "")
    pairs = joins.overlapping_pairs(df, df.withColumnsRenamed({"a": "c", "b": "d"}), ("a", "b"), ("c", "d"))
    assert not tracker.getJobIdsForGroup("early")
    spark.sparkContext.setJobGroup("other", "")
    assert pairs.count() == 5 + 2 * (4 + 3)
    assert joins.overlapping_pairs(df.limit(0), df.withColumnsRenamed({"a": "c", "b": "d"}), ("a", "b"), ("c", "d")).count() == 0
