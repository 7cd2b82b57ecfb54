"""Cases that results of larger tables brought up."""

import numpy as np
from pyspark.sql import functions as F

from weftspan.llm import hamming
from weftspan.operators import compare, features, joins, matrix
from weftspan.plans import io_queries
from weftspan.sources import bedpe
from weftspan.streaming import ingest

CONTACTS = "chromosome_A string, start_A long, end_A long, chromosome_B string, start_B long, end_B long, petcount long"


def test_three_way_merge_of_few_keys_is_dealt_to_many_tasks(spark, monkeypatch):
    left = spark.range(60, numPartitions=1).select("id", (F.col("id") % 2).alias("k"))
    mid = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, name string").coalesce(1)
    right = spark.range(40, numPartitions=1).select("id", (F.col("id") % 2).alias("k"))
    want = sorted((n, a, b) for k, n in enumerate("ab") for a in range(k, 60, 2) for b in range(k, 40, 2))
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    for most in (1000, 0):  # the right side is sent to all executors, or dealt out too
        monkeypatch.setattr(joins, "SENT_ROWS", most)
        for inner in (True, False):
            got = joins.merge_three(left, mid, right, ["k"], ["k"], ["k"], ["k"], inner)
            rows = [(r.name, r.id_left, r.id_right) for r in got.collect()]
            assert sorted(r for r in rows if r[0] != "c") == want
            assert [r for r in rows if r[0] == "c"] == ([] if inner else [("c", None, None)])
            assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_domains_that_begin_at_one_place_count_each(spark):
    rows = [("x", "c", 5, 5), ("x", "c", 5, 9), ("y", "c", 3, 10)]
    _, counts = compare.compare_domains(spark.createDataFrame(rows, "run string, chromosome string, start long, end long"), by=["run"], on=[], inner_on=["chromosome"])
    table = {(r.run_A, r.run_B): (r.m_A, r.m_B, r.n_A, r.n_B) for r in counts.collect()}
    assert table == {("x", "x"): (1, 1, 2, 2), ("x", "y"): (1, 1, 2, 1), ("y", "x"): (1, 1, 1, 2), ("y", "y"): (1, 1, 1, 1)}


def test_knots_of_no_values(spark):
    none = spark.createDataFrame([], "raw_gap_score double")
    assert [tuple(r) for r in features.quantile_knots(none).collect()] == [(None, 0.0)]
    one = spark.createDataFrame([(2.0,), (2.0,)], "raw_gap_score double")
    assert [tuple(r) for r in features.quantile_knots(one).collect()] == [(2.0, 0.0)]


def test_region_to_the_end_of_chromosomes(spark, tmp_path):
    rows = [("chr2", 0, 20, "chr1", 10000000, 10000020, 2), ("chr1", 40, 60, "chr2", 99999980, 99999990, 3)]
    matrix.write_pyramid(spark.createDataFrame(rows, CONTACTS), f"{tmp_path}/pyramid", [100])
    got = matrix.region(spark, f"{tmp_path}/pyramid", ("chr2", 0, None), ("chr1", 0, None)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 100000, 2.0), (999999, 0, 3.0)]


def test_cells_ask_for_places_by_the_contacts_own_columns(spark):
    found = matrix.cells(spark.createDataFrame([], CONTACTS), 50000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("div" in line or "pmod" in line for line in filters)


def test_windows_compare_only_cells_near_them(spark, tmp_path):
    path = f"{tmp_path}/pyramid"
    rows = [("chr1", 100 * i, 100 * i + 2, "chr1", 100 * j, 100 * j + 2, 1) for i in range(40) for j in range(i, 40)]
    matrix.write_pyramid(spark.createDataFrame(rows, CONTACTS), path, [100])
    spots = [(i, "chr1", 100 * a, 100 * b + 99) for i, (a, b) in enumerate((a, a + w) for w in (0, 1, 2, 6) for a in range(0, 33))]
    found = matrix.regions(spark, path, spark.createDataFrame(spots, "id long, chromosome string, start long, end long"), 100)
    got = {r.id: r.n for r in found.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: ((e - s) // 100 + 1) * ((e - s) // 100 + 2) // 2 for i, _, s, e in spots}
    join = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert "x_block" in join and "y_block" in join


def test_first_rows_and_skipped_lines_of_a_text_in_parts(spark, tmp_path):
    (tmp_path / "text").mkdir()
    row = lambda i: f"1\t{i}\t{i + 5}\t2\t{i}\t{i + 7}\t3\n"
    parts = ["# said\n# more\n", "a\tb\tc\td\te\tf\tcount\n" + row(0), "".join(row(i) for i in range(1, 4)), "".join(row(i) for i in range(4, 400)), row(400)]
    for i, part in enumerate(parts):  # the longest part is the one that Spark reads first
        (tmp_path / "text" / f"part-{i:05d}").write_text(part)
    path = f"{tmp_path}/text"
    starts = lambda *a, **k: [r.start_A for r in bedpe.read_contacts(spark, path, *a, **k).collect()]
    assert sorted(starts()) == list(range(401))
    assert sorted(starts(nrows=6)) == list(range(6)) and sorted(starts(nrows=300)) == list(range(300))
    (tmp_path / "text" / "part-00000").write_text("x\ty\tz\n" + row(900))
    (tmp_path / "text" / "part-00001").write_text(row(0))
    assert sorted(starts(skiprows=1, petcount_col=6)) == [*range(401), 900]
    assert sorted(starts(skiprows=2, petcount_col=6, nrows=3)) == [0, 1, 2]


def test_texts_are_written_by_many_tasks(spark, tmp_path):
    lines = spark.range(100, numPartitions=5).select(F.concat_ws("\t", F.lit("1"), "id", "id", F.lit("2"), "id", "id").alias("value"))
    io_queries.written(spark, lines, ["# first"], ["# last"], f"{tmp_path}/parts")
    io_queries.headed(lines, ["one", "two"], f"{tmp_path}/headed")
    parts, headed = (sorted(p.read_text().splitlines() for p in (tmp_path / d).glob("part-*")) for d in ("parts", "headed"))
    assert len(parts) == 7 and len(headed) == 5 and {tuple(p[:2]) for p in headed} == {("one", "two")}
    assert sum(len(p) for p in parts) == 102 and sum(len(p) for p in headed) == 110


def test_probes_stay_near_the_kth_neighbour(spark, monkeypatch):
    """Ten thousand random codes: probes of all radii are few for each query, and results as by brute force."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (10000, 64))
    df = spark.createDataFrame([(i, [float(x) for x in 2 * v - 1]) for i, v in enumerate(bits)], "vec_id long, embedding array<double>").coalesce(4)
    made, wider = [], hamming._wider

    def counted(probes):
        made.append(wider(probes).cache())
        return made[-1]

    monkeypatch.setattr(hamming, "_wider", counted)
    got = {}
    for r in hamming.top_k(df, df.filter("vec_id % 1000 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    for q in range(0, 10000, 1000):
        apart = (bits != bits[q]).sum(axis=1)
        assert [x[1:] for x in sorted(got[q])] == [(int(apart[i]), int(i)) for i in np.lexsort((np.arange(10000), apart))[:10]]
    assert sum(m.count() for m in made) < 1500 * 10


def test_overlap_counts_make_no_pairs_and_count_alike(spark):
    """Random sets with empty and inverted intervals and repeated ids: as the counts of the range join's pairs."""
    rng = np.random.default_rng(8)

    def table(n, seed):
        rows = [(int(k), int(i), int(d), int(s), int(s + e)) for k, i, d, s, e in zip(rng.integers(0, 3, n), rng.integers(0, n, n), rng.integers(0, 4, n), rng.integers(-50, 400, n), rng.integers(-3, 30, n), strict=True)]
        return spark.createDataFrame([*rows, (None, 1, 1, 0, 9), (0, 2, None, 0, 9), (0, 3, 1, None, 9), (0, 4, 3, 5000, 9000)], "key long, id long, d long, start long, end long")

    a, b = table(150, 1), table(90, 2)
    flat = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for tolerance, least, absent in ((0, 0, False), (3, 12, True), (1, 0, False), (5, -2, True)):
        pairs = joins.merge_ranges(a, b, by=["d"], on=[], ids=["id"], inner_on=["key"], tolerance=tolerance)
        want = compare.count_overlaps(pairs, a, b, ["d"], ["d"], "id", least, absent=absent)
        got = compare.overlap_counts(a, b, ["d"], ["d"], "id", ["key"], tolerance=tolerance, min_overlap=least, absent=absent)
        assert flat(got) == flat(want) and got.columns == want.columns
    pairs = joins.merge_ranges_single(a, by=["d"], on=["key"], ids=["id"])
    assert flat(compare.overlap_counts_single(a, ["d"], ["key"], "id")) == flat(compare.count_overlaps_single(pairs, a, ["d"], ["key"], "id"))
    # 400 intervals at one place in each of two sets: 320,000 pairs, of which each interval is needed once for each set.
    hot = spark.range(800).select(F.lit(1).alias("key"), "id", (F.col("id") % 2).alias("d"), (F.col("id") % 7).alias("start"), (F.col("id") % 7 + 20).alias("end"))
    wide = hot.withColumnsRenamed({"start": "_s", "end": "_e"})
    assert compare._meeting(wide, wide, ["d"], ["d"], "id", ["key"], 1).count() == 1600
    assert {tuple(r)[:4] for r in compare.overlap_counts_single(hot, ["d"], [], "id", ["key"]).collect()} == {(x, y, 400, 400) for x in (0, 1) for y in (0, 1)}


def test_batches_hold_their_own_sums_and_no_state(spark, tmp_path):
    for k, n in enumerate((2, 3)):
        spark.createDataFrame([("chr1", 0, 900, "chr1", 50000, 50900, 4 + k)] * n, CONTACTS).coalesce(1).write.mode("append").csv(f"{tmp_path}/in", sep="\t")
    found = ingest.stream_contacts(spark, f"{tmp_path}/in", max_files=1)
    ingest.maintain(found, f"{tmp_path}/pairs", f"{tmp_path}/kept", compact=0).awaitTermination()
    sums = sorted(tuple(r) for k in (0, 1) for r in spark.read.parquet(f"{tmp_path}/pairs/batch={k}").select("n_contacts", "total_petcount").collect())
    assert sums == [(2, 8), (3, 15)] and not (tmp_path / "kept" / "state").exists()
    now = ingest.current_pairs(spark, f"{tmp_path}/pairs").first()
    assert (now.n_contacts, now.total_petcount, now.min_petcount, now.max_petcount) == (5, 23, 4, 5)
