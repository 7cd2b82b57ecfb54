"""Contact matrices against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspan.operators import matrix

SCHEMA = "chromosome_A string, start_A long, end_A long, chromosome_B string, start_B long, end_B long, petcount long"


def contacts(seed=3, bins=12, n=400):
    """Contacts of two chromosomes in bins of 100; bin 5 has none."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n):
        c, x, y = f"chr{rng.integers(1, 3)}", *(int(v) for v in rng.integers(0, bins, 2))
        if 5 not in (x, y):
            rows.append((c, x * 100 + 10, x * 100 + 30, c, y * 100 + 50, y * 100 + 70, int(rng.integers(1, 5))))
    return rows


def dense(rows, chromosome, bins=12):
    m = np.zeros((bins, bins))
    for a, s, _, b, t, _, v in rows:
        if a == b == chromosome:
            i, j = s // 100, t // 100
            m[i, j] += v
            if i != j:
                m[j, i] += v
    return m


@pytest.fixture(scope="module")
def table(spark):
    rows = contacts()
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def test_cells_are_one_triangle(spark, table):
    rows, df = table
    got = matrix.cells(df, 100).collect()
    assert all(r.x_bin <= r.y_bin for r in got)
    for c in ("chr1", "chr2"):
        m = np.zeros((12, 12))
        for r in got:
            if r.chromosome_x == c:
                m[r.x_bin, r.y_bin] = m[r.y_bin, r.x_bin] = r.value
        assert (m == dense(rows, c)).all()


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_balanced_rows_are_even(spark, table, monkeypatch, sent):
    rows, df = table
    monkeypatch.setattr(matrix, "SENT_BINS", sent)
    found = matrix.cells(df, 100)
    even = matrix.normalise(found, matrix.balance(found)).collect()
    for c in ("chr1", "chr2"):
        sums, total = np.zeros(12), 0
        for r in even:
            if r.chromosome_x == c:
                sums[r.x_bin] += r.value
                sums[r.y_bin] += r.value if r.x_bin != r.y_bin else 0
        raw = dense(rows, c)
        used = raw.sum(axis=1) > 0
        assert not used[5] and sums[5] == 0
        assert np.abs(sums[used] / sums[used].mean() - 1).max() < 1e-5
        assert sums.sum() == pytest.approx(raw.sum(), rel=1e-9)


def test_bins_without_contacts_have_no_weight(spark, table):
    _, df = table
    found = matrix.cells(df, 100)
    sizes = spark.createDataFrame([("chr1", 14), ("chr3", 2)], "chromosome string, n_bins long")
    got = {(r.chromosome, r.bin): r.weight for r in matrix.all_bins(matrix.balance(found, "VC"), sizes).collect()}
    assert len(got) == 16 and {b for (c, b), w in got.items() if c == "chr1" and w is None} == {5, 12, 13}
    assert got["chr3", 0] is None
    cell = spark.createDataFrame([("chr1", "chr1", 4, 5, 7)], "chromosome_x string, chromosome_y string, x_bin long, y_bin long, value long")
    assert matrix.normalise(cell, matrix.balance(found, "VC")).first().value is None


def test_vanilla_weights(spark, table):
    rows, df = table
    found = matrix.cells(df, 100)
    for method, power in (("VC", 1.0), ("VC_SQRT", 0.5)):
        got = {(r.chromosome, r.bin): r.weight for r in matrix.balance(found, method).collect()}
        for c in ("chr1", "chr2"):
            raw = dense(rows, c)
            w = np.array([1 / s**power if s else 0 for s in raw.sum(axis=1)])
            w *= np.sqrt(raw.sum() / (raw * np.outer(w, w)).sum())
            assert all(got[c, i] == pytest.approx(w[i]) for i in range(12) if w[i])


def test_balancing_ends_without_a_balanced_form(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MOST_ROUNDS", 6)
    star = spark.createDataFrame([("c", "c", 0, 1, 1), ("c", "c", 0, 2, 1)], "chromosome_x string, chromosome_y string, x_bin long, y_bin long, value long")
    assert matrix.balance(star).count() == 3


def test_expected_counts_empty_places(spark, table):
    rows, df = table
    found = matrix.cells(df, 100)
    sizes = spark.createDataFrame([("chr1", 20), ("chr2", 13), ("chr9", 30)], "chromosome string, n_bins long")
    got = {r.distance: r for r in matrix.expected(found, sizes).collect()}
    for d, r in got.items():
        total = sum(np.trace(dense(rows, c), d) for c in ("chr1", "chr2"))
        assert r.total == total and r.places == sum(n - d for n in (20, 13, 30) if n > d)
    own = {(r.chromosome, r.distance): r.expected for r in matrix.expected(found, sizes, by="chromosome").collect()}
    assert own["chr2", 3] == pytest.approx(np.trace(dense(rows, "chr2"), 3) / 10)
    short = spark.createDataFrame([("chr1", 4)], "chromosome string, n_bins long")
    assert {r.distance for r in matrix.expected(found, short).collect()} <= {0, 1, 2, 3}


def test_ratio_averages_to_one(spark, table):
    rows, df = table
    got = matrix.observed_over_expected(matrix.cells(df, 100), by="chromosome").filter("chromosome_x = 'chr1'").collect()
    n = max(r.y_bin for r in got) + 1
    by = {}
    for r in got:
        by[r.y_bin - r.x_bin] = by.get(r.y_bin - r.x_bin, 0) + r.ratio
    assert all(s == pytest.approx(n - d) for d, s in by.items())


def test_pyramid_regions_and_pruning(spark, table, tmp_path):
    rows, df = table
    path = f"{tmp_path}/pyramid"
    matrix.write_pyramid(df, path, [100, 200, 600], tile_bins=3)
    assert matrix.resolutions(spark, path) == [100, 200, 600]
    m = dense(rows, "chr2")
    got = {(r.x_bin, r.y_bin): r.value for r in matrix.region(spark, path, ("chr2", 150, 799), ("chr2", 400, 1050)).collect()}
    assert got == {(i, j): m[i, j] for i in range(1, 8) for j in range(4, 11) if m[i, j]}
    coarse = matrix.region(spark, path, ("chr2", 0, 1199), resolution=600)
    upper = np.triu(m)
    block = lambda i, j: upper[i * 6 : i * 6 + 6, j * 6 : j * 6 + 6].sum()
    assert {(r.x_bin, r.y_bin): r.value for r in coarse.collect()} == {(0, 0): block(0, 0), (0, 1): block(0, 1), (1, 0): block(0, 1), (1, 1): block(1, 1)}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    coarse = matrix.region(spark, path, ("chr2", 0, 1199), resolution=600)
    plan = coarse._jdf.queryExecution().executedPlan().toString()
    assert "resolution" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(y_bin" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    every = spark.read.parquet(f"{path}/cells").select(F.input_file_name().alias("f")).distinct().count()
    one = spark.read.parquet(f"{path}/cells").filter("resolution = 600 and chromosome_x = 'chr2' and tile = 0").select(F.input_file_name().alias("f")).distinct().count()
    assert one == 1 < every
    with pytest.raises(ValueError, match="no such resolution"):
        matrix.region(spark, path, ("chr2", 0, 1), resolution=300)


def test_regions_in_one_job(spark, table, tmp_path):
    rows, df = table
    path = f"{tmp_path}/pyramid"
    matrix.write_pyramid(df, path, [100], tile_bins=2)
    windows = spark.createDataFrame([(1, "chr1", 0, 399), (2, "chr2", 300, 999), (3, None, 0, 5), (4, "chr1", 9, 2)], "id long, chromosome string, start long, end long")
    got = {(r.id, r.x_bin, r.y_bin): r.value for r in matrix.regions(spark, path, windows).collect()}
    want = {}
    for i, c, low, high in ((1, "chr1", 0, 3), (2, "chr2", 3, 9)):
        m = dense(rows, c)
        want |= {(i, x, y): m[x, y] for x in range(low, high + 1) for y in range(x, high + 1) if m[x, y]}
    assert got == want


def test_between_chromosomes_and_edge_cases(spark, tmp_path):
    rows = [("chr2", 0, 20, "chr1", 300, 320, 2), ("chr1", 310, 320, "chr2", 10, 20, 3), ("chr1", 0, 10, None, 5, 9, 1), ("chr1", None, 5, "chr1", 1, 2, 1), ("chr1", 0, 2, "chr1", 0, 2, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = matrix.cells(df, 100, within=False).collect()
    assert [tuple(r) for r in got] == [("chr1", "chr2", 3, 0, 5)]
    path = f"{tmp_path}/pyramid"
    matrix.write_pyramid(df, path, [100])
    assert [tuple(r) for r in matrix.region(spark, path, ("chr2", 0, 99), ("chr1", 0, 999)).collect()] == [(0, 3, 5.0)]
    none = matrix.cells(df.limit(0), 100)
    assert matrix.balance(none).count() == 0 and matrix.observed_over_expected(none).count() == 0
    for bad in ([], [0], [100, 150]):
        with pytest.raises(ValueError, match="multiples"):
            matrix.write_pyramid(df, f"{tmp_path}/bad", bad)
