"""Batches of a stream, merged into snapshots as they come."""

import pytest
from pyspark.sql import functions as F

from weftspan.streaming import ingest


def contacts(k, n=30):
    return [(f"chr{1 + i % 2}", 10000 * (i % 7), 10000 * (i % 7) + 900, f"chr{1 + i % 2}", 10000 * (i % 5) + 50000 * (k % 2), 10000 * (i % 5) + 50000 * (k % 2) + 900, 1 + (i + k) % 4) for i in range(n)]


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    rows = []
    for k in range(10):
        rows += contacts(k)
        spark.createDataFrame(contacts(k), ingest.SCHEMA).coalesce(1).write.mode("append").csv(f"{root}/in", sep="\t")
    found = ingest.stream_contacts(spark, f"{root}/in", max_files=1)
    ingest.maintain(found, f"{root}/pairs", f"{root}/state", compact=4).awaitTermination()
    return root, spark.createDataFrame(rows, ingest.SCHEMA)


def flat(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ten_batches_are_one_snapshot_and_two_batches(spark, stream):
    root, rows = stream
    path = f"{root}/pairs"
    assert ingest.parts_of(spark, path) == (7, [8, 9])
    want = ingest.bin_pairs(rows)
    now = ingest.current_pairs(spark, path)
    assert flat(now, want.columns) == flat(want, want.columns)
    files = {r.f.split("/")[-2] for r in now.sparkSession.read.parquet(f"{path}/snapshot=7", f"{path}/batch=8", f"{path}/batch=9").select(F.input_file_name().alias("f")).distinct().collect()}
    assert files == {"snapshot=7", "batch=8", "batch=9"}
    # What the snapshot of batch 3 took in has gone; what that of batch 7 took in stays for those who read the older one.
    assert ingest.written_numbers(spark, path, "batch") == [4, 5, 6, 7, 8, 9] and ingest.written_numbers(spark, path, "snapshot") == [3, 7]


def test_older_states_and_repeated_merges(spark, stream):
    root, rows = stream
    path = f"{root}/pairs"
    want = ingest.bin_pairs(rows).columns
    before = flat(ingest.current_pairs(spark, path), want)
    ingest.compact_pairs(spark, path, 7)
    assert flat(ingest.current_pairs(spark, path), want) == before
    (root / "pairs" / "snapshot=7" / "_SUCCESS").unlink()  # a merge that broke off
    assert ingest.parts_of(spark, path) == (3, [4, 5, 6, 7, 8, 9])
    assert flat(ingest.current_pairs(spark, path), want) == before
    ingest.compact_pairs(spark, path, 7)
    assert ingest.parts_of(spark, path) == (7, [8, 9]) and flat(ingest.current_pairs(spark, path), want) == before
    ingest.compact_pairs(spark, path, 9)
    assert ingest.parts_of(spark, path) == (9, []) and flat(ingest.current_pairs(spark, path), want) == before
    assert ingest.written_numbers(spark, path, "snapshot") == [7, 9] and ingest.written_numbers(spark, path, "batch") == [8, 9]


def test_nothing_written(spark, tmp_path):
    assert ingest.parts_of(spark, str(tmp_path / "no")) == (None, [])
    with pytest.raises(FileNotFoundError):
        ingest.current_pairs(spark, str(tmp_path / "no"))
