"""Cases that runs over tables of 6 GB brought up."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftspan.llm import substring
from weftspan.operators import joins
from weftspan.sources import bedpe_files


def test_whole_copies_of_texts_take_no_part(spark, monkeypatch):
    """Forty copies of each text: only rows at the smallest key are dealt out, and all have the results of their place."""
    for sent in (1000, 0):  # the digests of texts that occur again are sent to all executors, or shuffled
        monkeypatch.setattr(substring, "SENT_ROWS", sent)
        say = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
        texts = [say("a", 30), f"{say('b', 25)}\t {say('a', 30)}", say("c", 19), "", None]
        rows = spark.createDataFrame([(100 * c + i, t) for c in range(40) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.remove_repeats(rows).collect()}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        first = [(30, 0, sha(texts[0]), texts[0]), (55, 30, sha(say("b", 25)), say("b", 25)), (19, 0, sha(texts[2]), texts[2]), (0, 0, sha(""), ""), (0, 0, sha(""), None)]
        later = [(30, 30, sha(""), ""), (55, 55, sha(""), ""), *first[2:]]
        assert got == {100 * c + i: x for c in range(40) for i, x in enumerate(later if c else first)}
        firsts, copies = substring._without_copies(rows.select(F.col("doc_id").alias("k"), F.col("text").alias("t")))
        assert sorted(r.k for r in firsts.collect()) == [0, 1, 2, 3] and copies.count() == 196


def test_answers_to_many_buckets_read_a_share_once(monkeypatch):
    """Five hundred buckets with the same hashes: a share's hashes are not gone through again for each bucket."""
    made = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(out, np.ndarray):
                made.append(out.size)
            return out

    concatenate = np.concatenate
    monkeypatch.setattr(substring.np, "concatenate", lambda *a, **k: concatenate(*a, **k).view(Counted))
    h = np.arange(200, dtype="<u4").tobytes()
    blocks = pd.DataFrame({"share": 0, "bucket": range(500), "kind": 2, "blob": [h] * 500})
    hits = substring._find_hits(32)((0,), blocks)
    assert sorted(hits["bucket"]) == list(range(500)) and set(map(len, hits["blob"])) == {800}
    assert sum(made) < 20 * 100_000
    made.clear()
    h = np.arange(200, dtype="<u8").tobytes()
    keys, starts = [substring.pack_keys(np.arange(200) + 200 * i) for i in range(500)], [substring.pack(np.zeros(200))] * 500
    later = substring._find_later((0,), pd.DataFrame({"share": 0, "bucket": range(500), "hashes": [h] * 500, "keys": keys, "starts": starts}))
    assert sorted(later["bucket"]) == list(range(1, 500)) and set(map(len, later["blob"])) == {1600}
    assert sum(made) < 20 * 100_000


def test_three_way_merge_comes_out_in_even_blocks(spark, monkeypatch):
    """Few keys of unlike sizes, nulls and equal rows: all pairs, dealt evenly, with a new left row after a block at most."""
    monkeypatch.setattr(joins, "TASK_ROWS", 500)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 8, raising=False)
    monkeypatch.setattr(joins, "TASK_BLOCKS", 4, raising=False)
    left_rows = [(i, 0) for i in range(3)] + [(i, 1) for i in range(90)] + [(7, 2)] * 60 + [(8, 3), (9, None)]
    right_rows = [(i, 0) for i in range(3000)] + [(i, 1) for i in range(41)] + [(5, 2)] * 20 + [(1, None), (1, 9)]
    left, right = (spark.createDataFrame(r, "id long, k int").repartition(6) for r in (left_rows, right_rows))
    mid = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, name string").coalesce(1)
    want = sorted((a, "abc"[k], b) for a, k in left_rows for b, j in right_rows if k is not None and k == j)
    for inner in (True, False):
        got = joins.merge_three(left, mid, right, ["k"], ["k"], ["k"], ["k"], inner).withColumn("part", F.spark_partition_id())
        parts = got.groupBy("part").count().collect()
        rows = [(r.id_left, r.name, r.id_right) for r in got.collect()]  # in the order in which a file would have them
        assert sorted(r for r in rows if r[2] is not None) == want
        assert sorted((r for r in rows if r[2] is None), key=str) == ([] if inner else [(8, "d", None), (None, "e", None)])
        assert len(parts) > 20 and max(r["count"] for r in parts) < 2000
        runs, ids = 0, [r[:2] for r in rows if r[1] == "b"]
        for before, now in zip(ids, ids[1:]):
            runs = runs + 1 if now == before else 0
            assert runs < 8


def test_small_ranges_and_files_are_read_together(spark, tmp_path):
    """300 files, and one of 2,000 ranges, in few partitions; prefixes are decided for each file without a shuffle of rows."""
    line = lambda i, name: f"{name}1\t{i}\t{i + 5}\t{name}2\t{i}\t{i + 7}\t{i % 9}\n"
    for i in range(300):
        (tmp_path / f"f{i:03d}").write_text("a\tb\tc\td\te\tf\tcount\n" + line(i, "chr" if i % 2 else "") + line(i + 1, "chr"))
    (tmp_path / "long").write_text("".join(line(i, "x" if i == 5000 else "chr") for i in range(12000)))
    reader = bedpe_files.BedpeReader(None, {"path": str(tmp_path), "chunk": "128"})
    found = reader.partitions()
    assert len(found) < 150 and max(sum(r.end - r.start for r in p.ranges) for p in found) < 40_000
    reader.options["chunk"] = str(1 << 26)
    assert len(reader.partitions()) < 70
    rows = bedpe_files.read_files(spark, [str(tmp_path)], chunk=128)
    table = sorted((r.file.rpartition("/")[2], r.place, r.chromosome_A, r.start_A) for r in rows.collect())
    assert len(table) == 12600 and len(set(table)) == 12600
    assert {(f, i, c) for f, _, c, i in table if f != "long"} == {(f"f{i:03d}", i + k, "chr1" if i % 2 else ("chr1", "chrchr1")[k]) for i in range(300) for k in (0, 1)}
    assert sorted(i for f, _, c, i in table if f == "long" and c == ("chrx1" if i == 5000 else "chrchr1")) == list(range(12000))
    assert "Strategy hint: broadcast" in rows._jdf.queryExecution().analyzed().toString() or "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_range_join_of_dense_rows_repeats_at_short_distance(spark, tmp_path, monkeypatch):
    """Intervals that lie on each other: every pair once, and a file of few bytes a row; a pack's edges lose none."""
    rng = np.random.default_rng(3)
    a, b = ((rng.integers(0, 60, n), rng.integers(0, most, n)) for n, most in ((1200, 97), (1500, 41)))
    frame = lambda s, n: spark.createDataFrame([(1, i, int(x), int(x + y)) for i, (x, y) in enumerate(zip(s, n, strict=True))], "key long, id long, start long, end long").repartition(3)
    left, right = frame(*a), frame(*b)
    for pack, tolerance in ((128, 0), (7, 5)):
        monkeypatch.setattr(joins, "PACK_ROWS", pack, raising=False)
        joins.range_join(left, right, on=["key"], tolerance=tolerance).write.parquet(f"{tmp_path}/{pack}")
        got = spark.read.parquet(f"{tmp_path}/{pack}").select("id_A", "id_B", "overlap").toPandas()
        sa, ea, sb, eb = a[0][:, None] - (tolerance + 1) // 2, (a[0] + a[1])[:, None] + (tolerance + 1) // 2, b[0] - tolerance // 2, b[0] + b[1] + tolerance // 2
        want = np.argwhere((sa < eb) & (sb < ea))
        got = got.sort_values(["id_A", "id_B"])
        assert np.array_equal(got[["id_A", "id_B"]].to_numpy(), want)
        deep = np.minimum(ea - sb, eb - sa)[want[:, 0], want[:, 1]] - tolerance
        assert np.array_equal(got["overlap"].to_numpy(), deep)
    size = sum(p.stat().st_size for p in (tmp_path / "128").glob("*.parquet"))
    assert size < 1.5 * spark.read.parquet(f"{tmp_path}/128").count()
