"""What near-dedup and its components leave on disk while they run."""

import time
from pathlib import Path

from weftspan.functions import lineage
from weftspan.llm import components, jaccard


def test_cut_keeps_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffled()
    got = lineage.cut(spark.range(1000).repartition(3, "id"))
    for _ in range(50):  # they go in the background
        if left := shuffled() - before:
            time.sleep(0.2)
    assert not left
    assert got.count() == 1000


def test_near_copies_leave_no_texts(spark):
    say = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, say(1, 60)), (2, say(1, 60) + " end"), (3, say(1, 62)), (4, say(2, 50)), (5, say(2, 49)), (6, say(3, 50)), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with lineage.scope(spark):
        at = Path(f"{lineage._cuts(spark)}/{lineage._SCOPE.get()}".removeprefix("file:"))
        found = jaccard.near_copies(docs)
        left = [spark.read.parquet(str(p.parent)).columns for p in at.rglob("_SUCCESS")]
        same = [r.n for r in found.groupBy("component").count().withColumnRenamed("count", "n").collect()]
    assert left and not any("t" in c or "ta" in c for c in left)
    assert sorted(same) == [2, 3]


def test_settled_links_need_no_round(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or lineage.cut(df))
    stars = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 4), (9, 4)], "a long, b long")
    got = {tuple(r) for r in components.components(stars).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 4), (4, 4)} and len(cuts) == 1
    for links in ([(2, 1), (3, 2)], [(3, 1), (3, 2)], [(k + 1, k) for k in range(1, 40)]):
        got = {tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {(n, 1) for pair in links for n in pair}
