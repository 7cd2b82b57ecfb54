"""How many tasks components take where every shuffle has many, and that small and large tables give the same."""

import random

import pytest

from weftspan.functions import lineage
from weftspan.llm import components, jaccard

PARTS = 64


def roots(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {(x, find(x)) for x in top}


def test_components_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    number = spark.sparkContext._jsc.sc().taskScheduler().newTaskId  # each call takes one number
    links = [(k, k + 1) for k in range(1, 5)] + [(10, k) for k in range(11, 40)]
    edges = lineage.cut(spark.createDataFrame(links, "a long, b long").coalesce(1))
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        first = number()
        got = components.components(edges).collect()
        tasks = number() - first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {tuple(r) for r in got} == roots(links)
    assert tasks < 9 * PARTS  # two rounds


@pytest.mark.parametrize("sent", [0, 1 << 18])
def test_components_of_any_size(spark, monkeypatch, sent):
    monkeypatch.setattr(components, "SENT", sent)
    draw = random.Random(5)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    links += links[:20] + [(b, a) for a, b in links[20:40]]  # repeated, both ways
    got = components.components(spark.createDataFrame(links + [(None, 7), (8, None)], "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(x, c) for x, c in roots(links) if any(x in p and p[0] != p[1] for p in links)}
    assert len(got) == len(set(got))


@pytest.mark.parametrize("sent", [0, 1 << 18])
def test_new_links_join_known_components(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "SENT", sent)
    monkeypatch.setattr(components, "SENT", sent)
    key = lambda n: bytes([n, 255 - n])
    frame = lambda rows: spark.createDataFrame([tuple(map(key, r)) for r in rows], "a binary, b binary")
    found, new = [(1, 1), (2, 1), (5, 5), (6, 5), (30, 30), (31, 30), (50, 50), (51, 50)], [(2, 6), (9, 6), (12, 11), (3, 31), (31, 40), (40, 60)]
    with lineage.scope(spark) as place:
        got = jaccard._joined(lineage.cut(frame(found)), lineage.cut(frame(new)), place)
    assert sorted((bytes(r.a), bytes(r.b)) for r in got.collect()) == sorted((key(a), key(b)) for a, b in roots(found + new))
