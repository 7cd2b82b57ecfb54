"""SimHash and substring dedup against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from weftspan.llm import simhash, substring

SCHEMA = "doc_id long, text string, k string, t string, fp string, bucket string, share string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "b", "s", "c") for i, t in rows], SCHEMA)


def words(text):
    return (text or "").encode().split()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, budget=4):
    fp = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in fp}
    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= budget and find(parent, a) != find(parent, b):
                a_, b_ = sorted((find(parent, a), find(parent, b)))
                parent[b_] = a_
    return {i: (f"{fp[i]:016x}", find(parent, i)) for i in fp}


def texts(rng, n):
    vocabulary = [f"w{i}é" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))) for _ in range(n)]
    for i in range(0, n, 3):
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        base[i + 1 if i + 1 < n else 0] = " ".join(w)
    return [*base, None, "", " \t\n", "one", "One", "a b", base[2], base[2], "lang " * 30_000]


def test_simhash_matches_brute_force(spark):
    rows = list(enumerate(texts(random.Random(5), 60)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_simhash_null_keys_repeats_and_empty_table(spark):
    rows = simhash.near_duplicates(frame(spark, [(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "A B C")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows) == [(False, 3, 3), (False, 7, 3), (False, 7, 3), (True, 0, None)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def brute_labels(codes, budget=4):
    parent = {c: c for c in codes}
    for a in codes:
        for b in codes:
            if a < b and (a ^ b).bit_count() <= budget and find(parent, a) != find(parent, b):
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    return {c: find(parent, c) for c in codes}


def joined(codes, edges):
    parent = {c: c for c in codes}
    for a, b in edges:
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    return {c: find(parent, c) for c in codes}


def near_codes(rng, centres, near):
    out = set()
    for _ in range(centres):
        code = rng.getrandbits(63)
        out.add(code)
        for _ in range(near):
            code ^= sum(1 << rng.randrange(63) for _ in range(rng.randrange(1, 4))) & (1 << 63) - 1
            out.add(code)
    return out


def test_trie_join_finds_every_link_of_each_run():
    runs = [sorted(near_codes(random.Random(s), 20, 5)) for s in range(3)]
    codes = np.array([c for r in runs for c in r], np.uint64)
    start = np.cumsum([0, *map(len, runs)])
    label = simhash.trie_join(codes, 4, start)
    for a, b, run in zip(start, start[1:], runs):
        assert {int(codes[i]): int(codes[label[i]]) for i in range(a, b)} == brute_labels(run)


@pytest.mark.parametrize("limit", [4, 30, 1 << 13])
def test_large_tries_are_dealt_out_again(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SUBTREE", limit)
    rng = random.Random(limit)
    codes = {rng.getrandbits(20) for _ in range(150)} | near_codes(rng, 10, 8)
    reps = spark.createDataFrame([(c, c) for c in codes], "fp long, rep long")
    assert joined(codes, [(r.a, r.b) for r in simhash.links(reps).collect()]) == brute_labels(codes)


def test_tries_go_on_over_batches(monkeypatch):
    monkeypatch.setattr(simhash, "WALKED", 20)
    codes = sorted(near_codes(random.Random(3), 12, 8))
    rows = pd.DataFrame([(k, c, c) for k in range(4) for c in codes[k::2]], columns=["key", "fp", "rep"])
    batches = [rows.iloc[i : i + 7] for i in range(0, len(rows), 7)]
    edges = [(a, b) for out in simhash._walk(4)(iter(batches)) for a, b in zip(out["a"].tolist(), out["b"].tolist())]
    for half in (codes[0::2], codes[1::2]):
        assert joined(half, [e for e in edges if e[0] in half]) == brute_labels(half)


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            run = tuple(w[s : s + window])
            if run in seen:
                gone[s : s + window] = [True] * window
            seen.add(run)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def passages(rng, n):
    vocabulary = [f"v{i}ü" for i in range(50)]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(m)) for m in (19, 20, 21, 35, 60)]
    out = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(shared), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(6))]
        out.append("\n ".join(parts))
    return [*out, None, "", "a " * 500, "a " * 21, "b c " * 40, out[3], out[3], "long " + "x " * 50_000]


def test_substring_matches_brute_force(spark):
    rows = list(enumerate(passages(random.Random(9), 80)))
    random.Random(1).shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_substring_keeps_texts_and_carries_columns(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"x  {passage}\ty"), (2, f"u {passage} v"), (None, passage), (3, "a  b")]
    got = {r.doc_id: (r.kept, r.n_removed, r.share) for r in substring.remove_repeats(frame(spark, rows), carry=("share",)).collect()}
    assert got == {1: (f"x  {passage}\ty", 0, "s"), 2: ("u v", 25, "s"), None: (passage, 0, "s"), 3: ("a  b", 0, "s")}
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_substring_with_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 400)
    say = lambda w, n=25: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, f"{say('a')} x{i} {say('b')}") for i in range(20)] + [(0, say("c")), (2, f"{say('c')} {say('a')}")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted([(0, 25, 0), (2, 50, 50), (1, 51, 0), *[(1, 51, 50)] * 19])  # each passage stays exactly once
    again = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows[::-1]).repartition(5)).collect())
    assert again == got


def test_substring_deals_out_empty_and_equal_rows(spark, monkeypatch):
    empty = spark.range(1_000_000).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("t"))
    _, dealt, buckets = substring._dealt_out(empty)
    assert buckets == -(-1_000_000 * substring.ROW_BYTES // substring.BUCKET_BYTES)
    assert dealt.groupBy("bucket").count().agg(F.max("count")).first()[0] < 1.2 * 1_000_000 / buckets
    equal = spark.range(100_000).select(F.lit(7).alias("k"), F.lit("some words").alias("t"))
    _, dealt, buckets = substring._dealt_out(equal)
    assert dealt.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 100_000 / buckets + 20 * substring.EQUAL_ROWS
    monkeypatch.setattr(substring, "EQUAL_ROWS", 4)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 400)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(7, passage)] * 50 + [(8, f"x {passage}"), (9, "short"), (9, "short"), (6, None)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted([(7, 30, 0), *[(7, 30, 30)] * 49, (8, 31, 30), (9, 1, 0), (9, 1, 0), (6, 0, 0)])


def test_substring_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 500)
    rows = list(enumerate(passages(random.Random(4), 60)))
    for low_bits in (32, 64):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(spark, rows), texts=False, low_bits=low_bits).collect()}
        assert got == brute_repeats(rows)
