"""Top-k search, sharding, mixing, and the pipeline against brute force."""

import pathlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_components, brute_repeats
from weftspan.llm import hamming, mixing, sharding
from weftspan.llm.common import shared_folder
from weftspan.llm.components import components
from weftspan.llm.queries import ORACLES, QUERIES


def brute_top_k(rows, asked, k):
    code = [(i, [x is not None and x > 0 for x in v]) for i, v in rows if i is not None and v is not None]
    out = {}
    for q, own in code:
        if q in asked:
            out[q] = sorted((sum(x != y for x, y in zip(own, c)), i) for i, c in code if len(c) == len(own))[:k]
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 100])
def test_top_k_is_exact(spark, size):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(6, size))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=size) * 0.7]) for i in range(500)]
    rows += [(600 + i, rows[0][1]) for i in range(40)] + [(800, None), (900, [1.0] * (size + 8)), (None, rows[1][1]), (1000, [None, float("nan"), -0.0, *[1.0] * size][:size]), (3, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, code string, distance int, size int")
    asked = {i for i, _ in rows if i is not None and i % 100 == 0}
    got = defaultdict(list)
    for r in hamming.top_k(df, df.filter("vec_id % 100 = 0"), k=7).collect():
        got[r.query_id].append((r.rank, r.distance, r.neighbour_id))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == brute_top_k(rows, asked, 7)


def test_top_k_with_wide_segments(spark, monkeypatch):
    monkeypatch.setattr(hamming, "NARROWEST", 24)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=64) * 0.3]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hamming.top_k(df, df.filter("vec_id % 100 = 0"), k=5).collect():
        got[r.query_id].append((r.rank, r.distance, r.neighbour_id))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == brute_top_k(rows, {0, 100, 200, 300}, 5)


def test_every_value_is_probed_once(spark):
    probes, seen = spark.createDataFrame([(6, [5], 0, 6, 5, -1)], "size int, q array<int>, j int, b int, value int, top int"), [5]
    for radius in range(1, 7):
        probes = hamming._wider(probes)
        now = [r.value for r in probes.collect()]
        assert all((v ^ 5).bit_count() == radius for v in now)
        seen += now
    assert sorted(seen) == list(range(64)) and hamming._wider(probes).isEmpty()


def test_top_k_of_few_rows_and_repeated_queries(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    twice = df.filter("vec_id = 1").unionAll(df.filter("vec_id = 1"))
    assert sorted((r.query_id, r.rank, r.neighbour_id, r.distance) for r in hamming.top_k(df, twice, k=5).collect()) == sorted([(1, 1, 1, 0), (1, 2, 2, 1), (1, 3, 2, 1)] * 2)
    assert hamming.top_k(df.limit(0), df, k=3).count() == 0 and hamming.top_k(df, df.limit(0), k=3).count() == 0


def shard_rows():
    return [(i, None if i % 11 == 0 else "ü" * (i % 50)) for i in range(5000)] + [(77, "copy")] * 900 + [(None, "n"), (None, None)]


def test_sharding_laws(spark):
    rows = shard_rows()
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, shard int, bucket string")
    got = sharding.assign_shards(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.assign_shards(docs.repartition(7)).collect()
    assert Counter(again) == Counter(got)
    other = sharding.assign_shards(docs, seed=8).collect()
    assert Counter(other) != Counter(got)
    places = [r.shard for r in sorted(got, key=lambda r: (r.doc_id or 0, r.text_crc32)) if r.doc_id != 77]
    assert 0.04 < np.mean([a == b for a, b in zip(places, places[1:])]) < 0.09  # neighbours scatter
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_shards_against_sql(spark):
    """Sizes, checksums and the law of the query's rows, by another engine and plain Python."""
    got = QUERIES["op7_two_pass_sharding"](spark, "/root/testdata/sf0.001").toPandas()
    docs = duckdb.sql("SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text FROM '/root/testdata/sf0.001/documents.parquet'").df()
    want = Counter((i, n, zlib.crc32(t.encode())) for i, n, t in docs.itertuples(index=False))
    assert Counter(zip(got["doc_id"], got["size"], got["text_crc32"])) == want
    by = duckdb.sql("SELECT shard, count(*) AS n, count(DISTINCT slot) AS slots, max(slot) + 1 AS last FROM got GROUP BY shard").df()
    assert len(by) == 16 and by["n"].max() - by["n"].min() <= 1 and (by["n"] == by["slots"]).all() and (by["n"] == by["last"]).all()
    assert (got["law"] == "rows").all() and got["grown_shard"].isna().all()


def test_shards_do_not_depend_on_settings(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(9000)], "doc_id long, text string")
    name, found = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(name)
    try:
        for n in ("1", "3"):
            spark.conf.set(name, n)
            found.append({(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs).collect()})
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1]


def test_shards_are_many_files_in_slot_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 2000)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1000)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=2)
    for k, n in ((0, 500), (1, 500)):
        files = sorted((tmp_path / f"out/shard={k}").glob("part-*"))
        slots = [s for f in files for s in pq.read_table(f, partitioning=None)["slot"].to_pylist()]
        assert len(files) > 1 and slots == list(range(n))


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    back = sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    assert sorted(r.text for r in back.collect()) == sorted(f"text {i}" for i in range(100))
    first = back.filter("shard = 1").collect()
    assert [r.slot for r in first] == list(range(33))


def test_written_shards_keep_null_and_repeated_keys(spark, tmp_path):
    rows = [*((i, f"text {i}", 0) for i in range(50)), *((7, "copy", n) for n in range(30)), (7, "copy", 1), (7, "else", 0), (None, "n", 0), (None, "n", 0), (None, None, 0), (8, None, 0), (8, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    back = sharding.write_shards(docs, str(tmp_path / "out"), shards=3).collect()
    assert Counter((r.doc_id, r.text, r.other) for r in back) == Counter(rows)
    for k in range(3):
        slots = [r.slot for r in back if r.shard == k]
        assert sorted(slots) == list(range(len(slots))) and abs(len(slots) - len(rows) / 3) < 1


def brute_mix(rows, repetition, seed=7):
    import hashlib

    tokens = [(i, s, len((t or "").split())) for i, t, s in rows]
    total = Counter()
    for _, s, n in tokens:
        total[s] += n
    total = {s: n for s, n in total.items() if n}
    top, low = max(total.values()), min(total.values())
    t = 1.0 if len(total) < 2 else 0.0 if top / low <= repetition else round(1 - np.log(repetition) / np.log(top / low), 6)
    out, copies = [], Counter()
    blocks = defaultdict(list)
    for i, s, n in tokens:
        copies[i, s, n] += 1
        uses = round((top / total[s]) ** (1 - t), 6) if s in total else 1.0
        for b in range(int(uses) + 1 if n else 1):
            blocks[s, b, int(uses), int(total.get(s, 0) * (uses - int(uses)))].append((i, n, copies[i, s, n]))
    for (s, b, whole, rest), docs in blocks.items():
        key = lambda d: hashlib.md5("/".join(str(x) for x in (seed, b, d[0], d[2], d[1]) if x is not None).encode()).hexdigest()
        spent = 0
        for i, n, c in sorted(docs, key=key):
            if b < whole or spent < rest:
                out.append((i, s, n, b, c))
            spent += n
    return Counter(out)


def test_mixing_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))) or None, rng.choice(["big"] * 12 + ["mid"] * 4 + ["small", None])) for i in range(600)] + [(5, "a b", "mid")] * 3
    docs = spark.createDataFrame([(i, t, s, 1, "r") for i, t, s in rows], "doc_id long, text string, source string, block int, range string")
    got = Counter((r.doc_id, r.source, r.n_tokens, r.block, r.copy) for r in mixing.mix(docs, repetition=3.0).collect())
    assert got == brute_mix(rows, 3.0)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_temperature_meets_entropy_and_repetition(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, n long")
    share = np.array([1000, 100, 10]) / 1110

    def entropy(t):
        w = share**t / (share**t).sum()
        return -(w * np.log(w)).sum()

    t = mixing.temperature(totals, entropy=0.8)
    assert abs(entropy(t) - 0.8 * np.log(3)) < 1e-6
    t = mixing.temperature(totals, repetition=5.0)
    assert abs(100 ** (1 - t) - 5) < 1e-6
    assert mixing.temperature(totals, entropy=0.8, repetition=2.0) > mixing.temperature(totals, entropy=0.8)
    assert mixing.temperature(totals.limit(1), entropy=0.5) == 1.0


def test_a_token_budget(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 10 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget in (300, 2500):
        mixed = mixing.mix(docs, repetition=2.0, budget=budget).groupBy("source").sum("n_tokens").collect()
        used = {r.source: r[1] for r in mixed}
        assert abs(sum(used.values()) - budget) <= 2 * 5
        total = Counter()
        for _, t, s in rows:
            total[s] += len(t.split())
        assert abs(used["small"] / total["small"] / (used["big"] / total["big"]) - 2.0) < 0.2


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(300, 300 + i) for i in range(1, 40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(5, 5), (2, 1), (1, 2)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x != 5}


def test_queries_match_their_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, data).toPandas()
        want = con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        both = [x[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
        assert both[0].equals(both[1]), name


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = say(60)
    rows = [(i, f"{say(40)} {shared if i % 5 == 0 else say(10)} {'idiot moron' if i % 4 == 1 else 'house'} {say(20)}", "en", "big" if i % 6 else "small") for i in range(120)]
    rows += [(200 + i, rows[2][1], "en", "big") for i in range(5)] + [(300, None, None, None), (301, "", "en", "big")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, _, _ in rows[:110]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    import hashlib

    clean = {i: (t, s) for i, t, _, s in rows if "idiot" not in (t or "")}
    classes = brute_components([(i, t) for i, (t, _) in clean.items()])
    kept = {i: x for i, x in clean.items() if classes[i][1] == i}
    left = brute_repeats([(i, t) for i, (t, _) in kept.items()])

    def after(i):
        words = (kept[i][0] or "").split()
        seen = {tuple(w[s : s + 20]) for j in kept if j < i for w in [(kept[j][0] or "").split()] for s in range(len(w) - 19)}
        gone = set()
        for s in range(len(words) - 19):
            if (run := tuple(words[s : s + 20])) in seen:
                gone.update(range(s, s + 20))
            seen.add(run)
        assert left[i][1] == len(gone)
        return " ".join(w for p, w in enumerate(words) if p not in gone) if gone else kept[i][0]

    texts = [(i, after(i), s) for i, (_, s) in kept.items()]
    uses = Counter()
    for (i, _, _, _, _), n in brute_mix(texts, 2.0).items():
        uses[i] += n
    want = Counter({(i, hashlib.sha256((t or "").encode()).hexdigest()): uses[i] for i, t, _ in texts})
    assert got == want
    cuts = pathlib.Path(shared_folder(spark).removeprefix("file:")) / f"cuts-{spark.sparkContext.applicationId}"
    assert not list(cuts.glob("scope-*"))  # what the stages cut is gone


def run_pipeline(spark, folder, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, component string, copy int, key string"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.1, "x", "y", 1, "z") for i, t, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())


def test_pipeline_loses_no_row_that_no_rule_names(spark, tmp_path):
    import hashlib

    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    say = lambda w, n=30: " ".join(f"{w}{i}" for i in range(n))
    rows = [(5, say("a"), "s"), (5, say("b"), "s"), (5, say("b"), "s"), (6, say("a"), "s"), (7, say("c"), "s"), (7, say("d"), None), (None, say("e"), "s"), (None, say("e", 5), "t"), (None, None, None), (8, None, "s"), (9, " ", "s"), (10, "", None)]
    got = run_pipeline(spark, str(tmp_path / "plain"), rows, [])
    kept = [(5, say("a")), (5, say("b")), (7, say("c")), (7, say("d")), (None, say("e")), (None, say("e", 5)), (None, None), (8, None)]
    assert got.keys() == {(i, digest(t)) for i, t in kept}  # 7 and its source may be used more than once by the mix
    assert all(n == 1 for (i, d), n in got.items() if i is None or d == digest(""))
    toxic = run_pipeline(spark, str(tmp_path / "toxic"), rows, [(i, 1, 1) for i, _, _ in rows if i])
    assert toxic == Counter({(8, digest("")): 1, (None, digest("")): 1})
    assert run_pipeline(spark, str(tmp_path / "empty"), [], []) == Counter()


def brute_near_copies(rows):
    """The rows that the stage keeps: of each component of five-word Jaccard >= 0.8 the first by (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1] or "")):
        first.setdefault(label[i], rows[i])
    return Counter(first.values())


def stage_rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_match_jaccard_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}é" for i in range(500)]
    line = " ".join(rng.choice(vocabulary) for _ in range(25))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 150))) for _ in range(60)]
    for t in texts[:40]:
        w = t.split()
        for _ in range(3):
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w[: len(w) - rng.randrange(min(len(w), 6))]))
    long = [rng.choice(vocabulary) for _ in range(120)]
    texts += [f"{' '.join(long[:-k])} tail{k}" for k in range(1, 40)]  # a chain: neighbours alike, ends not
    texts += [f"{line} only {i}" for i in range(12)] + [f"{line} {t}" for t in texts[:20]]
    texts += [None, "", " \n", "One", "one", texts[3], texts[3].upper(), "a b c d e", "a b c d"]
    rows = list(enumerate(texts))
    got = corpus_pipeline.drop_near_duplicates(spark, stage_rows(spark, rows).repartition(5), "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == brute_near_copies(rows)


def test_repeated_ids_with_other_texts_keep_their_rows(spark):
    say = lambda w, n=30: " ".join(f"{w}{i}" for i in range(n))
    rows = [(3, say("a")), (5, say("a")), (5, say("b")), (5, say("b")), (7, say("c")), (7, say("d")), (7, say("d", 31)), (8, None)]
    for parts in (1, 3):
        got = corpus_pipeline.drop_near_duplicates(spark, stage_rows(spark, rows).repartition(parts), "")
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, say("a")), (5, say("b")), (7, say("c")), (7, say("d")), (8, None)]) == brute_near_copies(rows)


def test_mixing_stage_uses_rows_and_not_ids(spark):
    rows = [(i, f"t{i} " * (i % 9), "big" if i % 8 else "small") for i in range(200)]
    rows += [(1, "x y", "small"), (1, "x z", "small"), (1, "x z", "small"), (2, "u", None), (2, "v", None), (2, "u v w", "big")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in [*rows, (None, "n", "big"), (None, "n", "big")]], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    want = Counter({(None, "big", 1): 2})
    for (i, s, n, _, _), k in brute_mix(rows, 2.0).items():
        want[i, s, n] += k
    assert got == want
