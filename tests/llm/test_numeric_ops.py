"""Fingerprints as sums, fill-in-middle and centroids, against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as xxh64

from weftspan.llm import centroids, fim, multiset

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts(n=60, seed=5):
    rng = np.random.default_rng(seed)
    line = lambda: " ".join(rng.choice(WORDS, rng.integers(0, 9)))
    made = ["\n".join(line() for _ in range(rng.integers(1, 7))) for _ in range(n)]
    odd = [None, "", " ", "\n", "\n\n", "a", "\t \x0b\x0c\r", "x\r\ny", "<P>", "a<S>b", "q <M", "\x01", "\x02\x01 \x010 \x021\x020", "née \U0001f600\U0001f601 ü\n" * 9, "w " * 5000, "no-space" * 2000, made[0], made[0], " lead", "trail "]
    return made + odd


# ---- fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_model(key, text):
    text = text or ""
    u, h = UNIT.findall(text), hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i * 8 : i * 8 + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h[3] % 100 < 80
    return len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_python(spark):
    rows = [(k if k % 9 else None, t, k) for k, t in enumerate(texts() * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumns({c: F.col("n") for c in ("k", "t", "u", "d", "form", "output")})
    got = fim.fill_in_middle(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = [(k, *fim_model(k, t), t or "") for k, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_escapes_are_undone(spark):
    odd = ["\x01", "\x02", "\x021", "\x020\x01", "a \x01\x01 \x02b\x021 c", "\x01 \x02 \x01"]
    rows = spark.createDataFrame([(i, t) for i in range(40) for t in odd], "doc_id long, text string")
    got = fim.fill_in_middle(rows, rate=100)
    assert got.filter("form = 'plain'").count() == 0
    assert sorted((r.doc_id, r.restored) for r in got.collect()) == sorted((i, t) for i in range(40) for t in odd)


def test_fill_in_middle_has_no_shuffle(spark):
    plan = fim.fill_in_middle(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# ---- fingerprints


def vector_model(text):
    text = text or ""
    units = [(b"line", x) for x in text.split("\n")] + [(b"words", x) for x in re.findall(multiset.GROUP, text)]
    hashes = [xxh64(x.encode(), xxh64(tag, 42)) for tag, x in units]
    out = [len(units) % multiset.MODULUS]
    for j in range(multiset.HASHES):
        hs = hashes if not j else [xxh64(j.to_bytes(4, "little"), xxh64(h.to_bytes(8, "little"), 42)) for h in hashes]
        for i in range(multiset.STEPS):
            lanes = [sum(h >> (i + multiset.LANE * k) & 1 for h in hs) % multiset.MODULUS for k in range(multiset.LANES)]
            out.append(sum(c << multiset.LANE * k for k, c in enumerate(lanes)))
    return out


def signed(vector):
    n, half = vector[0], multiset.HALF
    lanes = [x >> multiset.LANE * k & (multiset.MODULUS - 1) for x in vector[1:] for k in range(multiset.LANES)]
    return np.array([(2 * c - n + half) % multiset.MODULUS - half for c in lanes])


def likeness_model(a, b):
    if a == b:
        return 1.0
    x, y, d = signed(a), signed(b), signed([0, *([0] * (len(a) - 1))])
    lanes = lambda v: [q >> multiset.LANE * k & (multiset.MODULUS - 1) for q in v[1:] for k in range(multiset.LANES)]
    n = (a[0] - b[0]) % multiset.MODULUS
    d = np.array([(2 * (p - q) - n + multiset.HALF) % multiset.MODULUS - multiset.HALF for p, q in zip(lanes(a), lanes(b), strict=True)])
    return max(0.0, 1 - float((d * d).sum()) / float((x * x).sum() + (y * y).sum()))


def hexed(vector):
    return "".join(f"{x:016x}" for x in vector)


def test_edited_fingerprints_against_plain_python(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("k", "t", "d", "v", "n", "at", "copies")})
    got = {r.doc_id: r for r in multiset.edited_fingerprints(df).collect()}
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(rows):
        text, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own, other, following = vector_model(text), vector_model(edited), vector_model(after)
        r = got[k]
        assert (r.n_chars, r.edited_text) == (len(text), edited)
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(own), hexed(other)), k
        assert r.near_edited == pytest.approx(likeness_model(own, other)) and r.near_next == pytest.approx(likeness_model(own, following))


def test_repeated_rows_and_keys(spark):
    """Copies follow each other; keys that repeat are told apart by their texts; a null key comes first."""
    rows = [(None, "null one\ntwo three four five"), *[(1, "abcdefgh")] * 5, (2, "other text here"), (2, "and another text"), (3, "last one of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = multiset.edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    ones = [r for r in got if r.doc_id == 1]
    assert sorted(r.edited_text for r in ones)[:4] == ["abcdefab"] * 4 and sum(r.near_next == 1.0 for r in ones) == 4
    assert sum(r.doc_id == 2 for r in got) == 2
    last = next(r for r in got if r.doc_id == 3)
    assert last.edited_text == "last one of " + "nul"
    assert multiset.edited_fingerprints(df.limit(0)).count() == 0
    alone = multiset.edited_fingerprints(spark.createDataFrame([(4, "12345678")], "doc_id long, text string")).first()
    assert alone.edited_text == "12345612" and alone.near_next == 1.0


def test_order_of_paragraphs_and_incremental_edits(spark):
    df = spark.createDataFrame([(1, "a b c d\ne f\ng"), (2, "g\na b c d\ne f"), (3, "a b c d\ne f"), (4, "g"), (5, "a b c d\ne f\ng\ng"), (6, "a b c\nd e f\ng")], "doc_id long, text string")
    v = {r.doc_id: r for r in multiset.fingerprints(df).collect()}
    assert v[1].fingerprint == v[2].fingerprint
    assert len({r.fingerprint for r in v.values()}) == 5
    one = spark.createDataFrame([(v[3].vector, v[4].vector, v[1].vector)], "a array<long>, b array<long>, c array<long>")
    r = one.select(multiset.added("a", "b").alias("sum"), multiset.removed("c", "b").alias("less"), multiset.added(multiset.removed("b", "c"), F.col("c")).alias("back")).first()
    assert list(r["sum"]) == list(v[1].vector) and list(r["less"]) == list(v[3].vector) and list(r["back"]) == list(v[4].vector)


def test_components_wrap_around(spark):
    many = 3 * multiset.MODULUS + 5
    df = spark.createDataFrame([(1, "x\n" * (many - 1) + "x")], "doc_id long, text string")
    assert list(multiset.fingerprints(df).first().vector) == vector_model("x\n" * (many - 1) + "x")


def test_likeness_follows_what_is_shared(spark):
    rng = np.random.default_rng(1)
    lines = [" ".join(rng.choice(WORDS, 8)) + str(i) for i in range(200)]
    rows = [(i, "\n".join(lines[: 200 - i] + [" ".join(f"{w}{j}" for w in "abcdefgh") for j in range(i)])) for i in (0, 20, 60, 100, 200)]
    df = multiset.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    base = df.filter("doc_id = 0").select(F.col("vector").alias("base"))
    got = {r.doc_id: r.near for r in multiset.with_likeness(df.crossJoin(base), "vector", "base", "near").collect()}
    assert got[0] == 1.0 and got[200] < 0.25
    assert all(abs(got[i] - (1 - i / 200)) < 0.2 for i in (20, 60, 100))
    assert got[20] > got[60] > got[100] > got[200]


# ---- centroids


def lloyd(rows, k=16, rounds=3, seed=1):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            far = centroids.FARTHEST
            kept.append((key, [int(np.floor(64 * min(max(float(np.float32(x)), -far), far))) for x in v]))
    kept = [(key, [max(-centroids.FARTHEST, min(centroids.FARTHEST, x)) for x in v]) for key, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]

    def assign():
        return [min(((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)), key=lambda x: x) for _, v in kept]

    for _ in range(rounds):
        at = [j for _, j in assign()]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = assign()
    inertia = {}
    for d, j in last:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(key, j, d, inertia[j], sum(inertia.values()), sha[j]) for (key, _), (d, j) in zip(kept, last, strict=True)]


def vectors(n=300, seed=2, spread=0.05):
    rng = np.random.default_rng(seed)
    homes = rng.normal(size=(8, 64))
    return [(i, [float(np.float32(x)) for x in homes[i % 8] + rng.normal(scale=spread, size=64)]) for i in range(n)]


def found(df, **more):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r)[:6] for r in centroids.cluster(df, **more).collect()), key=key)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_clusters_against_plain_lloyd(spark, spread):
    rows = vectors(spread=spread)
    odd = [(None, rows[3][1]), (5, rows[7][1]), (5, rows[7][1]), (6, None), (7, [1.0] * 63), (8, [None] + [1.0] * 63), (9, [float("nan")] + [0.0] * 63), (10, [float("inf")] * 64), (11, [0.0] * 64), (12, [-0.0] * 64)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(3) for c in ("k", "v", "cluster", "distance", "e")})
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert found(df) == sorted(lloyd(rows + odd), key=key)


def test_ties_copies_and_few_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    far = [(i, [float((-1) ** i)] * 64) for i in range(100, 120)]
    for rows in (same, same + far, far[:3], far[:1], [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert found(df) == sorted(lloyd(rows))
    df = spark.createDataFrame(same + far, "vec_id long, embedding array<float>")
    assert found(df, k=1) == sorted(lloyd(same + far, k=1))
    assert found(df.limit(0)) == [] and found(df.select("vec_id", F.array(F.lit(1.0)).alias("embedding"))) == []


def test_bounds_save_scans(spark):
    df = spark.createDataFrame(vectors(400), "vec_id long, embedding array<float>")
    scans = [r.scans for r in centroids.cluster(df, rounds=6).collect()]
    assert max(scans) <= 7 and sum(scans) < 0.8 * 7 * 400


def test_bounds_hold_as_centroids_move():
    rng = np.random.default_rng(4)
    v, c = rng.integers(-90, 90, (500, 8)), rng.integers(-90, 90, (6, 8))
    number, first, second = centroids.nearest(v, c)
    upper, lower = centroids.above(first), centroids.below(second)
    for _ in range(8):
        after = c + rng.integers(-9, 10, c.shape)
        drift = centroids.above(((after - c) ** 2).sum(axis=1))
        number, upper, lower, _ = centroids.reassign(v, number, upper, lower, drift, after)
        d = np.sqrt(((v[:, None, :] - after[None]) ** 2).sum(axis=2))
        assert (number == d.argmin(axis=1)).all()
        own = d[np.arange(500), number]
        assert (upper >= own).all()
        d[np.arange(500), number] = np.inf
        assert (lower <= d.min(axis=1)).all()
        c = after
