"""Near copies for stages that have to find all pairs whose word shingles have a Jaccard similarity of 4/5 or more.

SimHash comes first: the trie self-join of five-word fingerprints links most copies for little. But no budget of
differing bits finds every such pair (they differ in ten of 64 bits on average, and in any number), so what it leaves
apart is searched for by prefixes. All shingles have one order; of two sets that are similar enough, the first shingle
in common is among the first fifth of both, and so early that what follows can still overlap enough. This holds for any
order. Ours puts common shingles last: all shingles of all texts are counted, and what occurs in many texts has a class
in a table of fixed size that all tasks share. Each candidate of either kind is verified on the
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.llm import simhash
from weftspan.llm.common import batches_of, cut, distinct, expand, mix, scope, shuffles_removed, squeeze, total_bytes
from weftspan.llm.components import components

#: Slots of the table of classes, a byte each.
SLOTS = 1 << 22
#: A shingle in 2**(RARE + c) texts has class c.
RARE = 4
#: Of a hash so many bits more are counted than number the bytes of all texts, so that few shingles fall together.
SPARE = 10
#: Bytes of text that a share of the hash space stands for; hashes sent at a time.
SHARE_BYTES, SENT_HASHES = 1 << 22, 1 << 20
#: Parts that the sets with one common shingle are dealt into.
SALT = 1 << 10
#: Texts, or pairs of them, that a task is given at a time.
BATCH = 500
#: Rounds of one kind go on while one in so many of the pairs they look at is a link.
WORTH = 50
#: Keys that are sent to all tasks, with a number each (4 MB); more are joined by a shuffle.
SENT = 1 << 18


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z are lower-cased, a shorter text is one shingle."""
    return distinct(simhash.shingle_hashes(text, words))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 4/5 or more, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def identity(text: str = "text") -> Column:
    """16 bytes for each distinct text; null, empty and wordless texts are one text."""
    return F.unhex(F.md5(_body(text)))


def _body(text: str) -> Column:
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.col(text)).otherwise("").cast("binary")


def _packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype("<u8")
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def _classes(texts: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """The class of every slot: in how many texts the most common one of its shingles is; and the bits of a hash that count.

    Every shingle of every text is counted. Tasks send the first bits of their hashes, sorted and packed by share of the
    hash space, as many shares as it takes for one to fit in a task; copies that a task has read are left out.
    """
    size = total_bytes(texts, "t")
    shares, kept = 1 << max(4, (size // SHARE_BYTES).bit_length()), min(64, size.bit_length() + SPARE)
    drop, high = np.uint64(64 - kept), np.uint64(64 - shares.bit_length() + 1)

    def sent(hashes: list[np.ndarray]) -> pd.DataFrame:
        h = np.sort(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        share = (h >> high).astype(np.int64)
        ends = np.flatnonzero(np.diff(share, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(int)
        return pd.DataFrame({"share": share[starts[: len(ends)]], "packed": [_packed(h[a:b] >> drop) for a, b in zip(starts, ends, strict=False)]})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seen = [], 0, set()
        for b in batches:
            for key, t in zip(b["key"].to_numpy(np.int64).tolist(), b["t"], strict=True):
                if key not in seen:
                    seen.add(key)
                    held.append(shingles(t, words))
                    size += len(held[-1])
                if size >= SENT_HASHES:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    def common(blobs: list[bytes]) -> pd.DataFrame:
        h, n = np.unique(np.concatenate([_unpacked(x) for x in blobs]), return_counts=True)
        many = n >= 2 << RARE
        return pd.DataFrame({"slot": _slots(h[many] << drop, kept), "c": (np.floor(np.log2(n[many])) - RARE).astype(np.int8)})

    def count_shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share, held = None, []
        for b in batches:
            for s, blob in zip(b["share"], b["packed"], strict=True):
                if s != share and held:
                    yield common(held)
                    held = []
                share = s
                held.append(blob)
        if held:
            yield common(held)

    dealt = texts.select("key", "t").mapInPandas(gather, "share long, packed binary").repartition("share").sortWithinPartitions("share")
    found = dealt.mapInPandas(count_shares, "slot int, c byte").groupBy("slot").agg(F.max("c").alias("c")).toPandas()  # SLOTS rows at most
    table = np.zeros(SLOTS, np.uint8)
    table[found["slot"]] = found["c"]
    return table, kept


def _slots(h: np.ndarray, kept: int) -> np.ndarray:
    """Slots of the table of classes, from the first bits of hashes."""
    return (mix(h >> np.uint64(64 - kept)) & np.uint64(SLOTS - 1)).astype(np.int32)


def _prefixes(texts: DataFrame, linked: DataFrame, words: int, place: str) -> DataFrame:
    """(h, key, size, pos) of the sets by the shingles of their first fifth, where sets that share one are still apart.

    ``linked`` (key, c) has the components so far; a text that is in none is one by itself. ``place`` is where it is written.
    """
    known = texts.sparkSession.sparkContext.broadcast(_classes(texts, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, kept = known.value
        for b in batches:
            b, out = b.drop_duplicates("key"), {"h": [], "key": [], "place": [], "part": []}
            for key, t in zip(b["key"].to_numpy(np.int64), b["t"], strict=True):
                h = shingles(t, words)
                c = table[_slots(h, kept)]
                first = np.argsort(c, kind="stable")[: len(h) // 5 + 1]  # by class, then by hash
                out["h"].append(h[first].view(np.int64))
                out["key"].append(np.full(len(first), key))
                out["place"].append((len(h) << 32) + np.arange(len(first)))
                out["part"].append(np.where(c[first] > 0, key % SALT, -1))
            yield pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()}).astype({"part": np.int16})

    rows = texts.select("key", "t").mapInPandas(run, "h long, key long, place long, part short")
    rows = rows.join(_sent(linked), "key", "left").withColumn("c", F.coalesce("c", "key"))
    # Sets with a common shingle are many: they are dealt out and kept, the others are looked at by shingle.
    own = Window.partitionBy("h", "part")
    met = rows.withColumns({"x": F.min("c").over(own), "y": F.max("c").over(own)})
    apart = cut(met.filter((F.col("part") >= 0) | (F.col("x") < F.col("y"))).select("h", "key", "place"), place)
    return apart.select("h", "key", F.shiftright("place", 32).alias("size"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))


def _sent(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked to be sent to all tasks if it is small."""
    return F.broadcast(keys) if keys.count() <= SENT else keys


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> tuple[DataFrame, int]:
    """Those pairs (a, b) of keys whose sets are similar, as pairs of ids, and how many pairs were looked at.

    Only the texts of these pairs are moved, and what is written of them is removed again.
    """

    @F.pandas_udf("boolean")
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        read = lru_cache(64)(lambda t: shingles(t, words))
        for a, b in batches:
            yield pd.Series([similar(read(x), read(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    with scope(pairs.sparkSession) as outside:
        pairs = cut(pairs)
        looked = pairs.count()
        asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))
        asked = F.broadcast(asked) if 2 * looked <= SENT else _sent(cut(asked.distinct()))
        some = cut(texts.join(asked, "key", "left_semi").dropDuplicates(["id"]))
        left = some.select(F.col("key").alias("a"), F.col("id").alias("ia"), F.col("t").alias("ta"))
        right = some.select(F.col("key").alias("b"), F.col("id").alias("ib"), F.col("t").alias("tb"))
        both = pairs.join(right, "b").join(left, "a").filter(F.col("ia") != F.col("ib")).filter(check("ta", "tb"))
        return cut(both.select(F.col("ia").alias("a"), F.col("ib").alias("b")), outside), looked


def _may_overlap(x: str, y: str) -> Column:
    """Whether two sets that first meet in this shingle can still be similar."""
    c = lambda side, n: F.col(f"{side}.{n}")
    return 9 * F.least(c(x, "size") - c(x, "pos"), c(y, "size") - c(y, "pos")) >= 4 * (c(x, "size") + c(y, "size"))


def _all_pairs(live: DataFrame, best: bool) -> DataFrame:
    """All pairs (a, b) of sets that are still apart and, as far as their prefixes tell, may be similar; with ``best``,
    of each two components only the pair whose prefixes have most in common.

    Up to the end of the prefix that ends first in the order of shingles, all that two sets share is seen. Beyond it
    they share at most what is left of that set, and at most what the other has left after the last one they share. So
    of two sets of one size nearly half of the prefixes must agree; most pairs that met in a few shingles are left out.
    """
    met = live.alias("x").join(live.alias("y"), F.col("x.h") == F.col("y.h")).filter((F.col("x.c") != F.col("y.c")) & (F.col("x.key") < F.col("y.key")))
    most = lambda side: F.max(F.struct(F.col(f"{side}.pos").alias("pos"), F.col(f"{side}.size").alias("size"))).alias(side)
    pairs = met.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.count("*").alias("m"), most("x"), most("y"), F.min(F.least("x.c", "y.c")).alias("c"), F.min(F.greatest("x.c", "y.c")).alias("d"))
    left = lambda side: F.col(f"{side}.size") - F.floor(F.col(f"{side}.size") / 5) - 1
    after = lambda side: F.col(f"{side}.size") - F.col(f"{side}.pos") - 1
    beyond = F.greatest(F.least(left("x"), after("y")), F.least(left("y"), after("x")))
    pairs = pairs.filter(9 * (F.col("m") + beyond) >= 4 * (F.col("x.size") + F.col("y.size")))
    if best:
        common = F.struct(F.col("m") / (F.col("x.size") + F.col("y.size")), "a", "b")
        pairs = pairs.groupBy("c", "d").agg(F.max_by(F.struct("a", "b"), common).alias("p")).select("p.*")
    return pairs.select("a", "b")


def near_copies(docs: DataFrame, text: str = "text", words: int = 5) -> DataFrame:
    """(id, component) of the distinct texts that are linked to another; ids as ``identity`` gives them.

    Two texts link if the Jaccard similarity of their word shingles is 4/5 or more; components are those of all links.
    Pairs within one component need no further look, so that a large group of copies costs a few looks a text: SimHash
    links come first, then each set is compared with one other set of every shingle that it shares, another in each
    round, as long as that finds links; then components are compared by their likeliest pair, and only sets that are then
    still apart pair by pair. While it runs, tasks are given ``BATCH`` texts at a time, as each may be very long.
    """
    with batches_of(docs.sparkSession, BATCH), shuffles_removed(docs.sparkSession):
        return _near_copies(docs, text, words)


def _near_copies(docs: DataFrame, text: str, words: int) -> DataFrame:
    texts = docs.select(F.xxhash64(_body(text)).alias("key"), identity(text).alias("id"), F.col(text).alias("t"))
    prints = cut(simhash.fingerprints(texts, "key", "t", words).distinct())
    reps = cut(prints.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    equal = prints.join(_sent(reps.filter("n > 1")), "fp").filter("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    found, _ = _verified(simhash.links(reps).unionByName(equal), texts, words)
    found = cut(components(found).select(F.col("node").alias("a"), F.col("component").alias("b")))
    keys, rows, stage = cut(texts.select("key", "id").distinct()), None, 0  # one leader a shingle, best pairs, all pairs
    for k in count():
        with scope(docs.sparkSession) as outside:  # of what a round writes, its links stay alone
            linked = keys.withColumnRenamed("id", "a").join(_sent(found), "a")
            linked = cut(linked.select("key", F.xxhash64("b").alias("c")))
            rows = _prefixes(texts, linked, words, outside) if rows is None else rows
            live = rows.join(_sent(linked), "key", "left").withColumn("c", F.coalesce("c", "key"))
            mixed = live.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("h")
            live = cut(live.join(mixed, "h", "left_semi").distinct())
            if stage:
                pairs = _all_pairs(live, best=stage == 1)
            else:
                lead = live.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(k), "key").alias("o"), "key", "size", "pos", "c")).alias("l")).select("h", "l.*")
                met = live.alias("x").join(lead.alias("y"), F.col("x.h") == F.col("y.h")).filter((F.col("x.c") != F.col("y.c")) & _may_overlap("x", "y"))
                pairs = met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
            new, looked = _verified(pairs, texts, words)
            linking = new.count()
            if linking:
                found = _joined(found, new, outside)
        if stage == 2 or not looked:
            return found.select(F.col("a").alias("id"), F.col("b").alias("component"))
        stage += linking * WORTH < looked


def _joined(found: DataFrame, new: DataFrame, place: str) -> DataFrame:
    """``found``, the links (a, b) from every text to the smallest of its component, with the ``new`` links: only
    components and the new texts are joined, and the others follow theirs."""
    known = _sent(found)
    own = lambda end: known.select(F.col("a").alias(end), F.col("b").alias(f"of_{end}"))
    ends = new.join(own("a"), "a", "left").join(own("b"), "b", "left")
    apart = cut(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = _sent(components(apart).withColumnRenamed("component", "to"))
    old = found.join(moved, found["b"] == moved["node"], "left").select("a", F.coalesce("to", "b").alias("b"))
    fresh = moved.join(known, moved["node"] == known["a"], "left_anti").select(F.col("node").alias("a"), F.col("to").alias("b"))
    return cut(old.unionByName(fresh), place)
