"""Substring dedup: fixed reference blocks as anchors, probed by every rolling window, extended to exact repeats.

Every window of ``window`` words holds at least one whole reference block: blocks of ``window // 2`` words that start
at multiples of their length within a document. So a repeat of a window shows up as a rolling block hash that is also
the hash of a reference block of some document. Three shuffles of packed hashes carry this:

1. Documents are dealt into buckets that fit in one task's memory. Each bucket sends each distinct rolling block
   hash once, marked if it is a reference block there and if it occurs more than once there.
2. Each share of the hash space finds the hashes that are a reference block somewhere and occur at two or more places
   (the hits) and returns them to their buckets, which extend them: the windows that contain a hit, with their first
   place in the bucket.
3. Each share of the window hashes returns to a bucket those windows that start earlier in another bucket. The bucket
   then removes the words that repeated windows cover: the maximal exact repeats.

A hash travels once for each bucket, so a passage that a third of all documents share costs as much as a unique one.
Whole texts that a smaller key has too take no part: all of their windows start earlier, in that row.
Block hashes only choose what is looked at (a chance hit costs time, not correctness); windows are told apart by their
share of the hash space and 64 independent bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.common import cut, distinct, mix, pack, parts, unpack, utf8

#: Bytes that one bucket should have, and those whose hashes meet in one share: some three million of 4 bytes.
BUCKET_BYTES, SHARE_BYTES = 2 << 20, 16 << 20
#: Bytes that a row counts for besides its text, so that any number of empty texts is dealt out too.
ROW_BYTES = 128
#: Equal rows that are kept together at most; of more, each so many in the order of the scan have a bucket of their own.
EQUAL_ROWS = 1 << 10
#: Texts that occur again, up to which their digests are sent to all executors.
SENT_ROWS = 1 << 19
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words: sums of word hashes times powers of the base, modulo 2**64."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for i in range(length):
        out += h[i : i + n] * np.uint64(power)
        power = power * base & (1 << 64) - 1
    return mix(out)


class Bucket:
    """The words of one bucket's documents, end to end, in the order of their keys."""

    def __init__(self, keys: np.ndarray, texts: list[str | None], window: int):
        self.window, self.block = window, window // 2
        self.keys = keys
        self.words = [utf8(t).split() for t in texts]
        self.count = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.hash = np.concatenate([np.zeros(0, np.uint64), *map(word_hashes, self.words)])
        self.doc = np.repeat(np.arange(len(keys)), self.count)
        self.at = np.arange(len(self.hash)) - np.repeat(self.start, self.count)

    def starts(self, length: int) -> np.ndarray:
        """Places where a run of ``length`` words of one document starts."""
        places = np.arange(max(0, len(self.hash) - length + 1))
        return places[self.at[places] + length <= self.count[self.doc[places]]]

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all rolling blocks of documents that have a whole window."""
        places = self.starts(self.block)
        places = places[self.count[self.doc[places]] >= self.window]
        return places, rolling(self.hash, self.block, BASES[0])[places]

    def windows(self, hits: np.ndarray) -> np.ndarray:
        """Places of the windows that contain a block whose hash is one of the sorted ``hits``."""
        places, h = self.blocks()
        hit = np.zeros(len(self.hash) + 1, np.int64)
        if len(hits):
            hit[places[hits[np.searchsorted(hits, h).clip(max=len(hits) - 1)] == h]] = 1
        upto = np.concatenate([[0], np.cumsum(hit)])
        first = self.starts(self.window)
        return first[upto[first + self.window - self.block + 1] > upto[first]]


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, as compressed differences."""
    d = np.diff(keys.astype(np.int64), prepend=np.int64(0)).view(np.uint64)
    return pack(np.concatenate([d & np.uint64(0xFFFFFFFF), d >> np.uint64(32)]))


def unpack_keys(blob: bytes) -> np.ndarray:
    low, high = unpack(blob).astype(np.uint64).reshape(2, -1)
    return np.cumsum((low | high << np.uint64(32)).view(np.int64))


def _dealt(h: np.ndarray, shares: int) -> np.ndarray:
    """The share of the hash space that a hash belongs to, from its top bits."""
    return ((h >> np.uint64(40)) * np.uint64(shares) >> np.uint64(24)).astype(np.int64)


def _groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(key[part[0]]), part


def _send_blocks(window: int, shares: int, low_bits: int) -> Callable:
    """Step 1. One row for each share: 4 sets of hashes, by whether they are a reference block and occur twice."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = _bucket(pdf, window)
        places, h = b.blocks()
        anchor = b.at[places] % b.block == 0
        seen, back, times = np.unique(h, return_inverse=True, return_counts=True)
        ref = np.zeros(len(seen), bool)
        ref[back[anchor]] = True
        kind, share = ref * 2 + (times > 1), _dealt(seen, shares)
        low = (seen & np.uint64((1 << low_bits) - 1)).astype(f"<u{low_bits // 8}")
        rows = [(x // 4, key[0], x % 4, low[p].tobytes()) for x, p in _groups(share * 4 + kind)]
        return pd.DataFrame(rows, columns=["share", "bucket", "kind", "blob"])

    return run


def _find_hits(low_bits: int) -> Callable:
    """Step 2a. Of all buckets' hashes in one share: those to send back to each bucket."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(x, f"<u{low_bits // 8}") for x in pdf["blob"]]
        sizes = [len(x) for x in arrays]
        h = np.concatenate(arrays)
        kind = np.repeat(pdf["kind"].to_numpy(np.int8), sizes)
        bucket = np.repeat(pdf["bucket"].to_numpy(np.int64), sizes)
        order = np.argsort(h)
        h, kind, bucket = h[order], kind[order], bucket[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        ref = np.maximum.reduceat(kind >> 1, at) > 0
        places = np.add.reduceat(1 + (kind & 1), at)
        hit = (ref & (places > 1))[group]
        h, bucket = h[hit], bucket[hit]
        rows = [(key[0], k, h[p].tobytes()) for k, p in _groups(bucket)]
        return pd.DataFrame(rows, columns=["share", "bucket", "blob"])

    return run


def _names(share: np.ndarray, low: np.ndarray, low_bits: int) -> np.ndarray:
    """One number for each share and low bits of a hash."""
    return low.astype(np.uint64) | (share.astype(np.uint64) << np.uint64(low_bits) if low_bits < 64 else np.uint64(0))


def _hits(answers: pd.DataFrame, b: Bucket, shares: int, low_bits: int) -> np.ndarray:
    """The full hashes of this bucket that the answers name by share and low bits."""
    _, h = b.blocks()
    seen = distinct(h)
    low = [np.zeros(0, f"<u{low_bits // 8}"), *(np.frombuffer(x, f"<u{low_bits // 8}") for x in answers["blob"])]
    share = np.repeat(np.array([0, *answers["share"]], np.int64), [len(x) for x in low])
    own = _names(_dealt(seen, shares), seen & np.uint64((1 << low_bits) - 1), low_bits)
    return seen[np.isin(own, _names(share, np.concatenate(low), low_bits))]


def _bucket(pdf: pd.DataFrame, window: int) -> Bucket:
    pdf = pdf.sort_values(["k", "t"], kind="stable", na_position="first")
    b = Bucket(pdf["k"].to_numpy(np.int64), list(pdf["t"]), window)
    b.rows = pdf
    return b


def _first_places(b: Bucket, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share hash, other hash, place) of the distinct windows at ``places``, each at its first place."""
    h, g = rolling(b.hash, b.window, BASES[0])[places], rolling(b.hash, b.window, BASES[1])[places]
    order = np.lexsort((places, g, h))
    h, g, places = h[order], g[order], places[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
    return h[first], g[first], places[first]


def _send_windows(window: int, shares: int, low_bits: int) -> Callable:
    """Step 2b. The bucket's windows around its hits, by share, each with the key and start of its first place."""

    def run(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(answers):
            return pd.DataFrame({"share": [], "bucket": [], "hashes": [], "keys": [], "starts": []})
        b = _bucket(docs, window)
        h, g, places = _first_places(b, b.windows(_hits(answers, b, shares, low_bits)))
        keys, at = b.keys[b.doc[places]], b.at[places]
        rows = []
        for s, p in _groups(_dealt(h, shares)):
            p = p[np.argsort(places[p])]  # keys then ascend: their differences are small, and mostly 0
            rows.append((s, key[0], g[p].astype("<u8").tobytes(), pack_keys(keys[p]), pack(at[p])))
        return pd.DataFrame(rows, columns=["share", "bucket", "hashes", "keys", "starts"])

    return run


def _find_later(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 3a. For each bucket, those of its windows that start earlier in another bucket."""
    g = np.frombuffer(b"".join(pdf["hashes"]), "<u8")
    keys, starts = np.concatenate([*map(unpack_keys, pdf["keys"])]), np.concatenate([*map(unpack, pdf["starts"])])
    bucket = np.repeat(pdf["bucket"].to_numpy(np.int64), [len(x) // 8 for x in pdf["hashes"]])
    order = np.argsort(g)
    alike = np.concatenate([[False], g[order[1:]] == g[order[:-1]], [False]])
    several = order[alike[1:] | alike[:-1]]  # most windows are in one bucket only
    order = several[np.lexsort((starts[several], bucket[several], keys[several], g[several]))]
    g, bucket = g[order], bucket[order]
    later = np.concatenate([[False], g[1:] == g[:-1]])[: len(g)]
    g, bucket = g[later], bucket[later]
    rows = [(k, g[p].tobytes()) for k, p in _groups(bucket)]
    return pd.DataFrame(rows, columns=["bucket", "blob"])


def _keep(window: int, shares: int, low_bits: int, texts: bool) -> Callable:
    """Step 3b. What is left of each document."""

    def run(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = _bucket(docs, window)
        gone = np.zeros(len(b.hash), bool)
        hits = answers[answers["share"] >= 0]
        if len(hits):
            places = b.windows(_hits(hits, b, shares, low_bits))
            _, g, first = _first_places(b, places)
            elsewhere = np.frombuffer(b"".join(answers.loc[answers["share"] < 0, "blob"]), "<u8")
            repeated = np.ones(len(b.hash), bool)  # of a bucket's equal windows all but the first are later
            repeated[first[~np.isin(g, elsewhere)]] = False
            repeated = places[repeated[places]]
            edge = np.zeros(len(b.hash) + 1, np.int64)
            np.add.at(edge, repeated, 1)
            np.add.at(edge, repeated + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
        kept, removed, out, docs_text = [], [], [], list(b.rows["t"])
        for words, start, n in zip(b.words, b.start, b.count, strict=True):
            mask = gone[start : start + n]
            removed.append(int(mask.sum()))
            left = b" ".join([w for w, x in zip(words, mask.tolist(), strict=True) if not x] if removed[-1] else words)
            kept.append(hashlib.sha256(left).hexdigest())
            out.append(None if not texts else left.decode() if removed[-1] else docs_text[len(out)])
        found = pd.DataFrame({"k": b.keys, "n_words": b.count, "n_removed": removed, "kept_sha256": kept, "kept": pd.Series(out, dtype=object)})
        return found.assign(**{c: b.rows[c].to_numpy() for c in b.rows.columns if c.startswith("carried_")})

    return run


def _untouched(*args) -> Callable:
    """Rows without a key: every one on its own, with nothing to answer."""
    keep = _keep(*args)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield keep((0,), b.assign(k=0), pd.DataFrame({"share": [], "blob": []})).assign(k=None)

    return run


def _copied(window: int, texts: bool) -> Callable:
    """Rows whose whole text a smaller key has too: a text of at least one window loses all words, a shorter one none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [utf8(t).split() for t in b["t"]]
            gone = [len(w) >= window for w in words]
            left = [hashlib.sha256(b"" if x else b" ".join(w)).hexdigest() for w, x in zip(words, gone, strict=True)]
            kept = [None if not texts else "" if x else t for t, x in zip(b["t"], gone, strict=True)]
            counts = {"n_words": [len(w) for w in words], "n_removed": [len(w) * x for w, x in zip(words, gone, strict=True)]}
            yield b.drop(columns="t").assign(**counts, kept_sha256=left, kept=pd.Series(kept, b.index, dtype=object))

    return run


def _without_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of each text that have its smallest key, and the others; ``place`` is a row's in the scan."""
    rows = rows.withColumn("d", F.unhex(F.sha2(F.coalesce("t", F.lit("")), 256))).withColumn("place", F.floor(F.monotonically_increasing_id() / EQUAL_ROWS))
    again = cut(rows.groupBy("d").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last").drop("last"))
    marked = rows.join(F.broadcast(again) if again.count() <= SENT_ROWS else again, "d", "left")
    return marked.filter("first is null or k = first").drop("d", "first"), marked.filter("k > first").drop("d", "first", "place")


def _dealt_out(rows: DataFrame) -> tuple[int, DataFrame, int]:
    """Bytes of all rows, ``rows`` with a bucket each, and how many buckets there are."""
    rows = rows.withColumn("h", F.xxhash64("k", "t"))
    own = F.coalesce(F.octet_length("t"), F.lit(0)).cast("long") + ROW_BYTES
    alike = cut(rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(own).alias("bytes")))
    size = alike.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    many = alike.filter(F.col("n") > EQUAL_ROWS).select("h", F.lit(True).alias("many"))
    if not many.isEmpty():
        placed = rows if "place" in rows.columns else rows.withColumn("place", F.floor(F.monotonically_increasing_id() / EQUAL_ROWS))
        rows = placed.join(many, "h", "left").withColumn("h", F.when(F.col("many"), F.xxhash64("h", "place")).otherwise(F.col("h")))
    return size, rows.withColumn("bucket", F.pmod("h", F.lit(buckets))).drop("h", "many", "place"), buckets


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, texts: bool = True, carry: tuple[str, ...] = (), low_bits: int = 32) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept, carried columns): one row for each row of ``docs``.

    Columns of ``docs`` named in ``carry`` come along; all others are left behind and may have any names.

    A word goes if a run of ``window`` words that covers it also starts earlier: in a row with a smaller key, or
    earlier in the same document. ``kept`` is the remaining words joined by one space, or the text as it is if all
    remain (null if ``texts`` is off); ``kept_sha256`` is always of the joined words.
    Null, empty and short texts lose nothing; very long ones are read whole, in a bucket of their own size. Rows that
    repeat a key have a fixed order among themselves (by bucket, a hash of key and text, and then by text), and are
    dealt out like others; so are equal rows where they are many, by their place, so ``docs`` should be a scan (a table
    read from files) or a checkpoint, whose rows come out in one order when a task is repeated. The key is an integer; rows with a null key come out unchanged, as they have no place in
    the order. An empty table gives no rows.

    ``low_bits`` (32 or 64) is how much of a block's hash travels besides its share of the hash space.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    firsts, copies = _without_copies(named.filter("k is not null"))
    size, dealt, buckets = _dealt_out(firsts)
    shares = max(16, parts(spark), -(-size // SHARE_BYTES))  # what a task holds does not grow with the input
    by_bucket = dealt.repartition(min(buckets, 4 * shares), "bucket").groupBy("bucket")
    blocks = by_bucket.applyInPandas(_send_blocks(window, shares, low_bits), "share int, bucket long, kind int, blob binary")
    hits = blocks.repartition(shares, "share").groupBy("share").applyInPandas(_find_hits(low_bits), "share int, bucket long, blob binary")
    windows = by_bucket.cogroup(hits.groupBy("bucket")).applyInPandas(_send_windows(window, shares, low_bits), "share int, bucket long, hashes binary, keys binary, starts binary")
    later = windows.repartition(shares, "share").groupBy("share").applyInPandas(_find_later, "bucket long, blob binary")
    answers = hits.unionByName(later.withColumn("share", F.lit(-1)))
    kinds = "".join(f", carried_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = f"k long, n_words long, n_removed long, kept_sha256 string, kept string{kinds}"
    kept = by_bucket.cogroup(answers.groupBy("bucket")).applyInPandas(_keep(window, shares, low_bits, texts), out)
    lone = named.filter("k is null").mapInPandas(_untouched(window, shares, low_bits, texts), out)
    whole = kept.unionByName(lone).unionByName(copies.mapInPandas(_copied(window, texts), out))
    return whole.select(F.col("k").alias(key), "n_words", "n_removed", "kept_sha256", "kept", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)))
