"""SimHash near-duplicates: fingerprints, then a binary trie joined with itself.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link if they
differ in at most ``budget`` bits. The trie over all distinct fingerprints is walked by pairs of nodes: each pair
carries how many bits its two paths differ in, and is left as soon as that exceeds the budget.

To deal the walk out to many tasks, the bits are cut into ``budget + 2`` segments. With at most ``budget`` errors at
least two segments agree, so for each choice of two segments the fingerprints that agree in both are a trie of their
own, joined with itself; the choice and the agreeing bits are the rows' shuffle key. A trie of over ``SUBTREE``
fingerprints is dealt out again in the same way by other segments of the bits, so that no task gets a large one whole
and rows grow by a factor, not with the trie. What is left after the last level agrees in all but some ten bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as _xxh64

from weftspan.llm.common import cut, ranges, utf8
from weftspan.llm.components import components

BITS = 64
#: A trie with more fingerprints than this is dealt out again.
SUBTREE = 1 << 13
#: Fingerprints that a task walks at a time, in whole tries.
WALKED = 1 << 16
#: The order of the bits at each level: bit i * m mod 64 is the i-th. Each is cut into segments.
LEVELS = (1, 11, 23, 37)
#: A pair of nodes with at most this many pairs of fingerprints below is compared directly.
SMALL = 64
#: Node pairs that are expanded at a time, and pairs of fingerprints that are compared at a time.
FRONTIER, COMPARED = 1 << 16, 1 << 19


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included; A-Z are lower-cased, a shorter text is one shingle."""
    tokens = utf8(text).lower().split()  # on bytes both touch ASCII alone
    if not tokens:
        return np.zeros(0, np.uint64)
    body, size = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    last = ends[min(words, len(tokens)) - 1 :]
    return np.fromiter((_xxh64(body[a:b], 42) for a, b in zip((ends - size)[: len(last)].tolist(), last.tolist(), strict=True)), np.uint64, len(last))


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of one text; a bit that exactly half of the hashes have is 0."""
    h, ones = shingle_hashes(text, words), np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fp long): one row for each row of ``docs``. Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b["t"]), np.uint64, len(b))
            yield pd.DataFrame({"k": b["k"], "fp": fp.view(np.int64)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def masks(budget: int, order: int) -> list[int]:
    """For each choice of two of the budget + 2 segments, their bits as a signed 64-bit number."""
    n = budget + 2
    pieces = [sum(1 << i * order % BITS for i in range(BITS * k // n, BITS * (k + 1) // n)) for k in range(n)]
    both = [a | b for a, b in combinations(pieces, 2)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in both]


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining what the links (a, b) connect; a label is the smallest position of its tree."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return label


def trie_join(codes: np.ndarray, budget: int, start: np.ndarray | None = None) -> np.ndarray:
    """Labels of sorted distinct ``codes`` after linking all pairs within the budget.

    ``start``: bounds of runs of codes, each sorted and joined only with itself; without it there is one run.
    """
    n = len(codes)
    label = np.arange(n)
    if n < 2:
        return label
    if start is None:
        start = np.array([0, n])
    lo, hi = start[:-1], start[1:]
    keep = hi - lo > 1
    stack = [(BITS, lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(int(keep.sum()), np.int64))]
    ones_below: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones_below:
            ones_below[bit] = np.concatenate([[0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        c = ones_below[bit]
        return hi - (c[hi] - c[lo])

    while stack:
        bit, la, ha, lb, hb, d = stack.pop()
        if len(la) > FRONTIER:
            half = len(la) // 2
            stack += [(bit, *(x[:half] for x in (la, ha, lb, hb, d))), (bit, *(x[half:] for x in (la, ha, lb, hb, d)))]
            continue
        pairs = (ha - la) * (hb - lb)
        done = (pairs <= SMALL) | (bit == 0)
        if done.any():
            a0, a1, b0, b1 = la[done], ha[done], lb[done], hb[done]
            na, nb = a1 - a0, b1 - b0
            step = max(1, COMPARED // SMALL)
            for k in range(0, len(a0), step):
                s = slice(k, k + step)
                left = ranges(a0[s], na[s])
                times = np.repeat(nb[s], na[s])
                right = ranges(np.repeat(b0[s], na[s]), times)
                left = np.repeat(left, times)
                far = left < right
                left, right = left[far], right[far]
                near = np.bitwise_count(codes[left] ^ codes[right]) <= budget
                _forest(left[near], right[near], label)
        go = ~done
        if not go.any():
            continue
        la, ha, lb, hb, d = la[go], ha[go], lb[go], hb[go], d[go]
        bit -= 1
        ma, mb, same = split(la, ha, bit), split(lb, hb, bit), la == lb
        kids = [(la, ma, lb, mb, d), (ma, ha, mb, hb, d), (la, ma, mb, hb, d + 1)]
        other = ~same
        kids.append((ma[other], ha[other], lb[other], mb[other], d[other] + 1))
        joined = [np.concatenate(x) for x in zip(*kids, strict=True)]
        la, ha, lb, hb, d = joined
        keep = (ha > la) & (hb > lb) & (d <= budget) & ~((la == lb) & (ha - la < 2))
        stack.append((bit, la[keep], ha[keep], lb[keep], hb[keep], d[keep]))
    return label


def _walk(budget: int):
    """For mapInPandas over rows (key, fp, rep) sorted by key: the links of whole tries, many at a time."""

    def linked(key: np.ndarray, code: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((code, key))
        key, code, rep = key[order], code[order], rep[order]
        start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        label = trie_join(code, budget, start)
        moved = label != np.arange(len(label))
        return pd.DataFrame({"a": rep[moved], "b": rep[label[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for b in batches:
            more = b["key"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).view(np.uint64), b["rep"].to_numpy(np.int64)
            held = [np.concatenate(x) for x in zip(held, more, strict=True)]
            if len(held[0]) >= WALKED:
                whole = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
                yield linked(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        yield linked(*held)

    return run


def links(reps: DataFrame, budget: int = 4) -> DataFrame:
    """Spanning links (a, b) between the ``rep`` of distinct ``fp`` within the budget; never all pairs of a group."""

    def dealt(rows: DataFrame, level: int, *above: str) -> DataFrame:
        keys = [F.xxhash64(*above, F.lit(w), F.col("fp").bitwiseAND(F.lit(m))) for w, m in enumerate(masks(budget, LEVELS[level]))]
        return rows.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))

    rows, found = dealt(reps, 0), None
    for level in range(1, len(LEVELS) + 1):
        big = cut(rows.groupBy("key").count().filter(F.col("count") > SUBTREE).select("key")) if level < len(LEVELS) else None
        done = big is None or big.isEmpty()
        some = rows if done else rows.join(big, "key", "left_anti")
        walked = some.repartition("key").sortWithinPartitions("key").select("key", "fp", "rep").mapInPandas(_walk(budget), "a long, b long")
        found = walked if found is None else found.unionByName(walked)
        if done:
            return found.distinct()
        rows = dealt(rows.join(big, "key", "left_semi"), level, "key")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """(key, fingerprint, component_id): one row for each row of ``docs``; other columns may have any names.

    component_id is the smallest key reachable over links of at most ``budget`` differing bits, the row's own
    included. Null, empty and wordless texts have fingerprint 0 and link like any other; a bit on which the hashes tie
    is 0. Very long texts are read whole, one at a time. Equal fingerprints are first collapsed to their smallest key,
    so groups of copies cost one row. Repeated keys keep their rows. A null key takes no part in components and has
    null as its component. An empty table gives no rows.
    """
    own = cut(fingerprints(docs, key, text, words).withColumnRenamed(key, "k"))
    reps = cut(own.filter("k is not null").groupBy("fp").agg(F.min("k").alias("rep")))
    whole = components(cut(links(reps, budget)))
    named = cut(reps.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return own.join(named, "fp", "left").select(
        F.col("k").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("k").isNotNull(), F.col("component_id")).alias("component_id")
    )
