"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. A chunk of documents keeps the sequence of its words' numbers within the chunk (the
exploded positions), and sends each of its distinct words once to the word's share of the hash space. There every
distinct word is encoded once and its ids are joined back to the chunks that use it, where the documents are put
together by position. Two steps differ from a plain join: positions travel as one packed row for each chunk instead of
a row for each word, and decoding looks the ids up in the table of token bytes, which is as large as the vocabulary and
no larger, and which each task reads from the vocabulary file, instead of joining it as a table.

Words travel in packed rows, one for each chunk and share, so a frequent word costs one entry for each chunk. The
chunk's ``COMMON`` most frequent words have the smallest numbers, so that sequences pack well; all others are numbered
by share and then in byte order, so that their numbers need not travel.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.common import expand, pack, parts, ranges, squeeze, total_bytes, unpack

#: Characters of text, about, that make one chunk, and those that a row counts for besides its text.
CHUNK_CHARS, ROW_CHARS = 16 << 20, 64
#: Text bytes whose words' ids meet in one share.
SHARE_BYTES = 32 << 20
#: Frequent words of a chunk that are numbered by how often they occur.
COMMON = 1 << 13


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file with a base64 token and a rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge adjacent parts, the pair of least rank first (leftmost on ties), until no pair is a token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    pieces = [word[i : i + 1] for i in range(len(word))]
    if len(pieces) > 400:
        return _encode_long(pieces, ranks)
    far = len(ranks)
    cost = [ranks.get(a + b, far) for a, b in zip(pieces, pieces[1:], strict=False)]
    while cost:
        least = min(cost)
        if least == far:
            break
        i = cost.index(least)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del cost[i]
        if i < len(cost):
            cost[i] = ranks.get(pieces[i] + pieces[i + 1], far)
        if i:
            cost[i - 1] = ranks.get(pieces[i - 1] + pieces[i], far)
    return [ranks[p] for p in pieces]


def _encode_long(pieces: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap over a linked list, for words of very many bytes."""
    import heapq

    n = len(pieces)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := pieces[i] + pieces[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i] if pieces[i] is not None else -1
        if j < 0 or pieces[i] + pieces[j] != p:
            continue
        pieces[i], pieces[j] = p, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] >= 0 and (q := pieces[a] + pieces[after[a]]) in ranks:
                heapq.heappush(heap, (ranks[q], a, q))
    return [ranks[p] for p in pieces if p is not None]


@lru_cache(1)
def _table(ranks_path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """(ranks, all token bytes end to end, start of each id, length of each id)."""
    ranks = load_ranks(ranks_path)
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for token, i in ranks.items():
        by_id[i] = token
    length = np.fromiter(map(len, by_id), np.int64, size)
    return ranks, np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(length) - length, length


def decode(ids: np.ndarray, ranks_path: str) -> bytes:
    """The bytes of a sequence of ids, joined from the token-byte table."""
    _, data, start, length = _table(ranks_path)
    return data[ranges(start[ids], length[ids])].tobytes()


def _frame(*parts_: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts_)


def _unframe(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        (n,) = struct.unpack_from("<I", blob, at)
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


PACKED = "share int, chunk long, blob binary"


def _chunk_rows(number: int, keys: list, sequences: list[np.ndarray], known: dict[str, int], shares: int) -> pd.DataFrame:
    """A row of the chunk's keys and sequences (share < 0), and a row of distinct words for each share."""
    words = [w.encode() for w in known]
    flat = np.concatenate(sequences)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    share = ((h >> np.uint64(40)) * np.uint64(shares) >> np.uint64(24)).astype(np.int64)
    top = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")[:COMMON]
    rank = np.zeros(len(words), np.int64)
    rank[top] = np.arange(1, len(top) + 1)  # 0: not among the common
    by = sorted(range(len(words)), key=lambda i: (share[i], words[i]))
    order = np.array(by, np.int64)
    numbers = np.empty(len(words), np.int64)
    rare = rank[order] == 0
    numbers[order[rare]] = len(top) + np.arange(int(rare.sum()))
    numbers[top] = rank[top] - 1
    known_key = np.array([k is not None for k in keys])
    key = np.array([k or 0 for k in keys], np.int64).view(np.uint64)
    ends = _frame(known_key.tobytes(), pack(np.concatenate([key & np.uint64(0xFFFFFFFF), key >> np.uint64(32)])), pack(np.fromiter(map(len, sequences), np.uint32, len(sequences))), pack(numbers[flat], 6))
    rows = [(-1 - (number + (number >> 32)) % shares, number, ends)]
    at = np.flatnonzero(np.diff(share[order])) + 1
    for part in np.split(order, at) if len(order) else ():
        mine = [words[i] for i in part.tolist()]
        rows.append((int(share[part[0]]), number, _frame(pack(rank[part]), pack(np.fromiter(map(len, mine), np.uint32, len(mine))), squeeze(b"".join(mine), 6))))
    return pd.DataFrame(rows, columns=["share", "chunk", "blob"])


def _split(pattern: str, shares: int) -> Callable:
    """Chunks of documents, as packed rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = regex.compile(pattern).findall
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        keys, sequences, known, size = [], [], {}, 0
        for b in batches:
            for k, t in zip((None if pd.isna(x) else int(x) for x in b["k"]), b["t"], strict=True):
                words = find(t) if isinstance(t, str) else []
                keys.append(k)
                sequences.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words)))
                size += ROW_CHARS + (len(t) if isinstance(t, str) else 0)
                if size >= CHUNK_CHARS:
                    yield _chunk_rows(number, keys, sequences, known, shares)
                    number, keys, sequences, known, size = number + 1, [], [], {}, 0
        if keys:
            yield _chunk_rows(number, keys, sequences, known, shares)

    return run


def _encode(ranks_path: str) -> Callable:
    """All rows of some shares: sequences pass through, each distinct word is encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = _table(ranks_path)[0]
        known: dict[bytes, list[int]] = {}
        share = None
        for b in batches:
            blobs = []
            for s, blob in zip(b["share"].tolist(), b["blob"], strict=True):
                if s < 0:
                    blobs.append(blob)
                    continue
                if s != share:
                    share, known = s, {}
                rank, lengths, data = _unframe(blob)
                data, out, at = expand(data), [], 0
                for n in unpack(lengths).tolist():
                    w = data[at : at + n]
                    at += n
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode_word(w, ranks)
                    out.append(ids)
                flat = np.fromiter((i for x in out for i in x), np.uint32)
                blobs.append(_frame(rank, pack(np.fromiter(map(len, out), np.uint32, len(out)), 6), pack(flat, 6)))
            yield b.assign(blob=blobs)

    return run


def _assemble(ranks_path: str, ids_too: bool, text_too: bool) -> Callable:
    """One chunk's sequences and the ids of its words: the ids of each document, and what they decode to."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("share")
        none = [np.zeros(0, np.uint32)]
        words = [tuple(map(unpack, _unframe(blob))) for blob in pdf.loc[pdf["share"] >= 0, "blob"]]
        rank, counts, ids = (np.concatenate([x[i] for x in words] or none).astype(np.int64) for i in range(3))
        begin = np.cumsum(counts) - counts
        start, length = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        rare = rank == 0
        numbers = np.empty(len(rank), np.int64)
        numbers[~rare] = rank[~rare] - 1
        numbers[rare] = int((~rare).sum()) + np.arange(int(rare.sum()))
        start[numbers], length[numbers] = begin, counts
        known_key, keys, sizes, flat = _unframe(pdf.loc[pdf["share"] < 0, "blob"].iloc[0])
        low, high = unpack(keys).astype(np.uint64).reshape(2, -1)
        keys, flat, rows, at = (low | high << np.uint64(32)).view(np.int64).tolist(), unpack(flat), [], 0
        for k, has, n in zip(keys, np.frombuffer(known_key, bool).tolist(), unpack(sizes).tolist(), strict=True):
            seq = flat[at : at + n]
            at += n
            own = ids[ranges(start[seq], length[seq])].astype("<u4")
            text = decode(own, ranks_path)
            rows.append((k if has else None, len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest(), own.view(np.int32) if ids_too else None, text.decode() if text_too else None))
        out = pd.DataFrame(rows, columns=["k", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])
        return out.assign(k=pd.array([r[0] for r in rows], dtype="Int64"))

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True, decoded: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, ids, decoded): one row for each row of ``docs``.

    ids are those of the vocabulary in ``ranks_path`` for each match of ``pattern`` on its own, in order; no special
    tokens. The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that they decode to;
    ``ids`` and the ``decoded`` text themselves are null if not asked for. Null and empty texts have no tokens. Keys are
    integers and may be null or repeat; other columns may have any names. Very long texts are one chunk each. An empty
    table gives no rows. Chunks are
    numbered by the task that reads them, so ``docs`` should be a scan (a table read from files) or a checkpoint,
    whose partitions come out the same when a task is repeated.
    """
    spark = docs.sparkSession
    shares = max(16, parts(spark), -(-total_bytes(docs, text) // SHARE_BYTES))  # what a task holds does not grow with the input
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(_split(pattern, shares), PACKED)
    encoded = rows.repartitionById(shares, F.pmod("share", F.lit(shares))).sortWithinPartitions("share").mapInPandas(_encode(ranks_path), PACKED)
    out = "k long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
    return encoded.groupBy("chunk").applyInPandas(_assemble(ranks_path, ids, decoded), out).withColumnRenamed("k", key)


def decode_column(rows: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that a column of id arrays decodes to (null for null; invalid UTF-8 is replaced)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else decode(np.asarray(x, np.int64), ranks_path).decode("utf-8", "replace"))

    return rows.withColumn(out, run(F.col(ids)))
