"""Small helpers that several of the text operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.lineage import cut, scope, shared_folder, shuffles_removed

__all__ = ["cut", "scope", "shared_folder", "shuffles_removed"]

#: The characters that separate words, as a Java regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"

MASK64 = (1 << 64) - 1


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes buckets so that each fits in one task's memory."""
    return docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks of the jobs that run inside are given at most so many rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as the empty text."""
    return text.encode() if isinstance(text, str) else b""


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes (the published splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster than a table for millions of hashes)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def pack(values: np.ndarray, level: int = 3) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes: small numbers cost little."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return squeeze(np.ascontiguousarray(planes).tobytes(), level)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c) for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(starts, counts)


def each_copy(rows: DataFrame, copies: str = "copies", out: str = "copy", step: int = 1024) -> DataFrame:
    """``rows`` as often as ``copies`` says, numbered from 1; in two steps, so that no array is as long as a hot row's copies."""
    many, first = F.col(copies).cast("long"), F.col("_block") * step
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((many - 1) / step))))
    return blocks.withColumn(out, F.explode(F.sequence(first + 1, F.least(first + step, many)))).drop("_block", copies)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
