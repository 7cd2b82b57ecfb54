"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken over all training texts, in tasks, and summed by language and bucket. The matrix of log probabilities
has a row for each hash bucket and a column for each language. Its size is bounded: ``BUCKETS`` rows up to
``CELLS / BUCKETS`` languages (256), and half as many rows each time the languages double, down to ``FEWEST``. That is
32 MB for up to 8,192 languages, which is more than there are; each further label costs 4 kB. It is broadcast.

Texts are scored in batches: the distinct n-gram buckets of all texts of a batch and how often each occurs are the rows
of a sparse matrix, whose product with the log probabilities is taken in numpy for all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.common import mix

BUCKETS, FEWEST, CELLS = 1 << 15, 1 << 10, 1 << 23
#: n-grams of 1 to this many characters.
LONGEST = 3
#: Characters of text that are hashed at a time; longer texts are read in pieces.
PIECE = 1 << 18
#: Products of the sparse matrix that are held at a time.
HELD = 1 << 20
#: What a text without letters (or no text) is given.
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, everything but letters as a space, with a space before and after."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[c], c, np.uint32(32))


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a piece list, in batches; runs of spaces count once and single spaces not at all."""
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint64)
    for at in range(0, len(codes), PIECE):
        c = codes[at : at + PIECE + LONGEST - 1]
        own, h = min(PIECE, len(codes) - at), np.zeros(len(c), np.uint64)
        for n in range(1, LONGEST + 1):
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            start = h[:own]
            yield (mix(start if n > 1 else start[c[: len(start)] != 32]) & np.uint64(BUCKETS - 1)).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def count_grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for g in grams(_codes(text)):
        total += np.bincount(g, minlength=BUCKETS)
    return total.reshape(-1, buckets).sum(axis=0)


def buckets_for(languages: int) -> int:
    """Rows of the matrix: fewer the more languages there are, so that it keeps its size."""
    buckets = BUCKETS
    while buckets > FEWEST and buckets * languages > CELLS:
        buckets //= 2
    return buckets


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability, under equal priors; ties go to the name
        that sorts first."""
        names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        wide, at = max(1, HELD // max(1, len(self.languages))), 0
        while at < len(known):
            rows, held = [], 0
            while at + len(rows) < len(known) and (not rows or held < wide):
                counts = count_grams(texts[known[at + len(rows)]], len(self.log_p))
                bucket = np.flatnonzero(counts)
                rows.append((bucket, counts[bucket]))
                held += len(bucket)
            z = self._products(rows)
            best = z.argmax(axis=1)
            own = known[at : at + len(rows)]
            names[own] = np.array(self.languages, object)[best]
            scores[own] = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
            at += len(rows)
        return list(names), scores

    def _products(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(texts, languages): the sparse rows (buckets, counts) times the matrix; no row is empty."""
        bucket, count = (np.concatenate(x) for x in zip(*rows, strict=True))
        first = np.cumsum([0, *(len(b) for b, _ in rows[:-1])])
        return np.add.reduceat(self.log_p[bucket].astype(np.float64) * count[:, None], first, axis=0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count over all rows of ``docs`` that have a text with letters and a language; any number of languages."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    languages = sorted(r["l"] for r in rows.select("l").distinct().collect())
    number, buckets = {x: i for i, x in enumerate(languages)}, buckets_for(len(languages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for t, x in zip(b["t"], b["l"], strict=True):
                if has_letter(t):
                    own = total.setdefault(number[x], np.zeros(buckets, np.int64))
                    own += count_grams(t, buckets)
        for i, own in total.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"l": np.full(len(at), i, np.int32), "b": at.astype(np.int32), "n": own[at]})

    def weigh(counted: pd.DataFrame) -> pd.DataFrame:
        total = np.full(buckets, 0.5)
        total[counted["b"]] += counted["n"]
        return pd.DataFrame({"l": counted["l"].iloc[:1], "p": [(np.log(total) - np.log(total.sum())).astype("<f4").tobytes()]})

    counted = rows.mapInPandas(run, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    log_p = np.full((len(languages), buckets), -np.log(buckets), np.float32)  # a language of texts without letters
    for r in counted.groupBy("l").applyInPandas(weigh, "l int, p binary").collect():  # a row of ``buckets`` numbers each
        log_p[r["l"]] = np.frombuffer(r["p"], "<f4")
    return Model(languages, np.ascontiguousarray(log_p.T))


def _predict(model) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, scores = model.value.predict(list(b))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """(key, held_out, lang_pred, score): one row for each row of ``docs``; other columns may have any names.

    Texts and languages of rows whose crc32(key as text) mod ``folds`` is ``held`` are never learnt from, nor are
    rows without a language. A null text, and one without any letter, is ``und`` with score 0. A null key is not held
    out. If there is nothing to learn from, everything is ``und``. Ties between languages go to the name that sorts
    first. Repeated rows are counted and predicted each; very long texts are read whole, in pieces. An empty table
    gives no rows.
    """
    fold = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~fold(key)), text, lang))
    said = F.pandas_udf(_predict(model), "lang_pred string, score double")
    rows = docs.select(F.col(key).alias("k"), said(F.col(text)).alias("p"))
    return rows.select(F.col("k").alias(key), fold("k").alias("held_out"), "p.lang_pred", "p.score")
