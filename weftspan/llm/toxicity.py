"""Toxicity by a counterfactual-regularised classifier.

A logistic model on the words of a text and their beginnings (hashed, present or not). In labelled texts that mention a
group, identity terms are swapped for others of their kind, and the squared change of the score is penalised, so that
a neutral mention of one group weighs as little as that of another.

The model is fitted on a bounded sample of labelled rows: at most ``sample`` of each label, and of these, in the order
of a hash of their keys, as many as have ``entries`` feature numbers together. It has one weight for each of ``SPACE``
hashed features, none of which is left out, and is sent along with the code. Scoring reads every text whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.llm.common import cut, distinct

#: Identity terms by kind. A term is swapped for the next of its line, the last for the first.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrants", "citizens", "refugees"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
)
NEXT = {w: g[(i + 1) % len(g)] for g in IDENTITY_TERMS for i, w in enumerate(g)}

#: Hash space of the features.
SPACE = 1 << 18
#: Lengths of word beginnings that are features besides the word.
BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text, in lower case."""
    return set(_WORD.findall(text.lower())) if isinstance(text, str) else set()


@lru_cache(1 << 16)
def _numbers(word: str) -> tuple[int, ...]:
    names = ["w" + word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % SPACE for x in names)


def hashed(words: set[str]) -> np.ndarray:
    """Sorted distinct feature numbers of words and their beginnings."""
    found = set().union(*map(_numbers, words))
    return np.sort(np.fromiter(found, np.uint32, len(found)))


def swapped(words: set[str]) -> set[str] | None:
    """The words with identity terms swapped, or None if there are none."""
    if NEXT.keys().isdisjoint(words):
        return None
    return {NEXT.get(w, w) for w in words}


@dataclass(frozen=True)
class Model:
    """A weight for each feature number, and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        """Between 0 and 1; a text without known features, such as the empty one, has the intercept's score."""
        z = self.intercept + float(self.weights[hashed(words_of(text))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class _Sparse:
    """Rows of distinct column numbers; sums over the entries of each row or column, in single precision."""

    def __init__(self, lists: list[np.ndarray], numbers: np.ndarray):
        self.shape = len(lists), len(numbers)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        self.col = np.searchsorted(numbers, np.concatenate([np.zeros(0, np.uint32), *lists])).astype(np.int32)
        order = np.argsort(self.col, kind="stable")
        self.row = np.repeat(np.arange(len(lists), dtype=np.int32), size)[order]
        self.rows, self.row_at = self._starts(size)
        self.cols, self.col_at = self._starts(np.bincount(self.col, minlength=len(numbers)))

    @staticmethod
    def _starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(size)
        return some, (np.cumsum(size) - size)[some]

    def times(self, w: np.ndarray) -> np.ndarray:
        """The sum of ``w`` over the columns of each row."""
        out = np.zeros(self.shape[0], np.float32)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(w.astype(np.float32)[self.col], self.row_at)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        """The sum of ``r`` over the rows of each column."""
        out = np.zeros(self.shape[1], np.float32)
        if len(self.cols):
            out[self.cols] = np.add.reduceat(r.astype(np.float32)[self.row], self.col_at)
        return out


def fit(lists: list[np.ndarray], toxic: np.ndarray, counter: list[np.ndarray | None], share: float, fairness: float = 1.0, ridge: float = 1e-3, prior: float = 0.25, steps: int = 100) -> Model:
    """A model from feature lists, labels and counterfactual lists (None: no identity term).

    ``share`` is the part of toxic rows in the table; its log odds times ``prior`` move the intercept of the balanced
    fit (by less than all of them, as shrunken weights understate what speaks for a label). Every feature of the rows
    and of their counterfactuals has a weight.
    """
    weights = np.zeros(SPACE, np.float32)
    pos, neg = int(toxic.sum()), int((1 - toxic).sum())
    if not pos or not neg:
        return Model(weights, float(np.log((pos + 0.5) / (neg + 1.5))))  # without any labels, a text is rather not toxic
    swaps = [i for i, c in enumerate(counter) if c is not None]
    kept = distinct(np.concatenate([np.zeros(0, np.uint32), *lists, *(counter[i] for i in swaps)]))
    x = _Sparse(lists, kept)
    # Between a text and its counterfactual only features of identity terms differ.
    gone = _Sparse([np.setdiff1d(lists[i], counter[i], True) for i in swaps], kept)
    come = _Sparse([np.setdiff1d(counter[i], lists[i], True) for i in swaps], kept)
    # Log odds of a feature, as a scale, let few strong words outweigh many weak ones.
    weight = np.where(toxic > 0, 0.5 / pos, 0.5 / neg)
    p, q = x.back(toxic) + 0.5, x.back(1 - toxic) + 0.5
    scale = np.abs(np.log((p / (pos + 1)) / (q / (neg + 1)))) + 0.05
    w, intercept = np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, steps + 1):
        z = x.times(w * scale) + intercept
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        g = x.back(error) * scale + ridge * w
        if swaps:
            change = gone.times(w * scale) - come.times(w * scale)
            g += fairness * (gone.back(change) - come.back(change)) * scale / len(swaps)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, intercept = w - move[:-1], intercept - move[-1]
    share = min(max(share, 1e-4), 1 - 1e-4)
    weights[kept] = w * scale
    return Model(weights, float(intercept + prior * np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 6000, entries: int = 1 << 22, **options) -> Model:
    """Fit on at most ``sample`` rows of either label with ``entries`` features; give only labels that may be learnt from.

    Rows without key or label are left out; of a key's labels the largest holds, and of its texts the one whose hash
    is least, so that however many rows repeat a key, one of them is fitted. Texts with more than a 64th of ``entries``
    features are not fitted, so that a few very long ones do not take the place of all others. Both tables may be empty: the model then
    scores everything alike.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    sides = [known.filter(F.col("y") > 0 if y else F.col("y") <= 0).orderBy(F.xxhash64("k"), "k").limit(sample).select("k", F.lit(y).alias("y")) for y in (0, 1)]
    chosen = F.broadcast(sides[0].unionByName(sides[1]))  # at most 2 * sample rows of two numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [words_of(t) for t in b["t"]]
            lists, other = [hashed(w) for w in words], [swapped(w) for w in words]
            yield pd.DataFrame({"y": b["y"], "o": b["o"], "n": [len(x) for x in lists], "x": [x.tobytes() for x in lists], "c": [None if w is None else hashed(w).tobytes() for w in other]})

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(chosen, "k")
    one = rows.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m")).select("y", F.xxhash64("k").alias("o"), "m.t")
    found = cut(one.mapInPandas(run, "y int, o long, n long, x binary, c binary").filter(F.col("n") <= entries // 64))
    so_far = F.sum("n").over(Window.orderBy("o", "n", "y").rowsBetween(Window.unboundedPreceding, 0))  # 2 * sample numbers
    within = found.select("o", "n", "y").withColumn("upto", so_far).filter(F.col("upto") <= entries).agg(F.max("o").alias("last"))
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    read = lambda b: None if b is None else np.frombuffer(b, np.uint32)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"y": [], "x": [], "c": []}), *batches])
        model = fit([read(x) for x in rows["x"]], rows["y"].to_numpy(np.float64), [read(c) for c in rows["c"]], share, **options)
        yield pd.DataFrame({"w": [model.weights.tobytes()], "b": [model.intercept]})

    # The sample is bounded, so one task fits it; the driver sees nothing but the weights.
    sample = found.join(F.broadcast(within), F.col("o") <= F.col("last")).repartition(1).sortWithinPartitions("o", "x").select("y", "x", "c")
    for r in sample.mapInPandas(fitted, "w binary, b double").collect():
        return Model(np.frombuffer(r["w"], np.float32), r["b"])
    return fit([], np.zeros(0), [], share, **options)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score for each row; null and empty texts have the intercept's score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for b in batches:
            yield pd.Series([model.score(t) for t in b], dtype=np.float64)

    return docs.withColumn(out, run(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, **options) -> DataFrame:
    """(key, held_out, score, predicted): one row for each row of ``docs``; other columns may have any names.

    Labels of rows whose crc32(key as text) mod ``folds`` is ``held`` are never learnt from. Nothing but the text is an
    input of the score. Null and empty texts get the score of a text without known words; a null key is not held out.
    Equal texts have equal scores, and repeated rows are scored each; a score of exactly one half is predicted 1. Very
    long texts are read whole. Without documents there are no rows; without labels all scores are alike.
    """
    fold = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    model = train(docs, labels.filter(~fold(key)), key, text, label, **options)
    rows = score(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), model, "t").drop("t")
    return rows.select(F.col("k").alias(key), fold("k").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
