"""Exact k-means on integer vectors, with Hamerly's bounds.

Each vector keeps the number of its centroid, an upper bound of its distance to it, and one lower bound of its distance
to the second nearest. When centroids have moved, the upper bound grows by how far the own one moved, the lower one
shrinks by the farthest move of any other. As long as the upper stays below the lower bound the assignment holds and no
distance is computed; else the own distance is, and only if that is not below the lower bound either, all are.

Distances are compared as exact integers, ties go to the smaller number; bounds are floating-point numbers rounded away
from each other, so that they never decide a tie. The state of all vectors is a table that is written in each round and
read in the next; only centroids, their sums and counts (k rows) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.common import cut

#: Components go no farther than this from 0, so that a squared distance of 64 components fits in 64 bits.
FARTHEST = 1 << 25
#: Bounds are moved apart by this part of themselves, which is far more than rounding can add.
SLACK = 1e-9
#: Vectors of a batch that are scanned at a time.
SCANNED = 1 << 12
STATE = "k {kind}, v array<int>, cluster int, upper double, lower double, distance long, scans int"


def integer_vectors(rows: DataFrame, size: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(k, v): vectors of exactly ``size`` finite numbers x as integers floor(scale * x), limited to +-FARTHEST."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("e", lambda x: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.floor(x * float(scale)))).cast("int"))
    # A number over 2**53 would not fit in what floor returns; none that large is left after the first limit.
    low, high = F.lit(-float(FARTHEST)), F.lit(float(FARTHEST))
    near = F.transform("e", lambda x: F.greatest(low, F.least(high, x)))
    kept = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("e")).filter((F.size("e") == size) & finite)
    return kept.select("k", near.alias("e")).select("k", whole.alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance, squared distance of the second) for each vector, in exact integers."""
    number, first, second = (np.zeros(len(v), np.int64) for _ in range(3))
    for at in range(0, len(v), SCANNED):
        s = slice(at, at + SCANNED)
        d = np.stack([((v[s] - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        number[s] = d.argmin(axis=1)  # the first of equal ones
        first[s] = d[np.arange(len(d)), number[s]]
        d[np.arange(len(d)), number[s]] = np.iinfo(np.int64).max
        second[s] = d.min(axis=1)
    return number, first, second


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def loosened(number: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both bounds after each centroid has moved by at most its ``drift``."""
    if len(drift) == 1:
        return (upper + drift[0]) * (1 + SLACK), lower
    order = np.argsort(drift)
    most = np.full(len(drift), drift[order[-1]])
    most[order[-1]] = drift[order[-2]]  # the farthest move of any other
    return (upper + drift[number]) * (1 + SLACK), np.maximum(0.0, (lower - most[number]) * (1 - SLACK))


def reassign(v: np.ndarray, number: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number, upper, lower, scanned) after centroids have moved; ``scanned``: whose distances were all computed."""
    upper, lower = loosened(number, upper, lower, drift)
    number, open_ = number.copy(), np.flatnonzero(upper >= lower)
    if len(open_):
        upper[open_] = above(((v[open_] - centroids[number[open_]]) ** 2).sum(axis=1))
        open_ = open_[upper[open_] >= lower[open_]]
    scanned = np.zeros(len(v), bool)
    if len(open_):
        number[open_], first, second = nearest(v[open_], centroids)
        upper[open_], lower[open_], scanned[open_] = above(first), below(second), True
    return number, upper, lower, scanned


def _table(b: pa.RecordBatch, v: pa.Array, number, upper, lower, distance, scans) -> pa.RecordBatch:
    made = [pa.array(number.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), pa.array(scans.astype(np.int32))]
    return pa.RecordBatch.from_arrays([b.column("k"), v, *made], names=["k", "v", "cluster", "upper", "lower", "distance", "scans"])


def _matrix(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The column of vectors and the same as a matrix of 64-bit integers."""
    v = b.column("v")
    return v, v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)


def _step(centroids: np.ndarray, drift: np.ndarray | None):
    """For mapInArrow over the state (or, without ``drift``, over vectors that have none yet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, x = _matrix(b)
            if drift is None:
                number, first, second = nearest(x, centroids)
                upper, lower, scans = above(first), below(second), np.ones(len(x), np.int64)
                if len(centroids) == 1:
                    lower = np.full(len(x), np.inf)
            else:
                number, upper, lower = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                number, upper, lower, scanned = reassign(x, number.astype(np.int64), upper, lower, drift, centroids)
                scans = b.column("scans").to_numpy(zero_copy_only=False).astype(np.int64) + scanned
            distance = ((x - centroids[number]) ** 2).sum(axis=1)
            yield _table(b, v, number, upper, lower, distance, scans)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the state: for each task (cluster, n, total), the sums of its vectors; at most k rows."""
    total: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for b in batches:
        if b.num_rows:
            _, x = _matrix(b)
            number = b.column("cluster").to_numpy(zero_copy_only=False)
            for c in np.unique(number).tolist():
                mine = x[number == c]
                total[c], count[c] = total.get(c, 0) + mine.sum(axis=0), count.get(c, 0) + len(mine)
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array([count[c] for c in keys], pa.int64()), pa.array([total[c].tolist() for c in keys], pa.list_(pa.int64()))], names=["cluster", "n", "total"]
    )


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; one without vectors stays."""
    parts = state.select("v", "cluster").mapInArrow(_sums, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in each.collect():  # k rows for each component
        out[r["cluster"], r["i"]] = r["x"] // r["n"]
    return out


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, size: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans): one row for each vector that is kept.

    Kept are vectors of exactly ``size`` components, none null, NaN or infinite; each becomes floor(scale * x), limited
    to +-2**25. The first centroids are the k kept vectors whose sha256(seed:key) is smallest, in that order; a null key
    counts as the empty string, and rows that share a key are ordered by their vectors. With fewer vectors than k there
    are as many centroids as vectors. ``rounds`` times all vectors are assigned and centroids moved to the floor of the
    mean, then vectors are assigned once more; distance is the squared one to the final centroid, and inertia its sum
    over the cluster and over all (at most the largest long). ``scans`` counts the assignments in which the bounds did
    not suffice. Repeated rows count each; an empty table, or one without a kept vector, gives no rows. Other columns
    may have any names.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"
    vectors = cut(integer_vectors(rows, size, scale, key, vector))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.select(digest.alias("d"), "v").orderBy("d", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], out)
    centroids = np.array([list(r["v"]) for r in first], np.int64)
    schema = STATE.format(kind=kind)
    state, drift = vectors, None
    for _ in range(rounds):
        state = cut(state.mapInArrow(_step(centroids, drift), schema))
        after = moved(state, centroids)
        drift, centroids = above(((after - centroids) ** 2).sum(axis=1)), after
    state = cut(state.mapInArrow(_step(centroids, drift), schema))
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, min(s, (1 << 63) - 1), min(sum(sums.values()), (1 << 63) - 1), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
