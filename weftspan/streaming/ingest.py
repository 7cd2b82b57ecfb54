"""Contacts as a stream: edges of the contact graph, kept up to date as files arrive.

Scores need quantiles of all contacts, so calling stays a batch job; what can grow with the input is the edge table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftspan.operators import graph
from weftspan.operators.graph import prepare, within_chromosomes

SCHEMA = "chromosome_A string, start_A long, end_A long, chromosome_B string, start_B long, end_B long, petcount long"


def stream_contacts(spark: SparkSession, path: str, schema: str = SCHEMA, max_files: int = 16) -> DataFrame:
    """Headerless tab-separated contact files of a folder, as they arrive."""
    return spark.readStream.schema(schema).option("sep", "\t").option("maxFilesPerTrigger", max_files).csv(path)


def bin_pairs(contacts: DataFrame, bin_size: int = 5000) -> DataFrame:
    """Contacts summed by pair of bins: the sums merge map-side."""
    return graph.bin_pairs(within_chromosomes(prepare(contacts, bin_size)))


def merged(pairs: DataFrame) -> DataFrame:
    """Sums of several parts of the contacts, in one table, as the sums of all of them."""
    how = {"n_contacts": F.sum, "total_petcount": F.sum, "min_petcount": F.min, "max_petcount": F.max, "min_length": F.min, "max_length": F.max}
    return pairs.groupBy(*graph.PAIR).agg(*(how[c](c).alias(c) for c in pairs.columns if c not in graph.PAIR))


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a folder, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written_numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of a folder's batches or snapshots whose writing has been completed."""
    fs, place = _files(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith(f"{kind}=")]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def _remove(spark: SparkSession, path: str) -> None:
    fs, place = _files(spark, path)
    fs.delete(place, True)


def maintain(contacts: DataFrame, path: str, checkpoint: str, bin_size: int = 5000, compact: int = 8) -> StreamingQuery:
    """Write every batch's own sums by bin pair to a folder of its own, so that a batch that is repeated replaces itself.

    No state is kept beside these folders, in memory or elsewhere: a batch costs what its contacts do, however many pairs
    came before it, and sums are merged when they are read. Each ``compact`` batches they are merged with the snapshot before into a new one. What a snapshot has taken in is
    removed when the next one is complete, so that those who read the older one can end; a merge that failed half-way is
    no snapshot and is made again. 0: batches are never merged.
    """

    def save(batch: DataFrame, number: int) -> None:
        bin_pairs(batch, bin_size).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if compact and (number + 1) % compact == 0:
            compact_pairs(batch.sparkSession, path, number)

    return contacts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def compact_pairs(spark: SparkSession, path: str, number: int) -> None:
    """Write the state after batch ``number`` as a snapshot, and remove what the snapshot before that one had taken in."""
    before = [n for n in written_numbers(spark, path, "snapshot") if n < number]
    current_pairs(spark, path, number).write.mode("overwrite").parquet(f"{path}/snapshot={number}")
    if before:
        for n in written_numbers(spark, path, "batch"):
            if n <= before[-1]:
                _remove(spark, f"{path}/batch={n}")
        for n in before[:-1]:
            _remove(spark, f"{path}/snapshot={n}")


def parts_of(spark: SparkSession, path: str, number: int | None = None) -> tuple[int | None, list[int]]:
    """What the state after batch ``number`` (None: the last one) is read from: a snapshot, and the batches after it."""
    upto = lambda kind: [n for n in written_numbers(spark, path, kind) if number is None or n <= number]
    snapshot = max((n for n in upto("snapshot") if n != number), default=None)
    return snapshot, [n for n in upto("batch") if snapshot is None or n > snapshot]


def current_pairs(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The sums of every bin pair: of the last snapshot and of the batches that came after it."""
    snapshot, batches = parts_of(spark, path, number)
    found = [f"{path}/batch={n}" for n in batches] + ([] if snapshot is None else [f"{path}/snapshot={snapshot}"])
    if not found:
        raise FileNotFoundError(f"no batch has been written to {path}")
    return merged(spark.read.parquet(*found))
