"""Cutting a plan's history: results that several later steps read are written once, to storage all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: First part of the name of the folder that holds an application's cuts.
OWN = "cuts"
#: Folder within it of the scope that is open.
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, set from ``spark.checkpoint.dir``; one of our own only in local mode.

    On a cluster a folder of the driver's own machine would be out of the executors' reach, so that is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame, place: str | None = None) -> DataFrame:
    """The same rows, written to the checkpoint folder as Parquet and read from there.

    Later plans begin at the written rows and read the columns they need; a lost executor costs no more than reading
    them again. The files stay until their ``scope`` ends or ``clear`` removes them, as plans that read them may run at any time.
    ``place``: what an open ``scope`` gave, to write outside of it. What was shuffled on the way is not kept: Spark would
    hold it until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{_SCOPE.get() if place is None else place}{uuid.uuid4()}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that runs inside as soon as it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _cuts(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{OWN}-{spark.sparkContext.applicationId}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Cuts made inside are removed at the end, and no others; what is read from them has to be written by then.

    Gives the place around it, for what is to stay (see ``cut``).
    """
    around = _SCOPE.get()
    name = f"{around}scope-{uuid.uuid4()}/"
    token = _SCOPE.set(name)
    try:
        yield around
    finally:
        _SCOPE.reset(token)
        _remove(spark, f"{_cuts(spark)}/{name}")


def clear(spark: SparkSession) -> None:
    """Remove all that this application has cut; to be called when its results are written."""
    _remove(spark, _cuts(spark))


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def number_rows(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``df`` with a running number from 0 in the order of columns that tell all rows apart.

    Rows are sorted by range; a row's number is its place in its partition and what the partitions before it hold, so
    only one row a partition meets in one task.
    """
    placed = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(offsets, "_part").withColumn(out, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
