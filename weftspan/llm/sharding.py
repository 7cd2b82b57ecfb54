"""Two-pass external shuffle into shards, with DataFrame functions alone.

Pass one scatters rows uniformly into buckets by a seeded hash, as many as it takes for a bucket to fit in memory.
Pass two gathers each bucket's keys and permutes them by Fisher-Yates (Spark's ``shuffle`` of an array). The buckets
one after another are a random order of all rows; position p goes to shard p mod n, slot p div n, so shard counts are
at most one apart and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.llm.common import cut, each_copy, total_bytes

#: Rows that a bucket should have; their keys take some 100 kB, their texts some 10 MB.
BUCKET_ROWS = 2048
#: Buckets of keys that a task permutes, and bytes of text in a file of a shard.
TASK_BUCKETS, FILE_BYTES = 256, 256 << 20


def running_total(df: DataFrame, order: str, value: str, out: str, group: int = 1024) -> DataFrame:
    """``df`` (a row for each value of the long ``order``) with the sum of ``value`` before each row.

    Two levels: sums of runs of ``group`` rows are added up first, so no task has all rows in its window.
    """
    within = Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("run", F.floor(F.col(order) / group))
    runs = rows.groupBy("run").agg(F.sum(value).alias("all")).select("run", F.coalesce(F.sum("all").over(across), F.lit(0)).alias("before"))
    return rows.withColumn("part", F.coalesce(F.sum(value).over(within), F.lit(0))).join(runs, "run").withColumn(out, F.col("before") + F.col("part")).drop("run", "part", "before")


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): one row for each row of ``docs``; other columns may have any names.

    size is the text's UTF-8 bytes plus 1, text_crc32 that of its bytes; a null text counts as empty. Rows that agree
    in key, size and checksum are counted first and numbered apart, so that copies of one row, however many, scatter
    like others. A null key is a key of its own. Of a text only its size and checksum travel, however long it is. An empty table gives no rows. The order depends on the rows and the
    seed, not on settings or on where the rows are read.
    """
    placed = _places(docs, shards, seed, key, text)
    return placed.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _places(docs: DataFrame, shards: int, seed: int, key: str, text: str) -> DataFrame:
    """(k, size, crc, copy, shard, slot); copy numbers the rows that agree in the three before it from 1."""
    rows = docs.select(F.col(key).alias("k"), size_of(text).alias("size"), F.crc32(_body(text)).alias("crc"))
    rows = cut(rows.groupBy("k", "size", "crc").agg(F.count("*").alias("copies")))
    n = rows.agg(F.sum("copies")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_ROWS))
    each = each_copy(rows)
    scattered = each.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "k", "size", "crc", "copy"), F.lit(buckets)))
    # One row for each bucket; a fixed number of partitions and sorted buckets make the seeded permutation repeatable.
    gathered = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("k", "size", "crc", "copy"))).alias("rows"))
    dealt = gathered.repartition(min(buckets, max(64, -(-buckets // TASK_BUCKETS))), "bucket").sortWithinPartitions("bucket")
    permuted = cut(dealt.select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows")))
    offsets = running_total(permuted.select("bucket", F.size("rows").cast("long").alias("n")), "bucket", "n", "offset").select("bucket", "offset")
    placed = permuted.join(offsets, "bucket").select("offset", F.posexplode("rows").alias("i", "r"))
    at = F.col("offset") + F.col("i")
    return placed.select("r.*", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to ``path``/shard=N in slot order, and return what was written: each row once.

    A shard is as many files as its bytes ask for, whose names ascend with their slots. Keys may be null or repeated. Rows that agree in key, size and checksum are numbered by all their columns (but
    maps) and take the places of that many copies.
    """
    places = _places(docs, shards, seed, key, text).select(*(F.col(c).alias(f"place_{c}") for c in ("k", "size", "crc", "copy")), "shard", "slot")
    rows = docs.withColumns({"own_size": size_of(text), "own_crc": F.crc32(_body(text))})
    whole = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    rows = rows.withColumn("own_copy", F.row_number().over(Window.partitionBy(key, "own_size", "own_crc").orderBy(whole)))
    same = F.col(key).eqNullSafe(F.col("place_k")) & (F.col("own_size") == F.col("place_size")) & (F.col("own_crc") == F.col("place_crc")) & (F.col("own_copy") == F.col("place_copy"))
    placed = rows.join(places, same).select(*(F.col(f"`{c}`") for c in docs.columns), "shard", "slot")
    files = max(shards, -(-total_bytes(docs, text) // FILE_BYTES))
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
