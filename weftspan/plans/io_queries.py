"""Registered queries of readers, writers, the file catalog and the stream, with DuckDB SQL for the same rows.

Each writes a table as files of the kind that its reader takes, to the shared folder, and reads them back.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.lineage import shared_folder
from weftspan.operators import graph
from weftspan.plans.oracles import ORACLES, _call, _summary
from weftspan.plans.queries import call, query, table_of
from weftspan.sources import adapters, bedpe, dialects
from weftspan.sources.bedpe_files import read_files
from weftspan.sources.catalog import Catalog, name_part, read_and_concat, split_write
from weftspan.streaming import ingest


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4()}"


def written(spark: SparkSession, lines: DataFrame, before: list[str], after: list[str] = (), path: str | None = None) -> str:
    """A text of ``lines`` (one column) between some given ones, written in parts: the first and last hold what is given."""
    path = path or scratch(spark)
    given = lambda text: [spark.createDataFrame([(x,) for x in text], "value string").coalesce(1)] if text else []
    tables = [*given(before), lines, *given(after)]
    reduce(DataFrame.union, tables).write.text(path)
    return path


def headed(lines: DataFrame, before: list[str], path: str) -> None:
    """Text files of ``lines``, each of which begins with the given ones, as files of their own do."""
    opens = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the first row of a partition
    lines.select(F.when(opens, F.concat(F.lit("".join(x + "\n" for x in before)), "value")).otherwise(F.col("value")).alias("value")).write.text(path)


def lines_of(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select(F.concat_ws("\t", *columns).alias("value"))


def mixed_contacts(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Contacts of which some are between chromosomes, without a prefix, with a price and a flag."""
    rows = adapters.table(spark, folder, "lineitem")
    return rows.select(
        (1 + F.col("l_orderkey") % 22).cast("string").alias("a"), (F.col("l_partkey") * 10).alias("s"), (1 + F.col("l_suppkey") % 22).cast("string").alias("b"), (F.col("l_orderkey") * 3).alias("t"),
        F.col("l_quantity").cast("long").alias("n"), F.col("l_extendedprice").cast("string").alias("price"), "l_returnflag", *more,
    )


def contact_file(spark: SparkSession, folder: str, *, named: bool) -> str:
    """With a header that names the counts, or with comments, blank lines and prefixes and no header."""
    name = lambda c: F.concat(F.lit("" if named else "chr"), F.col(c))
    columns = [name("a"), "s", F.col("s") + 500, name("b"), "t", F.col("t") + 700]
    if named:
        header = "\t".join(["chrom1", "start1", "end1", "chrom2", "start2", "end2", "flag", "price", "count"])
        return written(spark, lines_of(mixed_contacts(spark, folder), *columns, "l_returnflag", "price", "n"), [header])
    comments = [f"# comment {i}" for i in range(1200)]
    return written(spark, lines_of(mixed_contacts(spark, folder), *columns, F.concat(F.col("n").cast("string"), F.lit("# and more"))), comments, ["", "  ", "# end"])


MIXED = "m AS (SELECT CAST(1 + l_orderkey % 22 AS VARCHAR) AS a, l_partkey * 10 AS s, CAST(1 + l_suppkey % 22 AS VARCHAR) AS b, l_orderkey * 3 AS t, CAST(l_quantity AS BIGINT) AS n, l_extendedprice AS price, l_returnflag FROM lineitem)"
CORE = "'chr' || a AS chromosome_A, s AS start_A, s + 500 AS end_A, 'chr' || b AS chromosome_B, t AS start_B, t + 700 AS end_B"


@query
def bedpe_reader(spark, folder):
    return bedpe.read_contacts(spark, contact_file(spark, folder, named=True), (7, "price", "double"), (6, "flag", "string"))


@query
def bedpe_reader_comments(spark, folder):
    return bedpe.read_contacts(spark, contact_file(spark, folder, named=False), petcount_col=6)


@query
def bedpe_reader_skiprows(spark, folder):
    path = contact_file(spark, folder, named=True)
    return bedpe.read_contacts(spark, path, (7, "price", "double"), skiprows=1, petcount_col=8, min_petcount=10, prefixed=False)


@query
def bedpe_reader_between(spark, folder):
    return bedpe.read_contacts(spark, contact_file(spark, folder, named=True), intrachromosomal=False, min_petcount=20, chromosomes="chr3")


@query
def bedpe_reader_limit(spark, folder):
    lines = mixed_contacts(spark, folder, "l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber")
    path = written(spark, lines_of(lines, "a", "s", F.col("s") + 500, "b", "t", F.col("t") + 700, "n"), ["\t".join([*"abcdef", "count"])])
    return bedpe.read_contacts(spark, path, nrows=1000)


@query
def bedpe_files(spark, folder):
    """Three kinds of files in one read: names with a count, comments without, lines to skip before an unnamed count."""
    path, rows = scratch(spark), mixed_contacts(spark, folder, "l_linenumber").withColumn("part", F.col("l_linenumber") % 3)
    core = lambda name: [name("a"), "s", F.col("s") + 500, name("b"), "t", F.col("t") + 700]
    plain, prefixed = F.col, lambda c: F.concat(F.lit("chr"), F.col(c))
    headed(lines_of(rows.filter("part = 0"), *core(plain), "l_returnflag", "n"), ["\t".join([*"abcdef", "flag", "count"])], f"{path}/named")
    written(spark, lines_of(rows.filter("part = 1"), *core(prefixed), F.concat("l_returnflag", F.lit("# said"))), ["# one", "# two"], ["", "# end"], path=f"{path}/commented")
    headed(lines_of(rows.filter("part = 2"), *core(prefixed), "l_returnflag", "price", "n"), ["not a contact", "a\tb\tc\td"], f"{path}/skipped")
    found = read_files(spark, [path], (6, "flag", "string"), own={"skipped": {"skiprows": 2, "petcount_col": 8}}, chunk=1 << 16)
    return found.withColumn("file", F.regexp_extract("file", "([a-z]+)/[^/]*$", 1)).drop("place")


@query
def viewer_read_stripes(spark, folder):
    path = scratch(spark)
    dialects.save_viewer_stripes(call(spark, folder).raw.orderBy("stripe_id"), path, pad_w=3)
    return dialects.read_viewer_stripes(spark, path)


@query
def viewer_read_positions(spark, folder):
    path = scratch(spark)
    dialects.save_viewer_stripes(call(spark, folder).raw.orderBy("stripe_id"), path)
    return dialects.read_viewer_positions(spark, path)


@query
def third_party_read(spark, folder):
    path = scratch(spark)
    rows = call(spark, folder).raw.orderBy("stripe_id")
    dialects.write_tsv(rows.select(F.expr("substr(chromosome, 4)").alias("chr"), F.col("anchor_start").alias("pos1"), F.col("anchor_end").alias("pos2"), F.expr("substr(chromosome, 4)").alias("chr2"), F.col("start").alias("pos3"), F.col("end").alias("pos4"), "length", "width"), path)
    return dialects.read_third_party(spark, path)


@query
def stripes_saved(spark, folder):
    path = scratch(spark)
    dialects.save_stripes(call(spark, folder).final, path)
    kinds = "chromosome string, direction string, stripe_id long, anchor_start long, anchor_end long, width long, start long, end long, length long, n_fans long, n_loop_clusters long, n_leafs long, n_edges long, stripe_score double, mean_cross_score double"
    return table_of(spark.read.csv(path, sep="\t", header=True, schema=kinds))


def order_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> Catalog:
    """Orders in one table for each status and priority, in two overlapping sources and one of another name."""
    root, pattern, _ = split_write(adapters.table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_totalprice"), f"{scratch(spark)}/orders_", ["o_orderstatus", "o_orderpriority"], suffix=suffix, header=True)
    return Catalog(spark, root, ["o_orderstatus", "o_orderpriority"]).add("orders", pattern, encoded=True)


@query
def catalog_paths(spark, folder):
    """Each table's folder, and how many files it has; part files have names of their own in each run."""
    rows = order_files(spark, folder).paths("orders", check_unique=False)
    where = F.regexp_extract("path", r"([^/]+)/part-[^/]*$", 1)
    return rows.groupBy("o_orderstatus", "o_orderpriority", where.alias("path")).agg((F.count("*") > 0).alias("has_files"))


@query
def catalog_table(spark, folder):
    found = order_files(spark, folder)
    pattern = found.sources[0].pattern.removeprefix("^(?:.*/)?").removesuffix("$")
    found.add("urgent", pattern, encoded=True, filters=(lambda d: d["o_orderpriority"].startswith("1"),), action=lambda p: F.upper(p))
    where = lambda c: F.when(F.col(c) != "none", F.regexp_extract(c, r"([^/]+)/(?i:part)-[^/]*$", 1)).alias(c)
    return found.table("none").select("o_orderstatus", "o_orderpriority", where("orders"), where("urgent")).distinct()


@query
def catalog_keys_of(spark, folder):
    """Keys of the path that a file for each order would have; every seventh belongs to no source."""
    orders = adapters.table(spark, folder, "orders")
    name = F.concat(F.lit("orders_"), name_part(F.col("o_orderstatus"), "_"), F.lit("_"), name_part(F.col("o_orderpriority"), "_"), F.lit(".csv"))
    path = F.concat(F.lit("/of/"), F.col("o_custkey").cast("string"), F.lit("/"), F.when(F.col("o_orderkey") % 7 == 0, "orders.csv").otherwise(name), F.lit("/part-"), F.col("o_orderkey").cast("string"))
    return order_files(spark, folder).keys_of_all("orders", orders.select(path.alias("path")))


@query
def catalog_limited(spark, folder):
    """The first file of each of two sources of one name, by path, and the tables whose files more than one source has."""
    found = order_files(spark, folder)
    pattern = found.sources[0].pattern.removeprefix("^(?:.*/)?").removesuffix("$")
    found.add("orders", pattern, encoded=True, filters=(lambda d: d["o_orderpriority"] >= "4",))
    first = found.paths("orders", limit_per_source=10**6, check_unique=False)
    folders = lambda d: d.select("o_orderstatus", "o_orderpriority", F.regexp_extract("path", r"([^/]+)/part-[^/]*$", 1).alias("path")).distinct()
    several = first.groupBy("path").agg(F.count("*").alias("n"), F.first("o_orderstatus").alias("o_orderstatus"), F.first("o_orderpriority").alias("o_orderpriority")).filter("n > 1")
    few = found.paths("orders", limit_per_source=1, check_unique=False)
    return folders(several).withColumn("kind", F.lit("several")).unionByName(folders(few).withColumn("kind", F.lit("first")))


@query
def catalog_read(spark, folder):
    found = order_files(spark, folder, "")
    read = lambda s, paths: s.read.csv(paths, header=True, schema="o_orderkey long, o_totalprice double")
    rows = read_and_concat(spark, found.paths("orders", check_unique=False), found.keys, read, row_number="row")
    total = rows.agg(F.count_distinct("row").alias("rows"), F.max("row").alias("last"))
    return rows.drop("row").crossJoin(F.broadcast(total))  # one row of totals beside each


@query
def streamed_edges(spark, folder):
    """Four files or more, as many as the table is read in parts, in two batches."""
    path, rows = scratch(spark), adapters.contacts(spark, folder)
    files = max(4, rows.rdd.getNumPartitions())
    rows.repartition(files).write.csv(f"{path}/in", sep="\t")
    ingest.maintain(ingest.stream_contacts(spark, f"{path}/in", max_files=-(-files // 2)), f"{path}/pairs", f"{path}/state").awaitTermination()
    return ingest.current_pairs(spark, f"{path}/pairs").select(*graph.PAIR, "n_contacts", "total_petcount", "min_petcount", "max_petcount", "min_length", "max_length")


@query
def streamed_snapshot(spark, folder):
    """Ten batches of one file each, merged after every fourth: read from one snapshot and the last two batches."""
    path = scratch(spark)
    adapters.contacts(spark, folder).repartition(10).write.csv(f"{path}/in", sep="\t")
    ingest.maintain(ingest.stream_contacts(spark, f"{path}/in", max_files=1), f"{path}/pairs", f"{path}/state", compact=4).awaitTermination()
    return ingest.current_pairs(spark, f"{path}/pairs").select(*graph.PAIR, "n_contacts", "total_petcount", "min_petcount", "max_petcount", "min_length", "max_length")


_RAW = _summary("cs", "raw_stripes")
_RIGHT = "CASE WHEN direction = 'R' THEN 1 ELSE 0 END"
NAME = "'orders_' || o_orderstatus || '_' || replace(o_orderpriority, ' ', '+') || '.csv'"
IO_ORACLES = {
    "bedpe_reader": f"WITH {MIXED} SELECT {CORE}, n AS petcount, price, l_returnflag AS flag FROM m",
    "bedpe_reader_comments": f"WITH {MIXED} SELECT {CORE}, n AS petcount FROM m",
    "bedpe_reader_skiprows": f"WITH {MIXED} SELECT {CORE}, n AS petcount, price FROM m WHERE n >= 10",
    "bedpe_reader_between": f"WITH {MIXED} SELECT {CORE}, n AS petcount FROM m WHERE a <> b AND n >= 20 AND (a = '3' OR b = '3')",
    "bedpe_reader_limit": f"WITH {MIXED.replace('l_returnflag FROM', 'l_returnflag, l_orderkey, l_linenumber FROM')} SELECT {CORE}, n AS petcount FROM m ORDER BY l_orderkey, l_linenumber LIMIT 1000",
    "bedpe_files": f"WITH {MIXED.replace('l_returnflag FROM', 'l_returnflag, l_linenumber % 3 AS part FROM')} SELECT {CORE}, CASE WHEN part <> 1 THEN n END AS petcount, l_returnflag AS flag, CASE part WHEN 0 THEN 'named' WHEN 1 THEN 'commented' ELSE 'skipped' END AS file FROM m",
    "viewer_read_stripes": _call(
        f"""SELECT stripe_id, graph AS chromosome, CASE WHEN abs(p3 - p1) < abs(p4 - p2) THEN 'R' ELSE 'L' END AS direction, p1 AS anchor_start, p2 AS anchor_end, p2 - p1 AS width, p3 AS start, p4 AS "end", p4 - p3 AS length
FROM (SELECT stripe_id, graph, anchor_start - 3 - {_RIGHT} AS p1, anchor_end + 3 AS p2, start - CASE WHEN direction = 'R' THEN 0 ELSE 3 END AS p3, "end" + CASE WHEN direction = 'R' THEN 3 ELSE 0 END AS p4 FROM raw_stripes)""", _RAW),
    "viewer_read_positions": _call(f"""SELECT row_number() OVER (ORDER BY CAST(substr(chr, 4) AS INTEGER), pos1, pos2, pos3, pos4, saved) - 1 AS stripe_id, * EXCLUDE (saved)
FROM (SELECT graph AS chr, graph AS chr2, anchor_start - {_RIGHT} AS pos1, anchor_end AS pos2, start AS pos3, "end" AS pos4, direction, stripe_id AS saved FROM raw_stripes)""", _RAW),
    "third_party_read": _call("""SELECT row_number() OVER (ORDER BY CAST(substr(chr, 4) AS INTEGER), pos1, pos2, pos3, pos4, saved) - 1 AS stripe_id, * EXCLUDE (saved)
FROM (SELECT graph AS chr, anchor_start AS pos1, anchor_end AS pos2, graph AS chr2, start AS pos3, "end" AS pos4, length, width, CASE WHEN anchor_start + anchor_end > start + "end" THEN 'L' ELSE 'R' END AS direction, stripe_id AS saved FROM raw_stripes)""", _RAW),
    "stripes_saved": ORACLES["stripes_final"],
    "catalog_paths": f"SELECT DISTINCT o_orderstatus, o_orderpriority, {NAME} AS path, true AS has_files FROM orders",
    "catalog_table": f"SELECT DISTINCT o_orderstatus, o_orderpriority, {NAME} AS orders, CASE WHEN o_orderpriority LIKE '1%' THEN upper({NAME}) END AS urgent FROM orders",
    "catalog_keys_of": f"""SELECT DISTINCT '/of/' || o_custkey || '/' || CASE WHEN o_orderkey % 7 = 0 THEN 'orders.csv' ELSE {NAME} END || '/part-' || o_orderkey AS path,
CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders""",
    "catalog_limited": f"""WITH k AS (SELECT DISTINCT o_orderstatus, o_orderpriority, {NAME} AS path FROM orders)
SELECT *, 'several' AS kind FROM k WHERE o_orderpriority >= '4' UNION ALL (SELECT *, 'first' FROM k ORDER BY path LIMIT 1)
UNION ALL (SELECT *, 'first' FROM k WHERE o_orderpriority >= '4' ORDER BY path LIMIT 1)""",
    "catalog_read": "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, count(*) OVER () AS rows, count(*) OVER () - 1 AS last FROM orders",
    "streamed_edges": _call("SELECT graph AS chromosome_A, sa AS start_A, ea AS end_A, graph AS chromosome_B, sb AS start_B, eb AS end_B, count(*) AS n_contacts, sum(petcount) AS total_petcount, min(petcount) AS min_petcount, max(petcount) AS max_petcount, min(abs(sa - sb + ea - eb) // 2) AS min_length, max(abs(sa - sb + ea - eb) // 2) AS max_length FROM prep GROUP BY ALL"),
}
ORACLES.update(IO_ORACLES)
ORACLES["streamed_snapshot"] = ORACLES["streamed_edges"]
