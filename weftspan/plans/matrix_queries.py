"""Registered queries of contact matrices, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.lineage import cut
from weftspan.operators import matrix
from weftspan.plans.io_queries import scratch
from weftspan.plans.oracles import _CALL, ORACLES
from weftspan.plans.queries import query, rounded
from weftspan.sources import adapters

RESOLUTION, ROUNDS, BINS = 50000, 3, 205


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells, written: several steps read them, and the contacts are summed once."""
    return cut(matrix.cells(adapters.contacts(spark, folder), RESOLUTION))


def sizes(found: DataFrame) -> DataFrame:
    """Chromosomes somewhat longer than their contacts reach, so that some bins have none."""
    return matrix.extents(found).withColumn("n_bins", F.lit(BINS).cast("long"))


@query
def matrix_cells(spark, folder):
    return matrix.cells(adapters.contacts(spark, folder), RESOLUTION)


@query
def matrix_balanced(spark, folder):
    found = cells(spark, folder)
    return rounded(matrix.normalise(found, matrix.balance(found, rounds=ROUNDS)), "value")


@query
def matrix_weights(spark, folder):
    found = cells(spark, folder)
    every = sizes(found)
    named = lambda method: matrix.all_bins(matrix.balance(found, method, rounds=ROUNDS), every).withColumn("method", F.lit(method))
    return rounded(named("VC").unionByName(named("VC_SQRT")).unionByName(named("BALANCED")), "weight")


@query
def matrix_expected(spark, folder):
    found = cells(spark, folder)
    every = sizes(found)
    both = matrix.expected(found, every).unionByName(matrix.expected(found, every, by="chromosome"))
    return rounded(both, "expected")


@query
def matrix_observed_over_expected(spark, folder):
    return rounded(matrix.observed_over_expected(cells(spark, folder)), "expected", "ratio")


@query
def matrix_balanced_over_expected(spark, folder):
    found = cells(spark, folder)
    even = matrix.normalise(found, matrix.balance(found, rounds=ROUNDS))
    return rounded(matrix.observed_over_expected(even, by="chromosome"), "value", "expected", "ratio")


def pyramid(spark: SparkSession, folder: str, contacts: DataFrame | None = None) -> str:
    path = scratch(spark)
    contacts = adapters.contacts(spark, folder) if contacts is None else contacts
    matrix.write_pyramid(contacts, path, [20000, 40000, 100000], tile_bins=64)
    return path


@query
def matrix_pyramid(spark, folder):
    """A window above the diagonal at the finest resolution, summed by coarser bins, beside the coarser level itself."""
    path = pyramid(spark, folder)
    window = ("chr3", 1000000, 3999999), ("chr3", 2000000, 5999999)
    fine, coarse = matrix.region(spark, path, *window), matrix.region(spark, path, *window, resolution=40000)
    fine = fine.groupBy(F.floor(F.col("x_bin") / 2).alias("x_bin"), F.floor(F.col("y_bin") / 2).alias("y_bin")).agg(F.sum("value").alias("of_finer"))
    return coarse.join(fine, ["x_bin", "y_bin"], "full_outer")


@query
def matrix_between_chromosomes(spark, folder):
    """All of two chromosomes: contacts whose second anchor is moved on by one chromosome for every third row."""
    rows = adapters.contacts(spark, folder)
    number = F.substring("chromosome_A", 4, 9).cast("int")
    moved = F.concat(F.lit("chr"), (number % 22 + 1).cast("string"))
    rows = rows.withColumn("chromosome_B", F.when(F.col("start_B") % 7500 == 0, moved).otherwise(F.col("chromosome_A")))
    return matrix.region(spark, pyramid(spark, folder, rows), ("chr5", 0, None), ("chr4", 0, None), 100000)


@query
def matrix_regions(spark, folder):
    """What a square window for every event holds: cells and contacts."""
    path, events = pyramid(spark, folder), adapters.table(spark, folder, "events")
    start = F.col("event_id") * 7919 % 9000000
    windows = events.select(F.col("event_id").alias("id"), F.concat(F.lit("chr"), (F.col("user_id") % 22 + 1).cast("string")).alias("chromosome"), start.alias("start"), (start + 199999).alias("end"))
    return matrix.regions(spark, path, windows, 100000).groupBy("id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


_MID = [
    *_CALL[:2],
    "mid AS (SELECT graph AS c, (sa + ea) // 2 AS x, (sb + eb) // 2 AS y, petcount AS v FROM contacts)",
]
_CELLS = [*_MID, f"m AS (SELECT c, least(x, y) // {RESOLUTION} AS i, greatest(x, y) // {RESOLUTION} AS j, CAST(sum(v) AS BIGINT) AS v FROM mid GROUP BY ALL HAVING sum(v) <> 0)"]
_BOTH = [
    *_CELLS,
    "b AS (SELECT c, i, j, CAST(v AS DOUBLE) AS v FROM m WHERE v > 0 UNION ALL SELECT c, j, i, CAST(v AS DOUBLE) FROM m WHERE v > 0 AND i <> j)",
    "r AS (SELECT c, i, sum(v) AS r FROM b GROUP BY c, i)",
    "t AS (SELECT c, sum(r) AS total FROM r GROUP BY c)",
    "w0 AS (SELECT c, i, CAST(1 AS DOUBLE) AS w FROM r)",
]


def _summed(name: str, weights: str) -> list[str]:
    """Row sums under given weights, and their mean and sum by chromosome."""
    return [
        f"{name}_s AS (SELECT b.c, b.i, any_value(x.w) AS w, sum(b.v * o.w) * any_value(x.w) AS s FROM b JOIN {weights} o ON o.c = b.c AND o.i = b.j JOIN {weights} x ON x.c = b.c AND x.i = b.i GROUP BY b.c, b.i)",
        f"{name}_f AS (SELECT c, avg(s) AS mean, sum(s) AS sum FROM {name}_s GROUP BY c)",
    ]


def _scaled(name: str, weights: str) -> list[str]:
    return [*_summed(name, weights), f"{name} AS (SELECT s.c, s.i, s.w * sqrt(t.total / f.sum) AS w FROM {name}_s s JOIN {name}_f f ON f.c = s.c JOIN t ON t.c = s.c)"]


_BALANCED = [*_BOTH]
for _k in range(ROUNDS):
    _BALANCED += [*_summed(f"k{_k}", f"w{_k}"), f"w{_k + 1} AS (SELECT s.c, s.i, s.w / sqrt(s.s / f.mean) AS w FROM k{_k}_s s JOIN k{_k}_f f ON f.c = s.c)"]
_BALANCED += _scaled("even", f"w{ROUNDS}")
_EVEN = [*_BALANCED, "n AS (SELECT m.c, m.i, m.j, m.v * x.w * y.w AS v FROM m JOIN even x ON x.c = m.c AND x.i = m.i JOIN even y ON y.c = m.c AND y.i = m.j)"]


def _with(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


_CELL = "{0}.c AS chromosome_x, {0}.c AS chromosome_y, {0}.i AS x_bin, {0}.j AS y_bin"
_EXTENT = "e AS (SELECT c, max(j) + 1 AS n FROM m GROUP BY c)"
_TURNED = "both_mid AS (SELECT c, x, y, v FROM (SELECT c, least(x, y) AS x, greatest(x, y) AS y, v FROM mid) UNION ALL SELECT c, greatest(x, y), least(x, y), v FROM mid)"

ORACLES |= {
    "matrix_cells": _with(_CELLS, f"SELECT {_CELL.format('m')}, v AS value FROM m"),
    "matrix_balanced": _with(_EVEN, f"SELECT {_CELL.format('n')}, round(v, 6) AS value FROM n"),
    "matrix_weights": _with(
        [*_BALANCED, "vc0 AS (SELECT c, i, 1 / r AS w FROM r)", *_scaled("vc", "vc0"), "vs0 AS (SELECT c, i, 1 / sqrt(r) AS w FROM r)", *_scaled("vs", "vs0"),
         f"every AS (SELECT c, unnest(range({BINS})) AS i FROM t)", "named AS (SELECT 'VC' AS method, * FROM vc UNION ALL SELECT 'VC_SQRT', * FROM vs UNION ALL SELECT 'BALANCED', * FROM even)"],
        "SELECT e.c AS chromosome, e.i AS bin, round(n.w, 6) AS weight, k.method FROM every e CROSS JOIN (VALUES ('VC'), ('VC_SQRT'), ('BALANCED')) k(method) LEFT JOIN named n ON n.c = e.c AND n.i = e.i AND n.method = k.method",
    ),
    "matrix_expected": _with(
        [*_CELLS, "d AS (SELECT c, j - i AS distance, v FROM m)"],
        f"""SELECT NULL::VARCHAR AS chromosome, distance, CAST(sum(v) AS DOUBLE) AS total, (SELECT count(DISTINCT c) FROM m) * ({BINS} - distance) AS places, round(sum(v) / ((SELECT count(DISTINCT c) FROM m) * ({BINS} - distance)), 6) AS expected FROM d GROUP BY distance
UNION ALL SELECT c, distance, CAST(sum(v) AS DOUBLE), {BINS} - distance, round(sum(v) / ({BINS} - distance), 6) FROM d GROUP BY c, distance""",
    ),
    "matrix_observed_over_expected": _with(
        [*_CELLS, _EXTENT, "d AS (SELECT j - i AS distance, CAST(sum(v) AS DOUBLE) AS total FROM m GROUP BY 1)", "x AS (SELECT distance, total / (SELECT sum(n - distance) FROM e WHERE n > distance) AS expected FROM d)"],
        f"SELECT {_CELL.format('m')}, m.v AS value, round(x.expected, 6) AS expected, round(m.v / x.expected, 6) AS ratio FROM m JOIN x ON x.distance = m.j - m.i",
    ),
    "matrix_balanced_over_expected": _with(
        [*_EVEN, _EXTENT, "x AS (SELECT n.c, n.j - n.i AS distance, sum(n.v) / (any_value(e.n) - (n.j - n.i)) AS expected FROM n JOIN e ON e.c = n.c GROUP BY n.c, n.j - n.i)"],
        f"SELECT {_CELL.format('n')}, round(n.v, 6) AS value, round(x.expected, 6) AS expected, round(n.v / x.expected, 6) AS ratio FROM n JOIN x ON x.c = n.c AND x.distance = n.j - n.i",
    ),
    "matrix_pyramid": _with(
        [*_MID, _TURNED, "w AS (SELECT x // 40000 AS x_bin, y // 40000 AS y_bin, x // 20000 AS fx, y // 20000 AS fy, x // 20000 = y // 20000 AS on_fine, x // 40000 = y // 40000 AS on_coarse, x <= y AS up, v FROM both_mid WHERE c = 'chr3')"],
        """SELECT coalesce(a.x_bin, b.x_bin) AS x_bin, coalesce(a.y_bin, b.y_bin) AS y_bin, a.value, b.of_finer
FROM (SELECT x_bin, y_bin, CAST(sum(v) AS DOUBLE) AS value FROM (SELECT *, row_number() OVER () AS k FROM w) WHERE x_bin BETWEEN 25 AND 99 AND y_bin BETWEEN 50 AND 149 AND NOT on_coarse GROUP BY ALL
  UNION ALL SELECT x // 40000, x // 40000, CAST(sum(v) AS DOUBLE) FROM mid WHERE c = 'chr3' AND x // 40000 = y // 40000 AND x // 40000 BETWEEN 50 AND 99 GROUP BY 1) a
FULL JOIN (SELECT x_bin, y_bin, CAST(sum(v) AS DOUBLE) AS of_finer FROM (SELECT x_bin, y_bin, v FROM w WHERE fx BETWEEN 50 AND 199 AND fy BETWEEN 100 AND 299 AND NOT on_fine
  UNION ALL SELECT x // 40000, x // 40000, v FROM mid WHERE c = 'chr3' AND x // 20000 = y // 20000 AND x // 20000 BETWEEN 100 AND 199) GROUP BY ALL) b ON a.x_bin = b.x_bin AND a.y_bin = b.y_bin""",
    ),
    "matrix_between_chromosomes": _with(
        [*_CALL[:2], "k AS (SELECT graph AS a, CASE WHEN sb % 7500 = 0 THEN 'chr' || (CAST(substr(graph, 4) AS INTEGER) % 22 + 1) ELSE graph END AS b, (sa + ea) // 2 AS x, (sb + eb) // 2 AS y, petcount AS v FROM contacts)"],
        "SELECT y // 100000 AS x_bin, x // 100000 AS y_bin, CAST(sum(v) AS DOUBLE) AS value FROM k WHERE a = 'chr4' AND b = 'chr5' GROUP BY ALL HAVING sum(v) <> 0",
    ),
    "matrix_regions": _with(
        [*_MID, "m AS (SELECT c, least(x, y) // 100000 AS i, greatest(x, y) // 100000 AS j, CAST(sum(v) AS DOUBLE) AS v FROM mid GROUP BY ALL)", "q AS (SELECT event_id AS id, 'chr' || (user_id % 22 + 1) AS c, event_id * 7919 % 9000000 AS s FROM events)"],
        "SELECT q.id, count(*) AS n, sum(m.v) AS value FROM q JOIN m ON m.c = q.c AND m.i BETWEEN q.s // 100000 AND (q.s + 199999) // 100000 AND m.j BETWEEN q.s // 100000 AND (q.s + 199999) // 100000 GROUP BY q.id",
    ),
}
