"""Islands of overlapping intervals, and set operations on interval sets, within groups of key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.functions.intervals import floor_div
from weftspan.functions.lineage import cut

#: Bounds between ranges are quantiles of the starts, 2**LEVELS of them.
LEVELS = 10
#: Rows that a range should have at most; with more, what lies between two bounds is split on evenly.
RANGE_ROWS = 1 << 15


def with_range(df: DataFrame, out: str, start: str = "start") -> DataFrame:
    """``df`` with the number of the range of starts that a row belongs to: ranges have about as many rows each.

    Their bounds are quantiles of all starts (a sketch that merges map-side, and a scalar subquery), so neither a few starts
    far from the others nor a place where most of them are makes a range large. Rows with one start stay together.
    """
    n = 1 << LEVELS
    facts = df.agg(F.struct(F.count(start).alias("n"), F.percentile_approx(start, [i / n for i in range(n + 1)], 8 * n).alias("bounds"))).scalar()
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(LEVELS))))
    at = F.aggregate(steps, F.lit(0), lambda i, step: i + F.when(F.get("_facts.bounds", i + step) <= F.col(start), step).otherwise(0))
    low, high = F.get("_facts.bounds", F.col("_at")).cast("double"), F.get("_facts.bounds", F.col("_at") + 1).cast("double")
    parts = F.ceil(F.col("_facts.n") / (n * RANGE_ROWS))
    within = F.greatest(F.lit(0), F.least(parts - 1, F.floor((F.col(start) - low) / (high - low + 1) * parts)))
    return df.withColumn("_facts", facts).withColumn("_at", at).withColumn(out, (F.col("_at") * parts + within).cast("long")).drop("_facts", "_at")


def _ranged(df: DataFrame, keys: Sequence[str], start: str, tile: int | None) -> DataFrame:
    """``df`` with ``_by``, its keys and range (or tile of a given width) in one: the column it is dealt, grouped and
    joined by, so that its rows move once. Nulls in it are equal to each other."""
    placed = with_range(df, "_tile", start) if tile is None else df.withColumn("_tile", floor_div(F.col(start), tile))
    return placed.withColumn("_by", F.struct(*keys, "_tile")).drop("_tile")


def _local(rows: DataFrame, start: str, end: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_own``, the number (from 1) of their island as far as their own range tells."""
    w = Window.partitionBy("_by").orderBy(start, end, *order)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = rows.withColumn("_seen", seen).withColumn("_opens", F.when(F.col("_seen").isNull() | (F.col(start) >= F.col("_seen")), 1).otherwise(0))
    return opens.withColumn("_own", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_seen", "_opens")


def _joined(local: DataFrame, keys: Sequence[str], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(islands of each range, facts of each range): ``_by``, ``_own``, first start and last end of the former; of the
    latter how many islands began before it (``_base``), and how many of its own go on from there (``_on``)."""
    found = local.groupBy("_by", "_own").agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    across = Window.partitionBy(*(F.col(f"_by.{k}") for k in keys)).orderBy("_by._tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.groupBy("_by").agg(F.max("_e").alias("_high")).select("_by", F.max("_high").over(across).alias("_before"))
    goes_on = F.coalesce(F.col("_s") < F.col("_before"), F.lit(False)).cast("long")
    counts = found.join(carried, "_by").groupBy("_by").agg(F.sum(goes_on).alias("_on"), F.sum(1 - goes_on).alias("_new"))
    return found, counts.select("_by", "_on", F.coalesce(F.sum("_new").over(across), F.lit(0)).alias("_base"))


def _number() -> Column:
    """The number of an island, from its place in its range; the first ones may go on from an earlier range's last."""
    return F.col("_base") - 1 + F.greatest(F.lit(0).cast("long"), F.col("_own") - F.col("_on"))


def islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", out: str = "island", tile: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with the number (from 0, within its keys) of the island that each interval belongs to.

    An interval opens a new island if it starts at or after the end of all intervals before it in the order of
    (start, end): touching intervals do not overlap. Each empty interval at an edge is an island of its own; columns
    named in ``order`` say which comes first of several equal ones.

    Rows are dealt by (keys, range of starts), and ranges pass on their largest end and number of islands, so that one
    group may hold any part of all rows, and starts may lie anywhere, without a task getting much more than others.
    With a ``tile`` ranges have that width; with 0 each group is one, which suits groups of a bounded size.
    """
    keys = list(keys)
    if tile == 0:
        w = Window.partitionBy(*keys).orderBy(start, end, *order)
        seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(seen.isNull() | (F.col(start) >= seen), 1).otherwise(0)
        return df.withColumn("_opens", opens).withColumn(out, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_opens")
    local = _local(_ranged(df, keys, start, tile), start, end, order)
    _, facts = _joined(local, keys, start, end)
    return local.join(facts, "_by").select(*df.columns, _number().alias(out))


def _attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each value of the keys; null keys match."""
    other = facts.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return rows.join(other, cond).drop(*(f"_r{i}" for i in range(len(keys))))


def global_islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", out: str = "island", ascending: bool = True, order: Sequence[str] = (), tile: int | None = None) -> DataFrame:
    """Islands numbered on through the groups in the order of their keys.

    With ``ascending`` off, the islands of each group are numbered from the far end: its last island is the first.
    """
    numbered = islands(df, keys, start, end, "_own", tile, order)
    sizes = numbered.groupBy(*keys).agg((F.max("_own") + 1).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.col("_own") if ascending else F.col("_n") - 1 - F.col("_own")
    return _attach(numbered, before, list(keys)).select(*df.columns, (own + F.col("_before")).alias(out))


def union_self(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the hull of each island. After the first shuffle only islands of ranges move on."""
    keys = list(keys)
    found, facts = _joined(_local(_ranged(df.select(*keys, start, end), keys, start, None), start, end, ()), keys, start, end)
    named = found.join(facts, "_by").select("_by.*", _number().alias("_island"), "_s", "_e")
    return named.groupBy(*keys, "_island").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_island")


def intersect_self(df: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): what all intervals of a group have in common; may be empty at a point, else left out."""
    rows = df.groupBy(*keys).agg(F.max(start).alias(start), F.min(end).alias(end))
    return rows.filter(F.col(start) <= F.col(end))


def is_disjoint(df: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """(keys, disjoint): whether every interval of a group is an island of its own."""
    found = islands(df.select(*keys, start, end), keys, start, end, "_island")
    return found.groupBy(*keys).agg((F.max("_island") + 1 == F.count("*")).alias("disjoint"))


def hull(df: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """(keys, n, start, end): number of intervals, least start and largest end; (0, 0, 0) for an empty table without keys."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(start).alias(start), F.max(end).alias(end))
    return rows if keys else rows.select("n", F.coalesce(start, F.lit(0)).alias(start), F.coalesce(end, F.lit(0)).alias(end))


def concat(parts: Sequence[DataFrame] | dict[str, DataFrame], key: str = "part") -> DataFrame:
    """All rows of several tables; from a dict, with its keys as a further column."""
    frames = [d.withColumn(key, F.lit(k)) for k, d in parts.items()] if isinstance(parts, dict) else list(parts)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merge_sorted(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """All intervals of both tables by keys, start and end, those of ``a`` first on ties; ``side`` tells where from."""
    both = a.select(*keys, start, end, F.lit(0).alias("side")).unionByName(b.select(*keys, start, end, F.lit(1).alias("side")))
    return both.orderBy(*keys, start, end, "side")


def union_other(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """Islands of two sets together; groups of either table are kept."""
    return union_self(a.select(*keys, start, end).unionByName(b.select(*keys, start, end)), keys, start, end)


def intersect_other(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """What two sets have in common: islands of each, joined where they overlap; the result is disjoint."""
    from weftspan.operators.joins import overlapping_pairs

    left = cut(union_self(a, keys, start, end)).withColumnsRenamed({start: "_s1", end: "_e1"})
    right = cut(union_self(b, keys, start, end)).withColumnsRenamed({start: "_s2", end: "_e2"})
    pairs = overlapping_pairs(left, right, ("_s1", "_e1"), ("_s2", "_e2"), keys)
    return pairs.select(*keys, F.greatest("_s1", "_s2").alias(start), F.least("_e1", "_e2").alias(end))


def from_records(source: SparkSession | DataFrame, records: Sequence[tuple] | str, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """A table of given intervals: records of the key columns (text) and both ends; no records give no rows.

    Records are tuples, or a column of structs of a table, whose fields are taken by position. An interval that ends
    before it starts is an error, of the job in a table; null records are left out.
    """
    names = [*keys, start, end]
    if isinstance(source, DataFrame):
        fields = source.schema[records].dataType.fieldNames()
        if len(fields) != len(names):
            raise ValueError(f"a record must have {len(names)} values")
        rows = source.filter(F.col(records).isNotNull()).select(*(F.col(records)[f].cast("long" if i >= len(keys) else "string").alias(n) for i, (f, n) in enumerate(zip(fields, names, strict=True))))
        wrong = F.raise_error(F.lit("an interval ends before it starts"))
        return rows.withColumn(end, F.when(F.col(end) < F.col(start), wrong.cast("long")).otherwise(F.col(end)))
    if any(len(r) != len(names) for r in records):
        raise ValueError(f"a record must have {len(names)} values")
    if any(r[-2] > r[-1] for r in records):
        raise ValueError("an interval ends before it starts")
    return source.createDataFrame(list(records), ", ".join([*(f"`{k}` string" for k in keys), f"`{start}` long", f"`{end}` long"]))


def subset(df: DataFrame, take: Column | Sequence[int], row_id: str | None = None) -> DataFrame:
    """Rows that a condition holds for, or those with the given numbers in the column ``row_id``, once for each time
    that a number is given; ``place`` is where it stands in the list."""
    if isinstance(take, Column):
        return df.filter(take)
    asked = df.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(take)], "_row long, place long")
    return df.join(asked, F.col(row_id) == F.col("_row")).drop("_row")


def drop_empty(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.filter(F.col(start) != F.col(end))


def sort(df: DataFrame, start: str = "start", end: str = "end", keys: Sequence[str] = (), ascending: bool = True) -> DataFrame:
    """By start and end, after the keys if any are given."""
    return df.orderBy(*keys, start, end, ascending=ascending)


def head(df: DataFrame, n: int, start: str = "start", end: str = "end") -> DataFrame:
    """The first n intervals in order."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(start, end).limit(n)


def tail(df: DataFrame, n: int, start: str = "start", end: str = "end") -> DataFrame:
    """The last n intervals, in order."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(F.desc(start), F.desc(end)).limit(n).orderBy(start, end)
