"""Joins: overlap of intervals within a tolerance, three tables at once, and outer alignment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.functions.intervals import Interval, floor_div

#: Lengths of one class differ by this factor at most; the class is the exponent.
FACTOR = 16
#: The largest class: every length of 64 bits is below FACTOR ** CLASSES.
CLASSES = 16
#: Rows of a three-way merge that one task makes, about.
TASK_ROWS = 1 << 22
#: Tasks that a merge is dealt to at most.
MOST_TASKS = 1 << 14
#: Rows of a side that a range join takes as one.
PACK_ROWS = 1 << 7
#: Rows of a side up to which it is sent to all executors.
SENT_ROWS = 1 << 19
#: Rows of one key that are sent as a block, and blocks that a task goes through for a row of the other side.
BLOCK_ROWS, TASK_BLOCKS = 1 << 8, 1 << 4


def length_class(length: Column) -> Column:
    """The smallest k with length <= FACTOR ** k."""
    k = F.lit(CLASSES)
    for i in range(CLASSES - 1, -1, -1):
        k = F.when(length <= F.lit(FACTOR**i), i).otherwise(k)
    return k


def _classes(df: DataFrame, i: Interval) -> Column:
    """The classes that a table has, CLASSES + 1 at most: a scalar subquery, so that nothing runs before the join does."""
    return df.agg(F.sort_array(F.collect_set(length_class(i.length())))).scalar()


def _dealt(df: DataFrame, i: Interval, levels: Column) -> DataFrame:
    """A row for each level (class, side) and each bucket of the class's width that the interval lies in; two at most."""
    level = df.withColumn("_level", F.explode(levels))
    width = F.element_at(F.array(*(F.lit(FACTOR**k) for k in range(CLASSES))), F.col("_level.k") + 1)
    buckets = F.sequence(floor_div(i.start, width), floor_div(F.greatest(i.start, i.end - 1), width))
    return level.withColumns({"_width": width, "_bucket": F.explode(buckets)})


def _packed(df: DataFrame, own: Sequence[str], ends: tuple[str, str], name: str) -> DataFrame:
    """Rows of equal ``own`` columns as arrays of PACK_ROWS rows that lie close together, and where an array begins and ends.

    The number of tasks is given, as it has to follow the pairs that rows make, not their bytes.
    """
    df = df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *own)
    number = F.row_number().over(Window.partitionBy(*own).orderBy(*ends)) - 1
    rows = F.struct(*(c for c in df.columns if c not in own))
    packs = df.withColumn("_pack", F.floor(number / PACK_ROWS)).groupBy(*own, "_pack").agg(F.collect_list(rows).alias(name), F.min(ends[0]).alias(f"{name}_low"), F.max(ends[1]).alias(f"{name}_high"))
    return packs.drop("_pack")


def overlapping_pairs(a: DataFrame, b: DataFrame, ends_a: tuple[str, str], ends_b: tuple[str, str], keys: Sequence[str] = (), width: int | None = None, packed: bool = False) -> DataFrame:
    """Rows of ``a`` and ``b`` with equal keys whose intervals overlap: start < other end, both ways.

    Intervals have classes by length. A pair meets at the class of the longer one, in buckets as wide as that class, of
    which either interval touches two at most; so neither one very long interval nor many short ones multiply rows. A
    pair is kept only in the bucket where its overlap begins, so it comes out once. Empty intervals pair if strictly
    inside another. Column names other than the keys must differ. The join is a plain equi-join on keys, class and
    bucket: skewed buckets are split by adaptive execution, and a small side is broadcast only where Spark measures it
    to be small. With a ``width`` all intervals are dealt into buckets of that width. With ``packed`` rows of a bucket
    that lie close together are joined as arrays, and of two arrays that may meet all pairs are looked at: pairs come out
    in an order that repeats few values, for results that are much larger than the tables.
    """
    ia, ib = Interval.of(*ends_a), Interval.of(*ends_b)
    if width:
        split = lambda df, i: df.withColumns({"_level": F.lit(0), "_width": F.lit(width).cast("long"), "_bucket": F.explode(F.sequence(floor_div(i.start, width), floor_div(F.greatest(i.start, i.end - 1), width)))})
        left, right = split(a, ia), split(b, ib)
    else:
        in_a, in_b = _classes(a, ia), _classes(b, ib)
        at = lambda ks, side, keep: F.transform(F.filter(ks, keep), lambda k: F.struct(k.alias("k"), F.lit(side).alias("side")))
        own_a, own_b = length_class(ia.length()), length_class(ib.length())
        known = lambda df: df.withColumns({"_in_a": in_a, "_in_b": in_b})
        # Side 0: the longer is of a (or both are of one class); side 1: the longer is of b.
        left = _dealt(known(a), ia, F.concat(at("_in_a", 0, lambda k: k == own_a), at("_in_b", 1, lambda k: k > own_a))).drop("_in_a", "_in_b")
        right = _dealt(known(b), ib, F.concat(at("_in_a", 0, lambda k: k >= own_b), at("_in_b", 1, lambda k: k == own_b))).drop("_in_a", "_in_b")
    own, right = [*keys, "_level", "_bucket"], right.drop("_width")
    if packed:
        packs = _packed(left, own, ends_a, "_of_a").join(_packed(right, own, ends_b, "_of_b"), own)
        packs = packs.filter((F.col("_of_a_low") < F.col("_of_b_high")) & (F.col("_of_b_low") < F.col("_of_a_high")))
        one = packs.select(*own, F.explode("_of_a").alias("_a"), "_of_b", "_of_b_low", "_of_b_high")
        one = one.filter((F.col(f"_a.{ends_a[0]}") < F.col("_of_b_high")) & (F.col("_of_b_low") < F.col(f"_a.{ends_a[1]}"))).select(*own, "_a", F.explode("_of_b").alias("_b"))
        pairs = one.select(*own, "_a.*", "_b.*")
    else:
        pairs = left.join(right, own)
    first = F.greatest(floor_div(ia.start, F.col("_width")), floor_div(ib.start, F.col("_width")))
    return pairs.filter((ia.start < ib.end) & (ib.start < ia.end) & (F.col("_bucket") == first)).drop("_level", "_width", "_bucket")


def range_join(a: DataFrame, b: DataFrame, ends_a: tuple[str, str] = ("start", "end"), ends_b: tuple[str, str] = ("start", "end"), on: Sequence[str] | Sequence[tuple[str, str]] = (), tolerance: int = 0, suffixes: tuple[str, str] = ("_A", "_B"), overlap: str = "overlap", width: int | None = None, packed: bool = True) -> DataFrame:
    """All columns of both tables for each pair that overlaps, or comes within ``tolerance`` of it.

    ``on``: columns that must agree, by one name or a name in each table. Columns that both tables have get a suffix.
    ``overlap`` is minus the offset: positions in common, negative for pairs that are only near.
    Where many intervals lie on each other the result grows with the square of the tables, so it is made in packs;
    without ``packed`` it is made row by row, for pairs that are summed up at once.
    """
    pairs = [(x, x) if isinstance(x, str) else x for x in on]
    shared = set(a.columns) & set(b.columns)
    name = lambda c, s: c + s if c in shared else c
    left = a.select(*(F.col(c).alias(name(c, suffixes[0])) for c in a.columns))
    right = b.select(*(F.col(c).alias(name(c, suffixes[1])) for c in b.columns))
    sa, ea = (name(c, suffixes[0]) for c in ends_a)
    sb, eb = (name(c, suffixes[1]) for c in ends_b)
    wide_a = Interval.of(sa, ea).expand(math.ceil(tolerance / 2))
    wide_b = Interval.of(sb, eb).expand(math.floor(tolerance / 2))
    left = wide_a.assign_to(left, "_sa", "_ea").withColumns({f"_on{i}": F.col(name(x, suffixes[0])) for i, (x, _) in enumerate(pairs)})
    right = wide_b.assign_to(right, "_sb", "_eb").withColumns({f"_on{i}": F.col(name(y, suffixes[1])) for i, (_, y) in enumerate(pairs)})
    found = overlapping_pairs(left, right, ("_sa", "_ea"), ("_sb", "_eb"), [f"_on{i}" for i in range(len(pairs))], width, packed)
    depth = -(Interval.of("_sa", "_ea").offset(Interval.of("_sb", "_eb")) + tolerance)
    return found.withColumn(overlap, depth).drop("_sa", "_ea", "_sb", "_eb", *(f"_on{i}" for i in range(len(pairs))))


def merge_ranges(a: DataFrame, b: DataFrame, by: Sequence[str], on: Sequence[str], ids: Sequence[str], inner_on: Sequence[str] = (), ends: tuple[str, str] = ("start", "end"), tolerance: int = 0, suffixes: tuple[str, str] = ("_A", "_B"), overlap: str = "overlap") -> DataFrame:
    """Range join of two tables on ``on`` and ``inner_on``, with their ``by`` and ``ids`` columns side by side."""
    keep = list(dict.fromkeys([*by, *ids, *on, *inner_on, *ends]))
    return range_join(a.select(*keep), b.select(*keep), ends, ends, [*on, *inner_on], tolerance, suffixes, overlap, packed=False)


def merge_ranges_single(df: DataFrame, by: Sequence[str], on: Sequence[str], ids: Sequence[str], inner_on: Sequence[str] = (), **options) -> DataFrame:
    """A table's range join with itself: pairs of a row with itself and both orders of other pairs."""
    return merge_ranges(df, df, by, on, ids, inner_on, **options)


def merge_three(left: DataFrame, mid: DataFrame, right: DataFrame, mid_to_left: Sequence[str], mid_to_right: Sequence[str], left_on: Sequence[str], right_on: Sequence[str], inner: bool = True, suffixes: tuple[str, str, str] = ("_left", "", "_right")) -> DataFrame:
    """``mid`` joined with ``left`` and ``right``; a column that two or more tables have gets its table's suffix.

    Every row of ``left`` meets every row of ``right`` at its row of ``mid``, so a few keys may make many rows. These are
    counted by key first, and the rows to be matched are dealt evenly to as many tasks as the result needs: a table's
    bytes or its number of keys do not bound how many tasks share the work. Rows come out in blocks that repeat few
    values (see ``_in_blocks``), as the result is by far the largest table that has to be stored.
    """
    tables = (left, mid, right)
    count: dict[str, int] = {}
    for t in tables:
        for c in t.columns:
            count[c] = count.get(c, 0) + 1
    renamed = [t.select(*(F.col(c).alias(f"_{i}_{c}") for c in t.columns)) for i, t in enumerate(tables)]
    how = "inner" if inner else "left"

    def match(own: Sequence[str], side: int, other: Sequence[str]) -> Column:
        cond = F.lit(True)
        for x, y in zip(own, other, strict=True):
            cond = cond & (F.col(f"_1_{x}") == F.col(f"_{side}_{y}"))
        return cond

    joined, last = renamed[1].join(renamed[0], match(mid_to_left, 0, left_on), how), renamed[2]
    cond = match(mid_to_right, 2, right_on)
    sizes = [joined.groupBy(*(f"_1_{c}" for c in mid_to_right)).agg(F.count("*").alias("_m")), last.groupBy(*(f"_2_{c}" for c in right_on)).agg(F.count("*").alias("_n"))]
    rows, n = sizes[0].join(sizes[1], cond, "left").agg(F.sum(F.col("_m") * F.coalesce("_n", F.lit(1))), F.sum("_n")).first()
    tasks = min(math.ceil((rows or 0) / TASK_ROWS), MOST_TASKS)
    if tasks > 1 and (n or 0) <= SENT_ROWS:
        joined, last, cond = _in_blocks(joined, last, [f"_1_{c}" for c in mid_to_right], [f"_2_{c}" for c in right_on], sizes, tasks)
    elif tasks > 1:  # each row of one side goes to one of several parts of its key, those of the other to all of them
        parts = min(tasks, 64)
        joined = joined.withColumn("_part", F.pmod(F.xxhash64(*joined.columns), F.lit(parts)).cast("int")).repartition(tasks, *(f"_1_{c}" for c in mid_to_right), "_part")
        last = last.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, *(f"_2_{c}" for c in right_on), "_to")
        cond = cond & (F.col("_part") == F.col("_to"))
    joined = joined.join(last, cond, how)
    out = [F.col(f"_{i}_{c}").alias(c + suffixes[i] if count[c] > 1 else c) for i, t in enumerate(tables) for c in t.columns]
    return joined.select(*out)


def _in_blocks(a: DataFrame, b: DataFrame, on_a: Sequence[str], on_b: Sequence[str], sizes: Sequence[DataFrame], tasks: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a join and its condition, with the rows of ``a`` dealt to ``tasks`` tasks of equal results.

    ``b`` (of SENT_ROWS at most) is sent to all, in blocks of rows of one key. A task has a range of the pairs in the
    order of keys and takes block by block, each for all its rows of ``a``: of its rows in a file, one side's values stay
    the same for a block and the other's return after a block, which is what encodings by runs and repeats make small.
    ``sizes``: rows by key, ``_m`` of ``a`` and ``_n`` of ``b``.
    """
    keys = [f"_k{i}" for i in range(len(on_b))]
    same = lambda own, other: reduce(and_, (F.col(x) == F.col(y) for x, y in zip(own, other, strict=True)), F.lit(True))
    known = sizes[1].withColumnsRenamed(dict(zip(on_b, keys, strict=True))).join(sizes[0], same(on_a, keys)).select(*keys, "_n", (F.col("_m") * F.col("_n")).alias("_pairs"))
    before = F.sum("_pairs").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    known = known.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_pairs").over(Window.partitionBy())})
    blocks = F.ceil(F.coalesce("_n", F.lit(1)) / BLOCK_ROWS).cast("int")
    parts = F.ceil(blocks / TASK_BLOCKS).cast("int")
    hashed = [c for c, kind in a.dtypes if "map<" not in kind and "variant" not in kind]
    within = F.pmod(F.xxhash64(F.spark_partition_id(), *hashed), F.lit(1 << 30)) / (1 << 30)  # also of equal rows
    place = F.coalesce((F.col("_before") + F.col("_pairs") * ((F.col("_part") + F.col("_within")) / parts)) / F.col("_all"), F.col("_within"))
    dealt = a.join(F.broadcast(known), same(on_a, keys), "left").withColumn("_within", within).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("_task", F.least(F.floor(place * tasks), F.lit(tasks - 1)).cast("int")).repartitionById(tasks, "_task")
    first = F.col("_part") * TASK_BLOCKS
    dealt = dealt.withColumn("_to", F.explode(F.sequence(first, F.least(first + TASK_BLOCKS, blocks) - 1))).sortWithinPartitions(*on_a, "_to")
    dealt = dealt.filter(F.spark_partition_id() >= 0)  # Spark leaves out a sort whose rows go into a join, but not this one's
    number = F.row_number().over(Window.partitionBy(*on_b).orderBy(*on_b)) - 1
    sent = b.withColumn("_block", F.floor(number / BLOCK_ROWS).cast("int"))
    return dealt, F.broadcast(sent), same(on_a, on_b) & (F.col("_to") == F.col("_block"))


def align(tables: dict[str, DataFrame], keys: Sequence[str], missing: str = "") -> DataFrame:
    """Full outer alignment on keys: one column for each table's ``path``, ``missing`` where it has none."""
    out = None
    for name, t in tables.items():
        part = t.select(*keys, F.col("path").alias(name))
        out = part if out is None else out.join(part, list(keys), "full_outer")
    return out.fillna(missing, subset=list(tables)).orderBy(*keys)


def group_members(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """(keys, row_id, place, n): each row's place in its group, by row id, and the size of the group."""
    own = Window.partitionBy(*keys)
    return df.select(*keys, row_id, (F.row_number().over(own.orderBy(row_id)) - 1).cast("long").alias("place"), F.count("*").over(own).alias("n"))


def match_groups(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Keys of two tables with how many rows each has of them; ``how``: inner, left, right or outer."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown kind of match: {how}")
    left, right = a.groupBy(*keys).agg(F.count("*").alias("n_A")), b.groupBy(*keys).agg(F.count("*").alias("n_B"))
    return left.join(right, list(keys), "full_outer" if how == "outer" else how).fillna(0, subset=["n_A", "n_B"])


def join_by_indices(a: DataFrame, b: DataFrame, pairs: DataFrame, row_id: str = "row_id", suffixes: tuple[str, str] = ("_A", "_B")) -> DataFrame:
    """Rows of two tables side by side, by pairs (i, j) of their row ids."""
    left = a.select(*(F.col(c).alias(c + suffixes[0]) for c in a.columns))
    right = b.select(*(F.col(c).alias(c + suffixes[1]) for c in b.columns))
    return pairs.join(left, pairs["i"] == left[row_id + suffixes[0]]).join(right, pairs["j"] == right[row_id + suffixes[1]]).drop("i", "j")
