"""Half-open integer intervals [start, end) as pairs of columns; every operation is a Column expression.

An interval is empty if start = end and valid if start <= end. Intervals that touch do not overlap. All divisions are
floor divisions, also below zero.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Number = int | Column


def _lit(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def floor_div(x: Number, n: Number) -> Column:
    """Floor division of integers; ``div`` truncates, so the remainder goes first."""
    x, n = _lit(x), _lit(n)
    return F.call_function("div", x - F.pmod(x, n), n)


def bin_coords(x: Number, size: int, origin: int = 0) -> Column:
    """Number of the bin of ``size`` that a coordinate falls into."""
    if size <= 0:
        raise ValueError("the bin size must be positive")
    return floor_div(_lit(x) - origin, size)


@dataclass(frozen=True)
class Interval:
    """Two Columns that hold the ends of an interval."""

    start: Column
    end: Column

    @classmethod
    def of(cls, start: Number | str = "start", end: Number | str | None = "end") -> Interval:
        """From column names, Columns or numbers; without an end, the points [start, start]."""
        s = F.col(start) if isinstance(start, str) else _lit(start)
        e = s if end is None else F.col(end) if isinstance(end, str) else _lit(end)
        return cls(s, e)

    @classmethod
    def named(cls, prefix: str = "", suffix: str = "") -> Interval:
        """From columns called prefix + start/end + suffix."""
        return cls.of(f"{prefix}start{suffix}", f"{prefix}end{suffix}")

    # -- one interval

    def length(self) -> Column:
        return self.end - self.start

    def center(self) -> Column:
        return floor_div(self.start + self.end, 2)

    def is_empty(self) -> Column:
        return self.end == self.start

    def is_valid(self) -> Column:
        return self.end >= self.start

    def bin_indices(self, size: int, origin: int = 0) -> Interval:
        """The range of bins that the interval touches; an empty interval touches the bin of its start."""
        return Interval(bin_coords(self.start, size, origin), bin_coords(F.greatest(self.start, self.end - 1), size, origin) + 1)

    def bin(self, size: int, origin: int = 0) -> Interval:
        """The interval widened to whole bins."""
        if size <= 0:
            raise ValueError("the bin size must be positive")
        last = F.greatest(self.start, self.end - 1)
        down = lambda x: x - F.pmod(x - origin, F.lit(size).cast("long"))
        return Interval(down(self.start), down(last) + size)

    def expand(self, left: Number, right: Number | None = None) -> Interval:
        """Widened at both ends, or narrowed by negative amounts, but never inverted: the start gives way first."""
        start = F.least(self.start - _lit(left), self.end)
        return Interval(start, F.greatest(self.end + _lit(left if right is None else right), start))

    def shift(self, by: Number) -> Interval:
        return Interval(self.start + _lit(by), self.end + _lit(by))

    def clip(self, left: Number | None = None, right: Number | None = None) -> Interval:
        """Both ends moved into [left, right]."""
        if isinstance(left, int) and isinstance(right, int) and left > right:
            raise ValueError("left must not be greater than right")

        def inside(x: Column) -> Column:
            x = x if left is None else F.greatest(x, _lit(left))
            return x if right is None else F.least(x, _lit(right))

        return Interval(inside(self.start), inside(self.end))

    def split_at(self, point: Number) -> tuple[Interval, Interval]:
        """What lies before and after a point."""
        p = _lit(point)
        return Interval(F.least(self.start, p), F.least(p, self.end)), Interval(F.greatest(self.start, p), F.greatest(p, self.end))

    def split_at_length(self, n: Number) -> tuple[Interval, Interval]:
        """Split after the first n positions; before the last -n if n is negative."""
        n = _lit(n)
        return self.split_at(F.when(n >= 0, self.start + n).otherwise(self.end + n))

    def split_at_ratio(self, ratio: float) -> tuple[Interval, Interval]:
        """Split after a part of the length, rounded half to even."""
        return self.split_at_length(F.bround(self.length() * F.lit(float(ratio))).cast("long"))

    # -- two intervals

    def equals(self, other: Interval) -> Column:
        return (self.start == other.start) & (self.end == other.end)

    def differs(self, other: Interval) -> Column:
        return ~self.equals(other)

    def intersect(self, other: Interval) -> Interval:
        """The common part, or the empty interval at the larger start."""
        start = F.greatest(self.start, other.start)
        return Interval(start, F.greatest(start, F.least(self.end, other.end)))

    def unite(self, other: Interval) -> tuple[Interval, Interval]:
        """Two intervals that cover both: the hull and an empty one if they meet, else the two in order."""
        meet = self.distance(other) <= 0
        low, high = F.least(self.end, other.end), F.greatest(self.start, other.start)
        hull = self.sup(other)
        return Interval(hull.start, F.when(meet, hull.end).otherwise(low)), Interval(F.when(meet, hull.end).otherwise(high), hull.end)

    def sup(self, other: Interval) -> Interval:
        """The hull."""
        return Interval(F.least(self.start, other.start), F.greatest(self.end, other.end))

    def gap_between(self, other: Interval) -> Interval:
        start = F.least(self.end, other.end)
        return Interval(start, F.greatest(start, F.greatest(self.start, other.start)))

    def offset(self, other: Interval | Number) -> Column:
        """How far apart; the depth of the overlap if negative. A number stands for a point."""
        other = other if isinstance(other, Interval) else Interval(_lit(other), _lit(other))
        return F.greatest(other.start - self.end, self.start - other.end)

    def distance(self, other: Interval | Number) -> Column:
        return F.greatest(self.offset(other), F.lit(0))

    def overlap(self, other: Interval) -> Column:
        """Positions in common, at most the shorter length."""
        return F.least(self.length(), other.length(), -F.least(self.offset(other), F.lit(0)))

    # -- predicates

    def contains(self, other: Interval | Number) -> Column:
        if not isinstance(other, Interval):
            p = _lit(other)
            return (self.start <= p) & ((p < self.end) | self.is_empty())
        return (self.start <= other.start) & ((other.start < self.end) | self.is_empty()) & ((self.start < other.end) | other.is_empty()) & (other.end <= self.end)

    def is_superset_of(self, other: Interval | Number) -> Column:
        return self.contains(other) | other.is_empty() if isinstance(other, Interval) else self.contains(other)

    def is_contained_in(self, other: Interval) -> Column:
        return other.contains(self)

    def is_subset_of(self, other: Interval) -> Column:
        return other.contains(self) | self.is_empty()

    def intersects(self, other: Interval) -> Column:
        return self.overlap(other) > 0

    def is_separated_from(self, other: Interval) -> Column:
        """Whether something lies between; intervals that touch are not separated."""
        return self.offset(other) > 0

    # -- columns and text

    def columns(self, start: str = "start", end: str = "end") -> list[Column]:
        return [self.start.alias(start), self.end.alias(end)]

    def assign_to(self, df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
        return df.withColumns({start: self.start, end: self.end})

    def struct(self) -> Column:
        return F.struct(*self.columns())

    def to_string(self, *keys: Column | str, sep: str = "-", key_sep: str = ":") -> Column:
        """key:start-end"""
        ends = F.concat_ws(sep, self.start.cast("string"), self.end.cast("string"))
        return F.concat_ws(key_sep, *(k if isinstance(k, Column) else F.col(k) for k in keys), ends) if keys else ends


def format_columns(template: str, **named: Column) -> Column:
    """A text template over columns: ``{name}`` or ``{name:spec}``, with Java format specifications (``{x:,d}``)."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\w+)(?::([^{}]*))?\}|\{\{|\}\}", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[1] is None:
            parts.append(F.lit(m[0][0]))
        else:
            c = named.get(m[1], F.col(m[1]))
            parts.append(F.format_string(f"%{m[2]}", c) if m[2] else c.cast("string"))
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def split_text(text: Column | str, sep: str, n: int) -> list[Column]:
    """The ``n`` parts of a separated text; a row with another number of parts, or an empty one, is an error."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(c, re.escape(sep))
    sound = (F.size(parts) == n) & ~F.exists(parts, lambda p: p == "")
    checked = F.when(sound, parts).otherwise(F.raise_error(F.concat(F.lit("not in parts: "), c)).cast("array<string>"))
    return [F.get(checked, i) for i in range(n)]


def parse_intervals(text: Column | str, keys: int = 1, sep: str = "-", key_sep: str = ":") -> tuple[list[Column], Interval]:
    """(key columns, interval) of texts like ``chr1:5-9``. What does not parse is an error."""
    *names, ends = split_text(text, key_sep, keys + 1) if keys else [F.col(text) if isinstance(text, str) else text]
    start, end = split_text(ends, sep, 2)
    return names, Interval(start.cast("long"), end.cast("long"))


def require_integers(df: DataFrame, *names: str) -> DataFrame:
    """``df``, if the named columns hold integers; a TypeError otherwise."""
    for name in names:
        if not isinstance(df.schema[name].dataType, T.IntegralType):
            raise TypeError(f"column {name} must hold integers, not {df.schema[name].dataType.simpleString()}")
    return df


def require_valid(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """``df`` with integer ends; a row whose end is before its start fails the job."""
    require_integers(df, start, end)
    return df.withColumn(end, F.when(F.col(end) >= F.col(start), F.col(end)).otherwise(F.raise_error(F.lit("an interval ends before it starts")).cast("long")))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
