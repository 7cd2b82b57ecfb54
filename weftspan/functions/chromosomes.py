"""Chromosome labels and their natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label and place in the order, as karyotypes are numbered.
_LETTERS = {"X": 23, "Y": 24, "M": 25}
#: Where labels without a number come.
LAST = 1_000_000
_PATTERN = r"^(?:chr)?(\d+|X|Y|M)"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chromosome_label(c: Column | str) -> Column:
    """``chr`` with the number or letter that the name begins with; other names are left as they are."""
    c = _column(c)
    core = F.regexp_extract(c, _PATTERN, 1)
    return F.when(core != "", F.concat(F.lit("chr"), core)).otherwise(c)


def chromosome_index(c: Column | str) -> Column:
    """1, 2, ... for numbered chromosomes, then X, Y, M; other names come last."""
    core = F.regexp_extract(_column(c), _PATTERN, 1)
    place = F.expr("cast(null as int)")
    for letter, i in _LETTERS.items():
        place = F.when(core == letter, F.lit(i)).otherwise(place)
    return F.coalesce(place, F.when(core != "", core.try_cast("int")), F.lit(LAST)).cast("int")


def strip_prefix(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), "^chr", "")


def add_prefix(c: Column | str) -> Column:
    return F.concat(F.lit("chr"), _column(c).cast("string"))
