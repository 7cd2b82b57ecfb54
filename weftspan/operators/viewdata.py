"""What a heatmap shows, as tables: points, rectangles, loop clusters, gap segments and labels in a window.

``where``: upper, lower, both (a row in either triangle) or asis.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.functions.intervals import Interval, floor_div
from weftspan.operators.features import quantiles


@dataclass(frozen=True)
class View:
    """A window of a map: inclusive limits of both axes, bin size, and chromosomes (None: any)."""

    x: tuple[int, int]
    y: tuple[int, int]
    resolution: int = 5000
    x_chromosome: str | None = None
    y_chromosome: str | None = None

    def scaled_x(self, c: Column) -> Column:
        return (c - self.x[0]) / F.lit(float(self.resolution))

    def scaled_y(self, c: Column) -> Column:
        return (c - self.y[0]) / F.lit(float(self.resolution))

    def unit(self) -> tuple[str, int]:
        """Unit of the axes by the larger extent: base pairs, thousands from 100 thousand, millions from 10 million."""
        most = max(self.x[1] - self.x[0], self.y[1] - self.y[0])
        return ("mb", 10**6) if most >= 10**7 else ("kb", 10**3) if most >= 10**5 else ("bp", 1)


def _sides(where: str) -> list[str]:
    kinds = {"u": ["upper"], "l": ["lower"], "b": ["upper", "lower"], "a": ["asis"]}
    if where[:1].lower() not in kinds:
        raise ValueError(f"unknown triangle: {where}")
    return kinds[where[0].lower()]


def _mirrored(df: DataFrame, where: str, flip: dict[str, Column], pairs: list[tuple[str, str]]) -> DataFrame:
    """``df`` once for each side, with the column pairs swapped where that side asks for it."""
    sides = _sides(where)
    rows = df.withColumn("side", F.explode(F.array(*map(F.lit, sides))))
    swap = F.lit(False)
    for side in sides:
        if side in flip:
            swap = F.when(F.col("side") == side, flip[side]).otherwise(swap)
    rows = rows.withColumn("_swap", swap)
    for a, b in pairs:
        rows = rows.withColumns({a: F.when(F.col("_swap"), F.col(b)).otherwise(F.col(a)), b: F.when(F.col("_swap"), F.col(a)).otherwise(F.col(b))})
    return rows.drop("_swap")


def points(df: DataFrame, view: View, where: str = "asis", x: str = "x", y: str = "y") -> DataFrame:
    """Points inside the window, with their place in bins (x_bin, y_bin)."""
    rows = _mirrored(df, where, {"upper": F.col(y) > F.col(x), "lower": F.col(y) < F.col(x)}, [(x, y)])
    rows = rows.filter(F.col(x).between(*view.x) & F.col(y).between(*view.y))
    return rows.withColumns({"x_bin": view.scaled_x(F.col(x)), "y_bin": view.scaled_y(F.col(y))})


def rectangles(df: DataFrame, view: View, where: str = "asis", x0: str = "start_x", x1: str = "end_x", y0: str = "start_y", y1: str = "end_y") -> DataFrame:
    """Rectangles that meet the window, with corner and size in bins; other columns, such as a score, stay with them."""
    below = F.abs(F.col(y0) - F.col(x1)) < F.abs(F.col(y1) - F.col(x0))
    marked = df.withColumn("_below", below)
    rows = _mirrored(marked, where, {"upper": F.col("_below"), "lower": ~F.col("_below")}, [(x0, y0), (x1, y1)]).drop("_below")
    rows = rows.filter((F.col(x0) <= view.x[1]) & (F.col(x1) >= view.x[0]) & (F.col(y0) <= view.y[1]) & (F.col(y1) >= view.y[0]))
    return rows.withColumns({"x_bin": view.scaled_x(F.col(x0)), "y_bin": view.scaled_y(F.col(y0)), "width_bins": (F.col(x1) - F.col(x0)) / F.lit(float(view.resolution)), "height_bins": (F.col(y1) - F.col(y0)) / F.lit(float(view.resolution))})


def regions(df: DataFrame, view: View, where: str = "asis") -> DataFrame:
    """Rectangles on the window's two chromosomes (chromosome_x and chromosome_y)."""
    if view.x_chromosome is not None:
        df = df.filter((F.col("chromosome_x") == view.x_chromosome) & (F.col("chromosome_y") == view.y_chromosome))
    return rectangles(df, view, where)


def loops(df: DataFrame, view: View, where: str = "both") -> DataFrame:
    """Centres of the two anchors of interactions, as points."""
    if view.x_chromosome is not None:
        df = df.filter((F.col("chromosome_A") == view.x_chromosome) | (F.col("chromosome_B") == view.y_chromosome))
    centres = df.withColumns({"x": Interval.named(suffix="_A").center(), "y": Interval.named(suffix="_B").center()})
    return points(centres, view, where)


def in_view(stripes: DataFrame, view: View) -> DataFrame:
    """Stripes of either chromosome whose anchors meet the window along either axis."""
    if view.x_chromosome is None:
        return stripes
    meets = lambda lim: (F.col("anchor_start") <= lim[1]) & (F.col("anchor_end") >= lim[0])
    return stripes.filter(F.col("chromosome").isin(view.x_chromosome, view.y_chromosome) & (meets(view.x) | meets(view.y)))


def stripe_rectangles(stripes: DataFrame, view: View, where: str = "both", pad_w: int = 0, pad_l: int = 0) -> DataFrame:
    """One rectangle for each stripe; the anchor is padded by ``pad_w``, the far end by ``pad_l``."""
    if view.x_chromosome is not None:
        stripes = stripes.filter(F.col("chromosome").isin(view.x_chromosome, view.y_chromosome))
    left = F.col("direction") == "L"
    rows = stripes.select(
        "stripe_id", "direction", F.col("chromosome").alias("chromosome_x"), (F.col("anchor_start") - pad_w).alias("start_x"), (F.col("anchor_end") + pad_w).alias("end_x"),
        F.col("chromosome").alias("chromosome_y"), (F.col("start") - F.when(left, pad_l).otherwise(0)).alias("start_y"), (F.col("end") + F.when(left, 0).otherwise(pad_l)).alias("end_y"),
    )
    return regions(rows, view, where)


def _with_position(rows: DataFrame, stripes: DataFrame) -> DataFrame:
    middle = stripes.select("stripe_id", "chromosome", floor_div(F.col("anchor_start") + F.col("anchor_end"), 2).alias("position"))
    return rows.join(middle, "stripe_id")


def loop_cluster_rectangles(rows: DataFrame, stripes: DataFrame, view: View, where: str = "both", score: str = "stripe_score") -> DataFrame:
    """One rectangle for each loop cluster of the stripes in view; its anchor side reaches to the stripe's middle."""
    found = _with_position(rows, in_view(stripes, view))
    first = F.col("anchor_start") <= F.col("leafs_start")
    box = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    left, right = F.col("direction") == "L", F.col("direction") == "R"
    lo_x, hi_x, lo_y, hi_y = box("anchor_start", "leafs_start"), box("anchor_end", "leafs_end"), box("leafs_start", "anchor_start"), box("leafs_end", "anchor_end")
    out = found.select(
        "stripe_id", "lc_idx", "direction", F.col("chromosome").alias("chromosome_x"), F.col("chromosome").alias("chromosome_y"),
        F.when(left, lo_x).otherwise(F.least(lo_x, "position")).alias("start_x"), F.when(left, hi_x).otherwise(F.greatest(hi_x, "position")).alias("end_x"),
        F.when(right, lo_y).otherwise(F.least(lo_y, "position")).alias("start_y"), F.when(right, hi_y).otherwise(F.greatest(hi_y, "position")).alias("end_y"), F.col(score).alias("score"),
    )
    return regions(out, view, where)


def gap_segments(rows: DataFrame, stripes: DataFrame, view: View, where: str = "upper", score: str = "stripe_score") -> DataFrame:
    """(stripe_id, lc_idx, x0, y0, x1, y1, score): from the end of the previous leafs to the next, along the stripe."""
    from pyspark.sql.window import Window

    found = _with_position(rows, in_view(stripes, view))
    w = Window.partitionBy("stripe_id").orderBy("lc_idx")
    right, pos = F.col("direction") == "R", F.col("position")
    before = F.coalesce(F.lag(F.when(right, F.col("leafs_end")).otherwise(F.col("leafs_start"))).over(w), pos)
    ends = {"x0": F.when(right, before).otherwise(pos), "y0": F.when(right, pos).otherwise(before), "x1": F.when(right, F.col("leafs_start")).otherwise(pos), "y1": F.when(right, pos).otherwise(F.col("leafs_end"))}
    out = found.select("stripe_id", "lc_idx", *(c.alias(n) for n, c in ends.items()), F.col(score).alias("score"))
    if where.startswith("l"):
        out = out.select("stripe_id", "lc_idx", F.col("y0").alias("x0"), F.col("x0").alias("y0"), F.col("y1").alias("x1"), F.col("x1").alias("y1"), "score")
    return out


def stripe_labels(rows: DataFrame, stripes: DataFrame) -> DataFrame:
    """(stripe_id, x, y, label): the far end and middle of each stripe, and its scores as text."""
    order = F.col("lc_idx")
    facts = rows.groupBy("stripe_id", "direction").agg(F.max_by("stripe_score", order).alias("s"), F.avg("worst_gap_score").alias("g"), F.avg("cross_score").alias("c"), F.max("orientation_score").alias("o"), F.min("leafs_start").alias("low"), F.max("leafs_end").alias("high"))
    # Ties go to the even digit.
    text = F.format_string("%d(%.2f|%.2f|%.2f|%.1f)", "stripe_id", *(F.bround(c, 2) for c in "sgc"), F.bround("o", 1))
    return _with_position(facts, stripes).select("stripe_id", F.when(F.col("direction") == "R", F.col("high")).otherwise(F.col("low")).alias("x"), F.col("position").alias("y"), text.alias("label"))


def contact_matrix(df: DataFrame, view: View, value: str = "petcount") -> DataFrame:
    """(x_bin, y_bin, value): contacts of the window summed by bin, the long form of a heatmap."""
    found = loops(df, view, "asis")
    return found.groupBy(F.floor("x_bin").alias("x_bin"), F.floor("y_bin").alias("y_bin")).agg(F.sum(value).alias("value"))


def colour_limit(matrix: DataFrame, q: float = 0.95) -> DataFrame:
    """(limit): a quantile of the matrix values, 1 at least."""
    found = quantiles(matrix.select(F.lit("").alias("feature"), F.col("value").cast("double").alias("v")), [q])
    return found.agg(F.greatest(F.max("q"), F.lit(1.0)).alias("limit"))


def stripe_counts(stripes: DataFrame) -> DataFrame:
    return stripes.groupBy("chromosome", "direction").agg(F.count("*").alias("n"))
