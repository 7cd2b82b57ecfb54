"""Contact matrices as sparse cells: normalised, set against what distance lets expect, and stored at several resolutions.

A matrix is a table (chromosome_x, chromosome_y, x_bin, y_bin, value) of its cells that are not 0. It is symmetric, and
only one of the two cells (x, y) and (y, x) is kept: the one with the lower (chromosome, bin) first. No step makes the
empty cells; what is counted over them is counted from the numbers of bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.intervals import Interval, floor_div
from weftspan.functions.lineage import cut

CELL = ("chromosome_x", "chromosome_y", "x_bin", "y_bin")
#: Weights of at most so many bins are sent to all executors; of more, they are joined by a shuffle.
SENT_BINS = 1 << 20
#: Rounds of balancing after which it ends whether or not it has converged.
MOST_ROUNDS = 500
#: Bins along x in one tile of a stored matrix.
TILE_BINS = 256
#: Beyond the last position of any chromosome.
END = (1 << 63) - 1
METHODS = ("NONE", "VC", "VC_SQRT", "BALANCED")


def cells(contacts: DataFrame, resolution: int, value: str = "petcount", within: bool = True) -> DataFrame:
    """The matrix of contacts, summed by the bins of the centres of both anchors.

    ``within``: only contacts inside a chromosome. A null value counts as nothing; contacts without a place are left out.
    """
    if resolution < 1:
        raise ValueError("a resolution is a number of base pairs, 1 at least")
    at = lambda s: floor_div(Interval.named(suffix=s).center(), resolution)
    # Asked of the contacts' own columns: a condition on bins would be computed from them over and over below the scan.
    placed = contacts.dropna(subset=[f"{n}_{s}" for s in "AB" for n in ("chromosome", "start", "end")])
    rows = placed.select(F.col("chromosome_A").alias("a"), F.col("chromosome_B").alias("b"), at("_A").alias("i"), at("_B").alias("j"), F.col(value).alias("value"))
    if within:
        rows = rows.filter("a = b").select(F.col("a").alias("chromosome_x"), F.col("a").alias("chromosome_y"), F.least("i", "j").alias("x_bin"), F.greatest("i", "j").alias("y_bin"), "value")
    else:
        rows = rows.withColumn("turn", (F.col("b") < F.col("a")) | ((F.col("b") == F.col("a")) & (F.col("j") < F.col("i"))))
        either = lambda x, y: F.when(F.col("turn"), F.col(y)).otherwise(F.col(x))
        rows = rows.select(either("a", "b").alias("chromosome_x"), either("b", "a").alias("chromosome_y"), either("i", "j").alias("x_bin"), either("j", "i").alias("y_bin"), "value")
    rows = rows.groupBy(*CELL).agg(F.sum("value").alias("value"))
    return rows.filter("value <> 0")


def extents(matrix: DataFrame) -> DataFrame:
    """(chromosome, n_bins): bins up to the last one with a contact, for chromosomes whose own length is not known."""
    ends = F.explode(F.array(F.struct(F.col("chromosome_x").alias("c"), F.col("x_bin").alias("b")), F.struct(F.col("chromosome_y").alias("c"), F.col("y_bin").alias("b")))).alias("e")
    return matrix.select(ends).groupBy(F.col("e.c").alias("chromosome")).agg((F.max("e.b") + 1).alias("n_bins"))


def _inside(matrix: DataFrame) -> DataFrame:
    """(chromosome, x_bin, y_bin, value) of positive cells inside a chromosome."""
    return matrix.filter((F.col("chromosome_x") == F.col("chromosome_y")) & (F.col("value") > 0)).select(F.col("chromosome_x").alias("chromosome"), "x_bin", "y_bin", F.col("value").cast("double").alias("value"))


def _mirrored(matrix: DataFrame) -> DataFrame:
    """(chromosome, bin, other, value): each cell from both of its bins; one on the diagonal once. Cells of a bin are
    written together, so that sums over a bin are nearly done before their shuffle."""
    own, turned = (F.struct(F.col(a).alias("bin"), F.col(b).alias("other")) for a, b in (("x_bin", "y_bin"), ("y_bin", "x_bin")))
    sides = F.when(F.col("x_bin") == F.col("y_bin"), F.array(own)).otherwise(F.array(own, turned))
    return cut(_inside(matrix).select("chromosome", F.explode(sides).alias("s"), "value").select("chromosome", "s.*", "value").repartition("chromosome", "bin"))


def _row_sums(both: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    """(chromosome, bin, w, s): the sum of each row of the matrix whose cells are multiplied by both bins' weights."""
    other = weights.select("chromosome", F.col("bin").alias("other"), F.col("w").alias("other_w"))
    met = both.join(F.broadcast(other) if small else other, ["chromosome", "other"])
    sums = met.groupBy("chromosome", "bin").agg(F.sum(F.col("value") * F.col("other_w")).alias("s"))
    return sums.join(weights, ["chromosome", "bin"]).select("chromosome", "bin", "w", (F.col("s") * F.col("w")).alias("s"))


def balance(matrix: DataFrame, method: str = "BALANCED", rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(chromosome, bin, weight): factors for cells inside a chromosome, one for each bin that has a contact.

    A cell is normalised by the weights of both of its bins. VC takes 1 / (sum of the row), VC_SQRT one over the root of
    it; BALANCED goes on from 1 until all rows have the same sum: in each round a weight is divided by the root of its
    row's sum over the mean of the chromosome's rows. It ends after ``rounds`` if given, else when all sums are within
    ``tolerance`` of their mean (relative), or after MOST_ROUNDS; a matrix with no balanced form (a bin whose only
    neighbour has others) then has what was reached. All weights are scaled so that the chromosome's total stays as it
    was. Cells that are not positive take no part. An empty matrix has no weights.

    Cells are read once a round, where they lie; only weights move, to all executors or, beyond SENT_BINS, by a shuffle.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}; known are {', '.join(METHODS)}")
    both = _mirrored(matrix)
    raw = cut(both.groupBy("chromosome", "bin").agg(F.sum("value").alias("r")))
    start = {"VC": 1 / F.col("r"), "VC_SQRT": 1 / F.sqrt("r")}.get(method, F.lit(1.0))
    weights, total = raw.select("chromosome", "bin", start.alias("w")), raw.groupBy("chromosome").agg(F.sum("r").alias("total"))
    small = raw.count() <= SENT_BINS

    def step(weights: DataFrame) -> DataFrame:
        sums = _row_sums(both, weights, small)
        facts = sums.groupBy("chromosome").agg(F.avg("s").alias("mean"), F.sum("s").alias("sum"))
        return cut(sums.join(facts, "chromosome"))

    left = {"BALANCED": MOST_ROUNDS if rounds is None else rounds}.get(method, 0)
    while method != "NONE":
        done = step(weights)
        off = None if rounds is not None else done.agg(F.max(F.abs(F.col("s") / F.col("mean") - 1))).first()[0]
        if left == 0 or (rounds is None and (off or 0.0) <= tolerance):
            weights = done.join(total, "chromosome").select("chromosome", "bin", (F.col("w") * F.sqrt(F.col("total") / F.col("sum"))).alias("w"))
            break
        weights, left = done.select("chromosome", "bin", (F.col("w") / F.sqrt(F.col("s") / F.col("mean"))).alias("w")), left - 1
    return weights.withColumnRenamed("w", "weight")


def all_bins(weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chromosome, bin, weight) for every bin of the chromosomes in ``sizes``; null for a bin without contacts."""
    bins = sizes.filter("n_bins > 0").select("chromosome", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"))
    return bins.join(weights, ["chromosome", "bin"], "left")


def normalise(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """The cells inside a chromosome times the weights of both bins; null where a bin has none."""
    cells_ = matrix.filter(F.col("chromosome_x") == F.col("chromosome_y"))
    for side in "xy":
        other = weights.select(F.col("chromosome").alias("chromosome_x"), F.col("bin").alias(f"{side}_bin"), F.col("weight").alias(f"_{side}"))
        cells_ = cells_.join(other, ["chromosome_x", f"{side}_bin"], "left")
    return cells_.select(*CELL, (F.col("value") * F.col("_x") * F.col("_y")).alias("value"))


def expected(matrix: DataFrame, sizes: DataFrame | None = None, by: str = "genome") -> DataFrame:
    """(chromosome, distance, total, places, expected): the mean value of cells so many bins off the diagonal.

    All places at a distance count, empty ones too: a chromosome of n bins has n - distance of them. ``by``: one mean for
    all chromosomes together (``chromosome`` is null), or one for each. ``sizes`` (chromosome, n_bins) says how long
    chromosomes are; a cell beyond its chromosome's end is left out. Without it they end with their last contact.
    """
    if by not in ("genome", "chromosome"):
        raise ValueError(f"expected values are by genome or by chromosome, not by {by}")
    if sizes is None:
        sizes = extents(matrix)
    cells_ = matrix.filter(F.col("chromosome_x") == F.col("chromosome_y")).join(sizes.withColumnRenamed("chromosome", "chromosome_x"), "chromosome_x").filter(F.col("y_bin") < F.col("n_bins"))
    distance = (F.col("y_bin") - F.col("x_bin")).alias("distance")
    if by == "chromosome":
        sums = cells_.groupBy(F.col("chromosome_x").alias("chromosome"), distance).agg(F.sum("value").cast("double").alias("total"), F.max("n_bins").alias("n_bins"))
        sums = sums.select("chromosome", "distance", "total", (F.col("n_bins") - F.col("distance")).alias("places"))
    else:
        # One number for each chromosome, however many cells there are.
        lengths = sizes.agg(F.collect_list("n_bins")).scalar()
        places = F.aggregate(F.filter("lengths", lambda n: n > F.col("distance")), F.lit(0).cast("long"), lambda a, n: a + n - F.col("distance"))
        sums = cells_.groupBy(distance).agg(F.sum("value").cast("double").alias("total")).withColumn("lengths", lengths)
        sums = sums.select(F.lit(None).cast("string").alias("chromosome"), "distance", "total", places.alias("places"))
    return sums.withColumn("expected", F.col("total") / F.col("places"))


def observed_over_expected(matrix: DataFrame, sizes: DataFrame | None = None, by: str = "genome") -> DataFrame:
    """The cells inside a chromosome with ``expected`` and ``ratio``, the value over it; null where nothing is expected."""
    facts = expected(matrix, sizes, by)
    keys = ["distance"] if by == "genome" else ["chromosome_x", "distance"]
    facts = facts.select(F.col("chromosome").alias("chromosome_x"), "distance", "expected").select(*keys, "expected")
    cells_ = matrix.filter(F.col("chromosome_x") == F.col("chromosome_y")).withColumn("distance", F.col("y_bin") - F.col("x_bin"))
    return cells_.join(facts, keys, "left").select(*CELL, "value", "expected", F.try_divide(F.col("value"), F.col("expected")).alias("ratio"))


def write_pyramid(contacts: DataFrame, path: str, resolutions: Sequence[int], value: str = "petcount", tile_bins: int = TILE_BINS, within: bool = False, mode: str = "error") -> None:
    """Store the matrix at several resolutions, in one pass over the contacts; each must be a multiple of the finest.

    Contacts are summed at the finest one; those cells give the coarser ones together, in one aggregation. Below
    ``path``/cells there is a folder for each resolution, chromosome of x and tile of x, whose files are sorted by
    (chromosome_y, y_bin), so that a reader of a region opens few files and reads few row groups of them. The list of
    resolutions is in ``path``/levels.
    """
    levels = sorted(set(resolutions))
    if not levels or levels[0] < 1 or any(r % levels[0] for r in levels):
        raise ValueError("resolutions must be positive multiples of the finest one")
    finest = cells(contacts, levels[0], value, within)
    factors = F.explode(F.array(*(F.lit(r // levels[0]) for r in levels))).alias("factor")
    rows = finest.select(*CELL, "value", factors)
    rows = rows.groupBy((F.col("factor") * levels[0]).alias("resolution"), "chromosome_x", "chromosome_y", floor_div(F.col("x_bin"), F.col("factor")).alias("x_bin"), floor_div(F.col("y_bin"), F.col("factor")).alias("y_bin")).agg(F.sum("value").cast("double").alias("value"))
    placed = rows.withColumn("tile", floor_div(F.col("x_bin"), tile_bins))
    folders = ["resolution", "chromosome_x", "tile"]
    sorted_ = placed.repartition(*folders).sortWithinPartitions(*folders, "chromosome_y", "y_bin", "x_bin")
    sorted_.write.mode(mode).option("parquet.block.size", 4 << 20).partitionBy(*folders).parquet(f"{path}/cells")
    facts = contacts.sparkSession.createDataFrame([(r, tile_bins) for r in levels], "resolution int, tile_bins int")
    facts.coalesce(1).write.mode(mode).parquet(f"{path}/levels")


def resolutions(spark: SparkSession, path: str) -> list[int]:
    """The resolutions of a stored matrix, finest first."""
    return sorted(r["resolution"] for r in spark.read.parquet(f"{path}/levels").collect())


def _level(spark: SparkSession, path: str, resolution: int | None) -> tuple[int, int]:
    """(resolution, bins of a tile) of the asked level, or of the finest."""
    levels = {r["resolution"]: r["tile_bins"] for r in spark.read.parquet(f"{path}/levels").collect()}
    chosen = min(levels) if resolution is None else resolution
    if chosen not in levels:
        raise ValueError(f"no such resolution: {chosen}; stored are {sorted(levels)}")
    return chosen, levels[chosen]


def _stored(spark: SparkSession, path: str) -> DataFrame:
    kinds = "chromosome_y string, x_bin long, y_bin long, value double, resolution int, chromosome_x string, tile long"
    return spark.read.schema(kinds).parquet(f"{path}/cells")


def region(spark: SparkSession, path: str, x: tuple[str, int, int | None], y: tuple[str, int, int | None] | None = None, resolution: int | None = None) -> DataFrame:
    """(x_bin, y_bin, value): the cells of a stored matrix that a window meets, both triangles.

    ``x`` and ``y`` are (chromosome, first, last), both positions included; with None for the last a window goes to
    the chromosome's end. Without ``y`` the window is square. Without a ``resolution`` the finest is read. Conditions on
    folders choose the files, those on bins the row groups.
    """
    chosen, tile_bins = _level(spark, path, resolution)
    y = x if y is None else y
    stored = _stored(spark, path)

    def window(a: tuple[str, int, int | None], b: tuple[str, int, int | None]) -> DataFrame:
        (low, high), (first, last) = ((p[1] // chosen, (END if p[2] is None else p[2]) // chosen) for p in (a, b))
        found = stored.filter((F.col("resolution") == chosen) & (F.col("chromosome_x") == a[0]) & F.col("tile").between(low // tile_bins, high // tile_bins))
        return found.filter((F.col("chromosome_y") == b[0]) & F.col("x_bin").between(low, high) & F.col("y_bin").between(first, last))

    straight = window(x, y).select("x_bin", "y_bin", "value")
    turned = window(y, x)
    if x[0] == y[0]:
        turned = turned.filter("x_bin <> y_bin")
    return straight.unionByName(turned.select(F.col("y_bin").alias("x_bin"), F.col("x_bin").alias("y_bin"), "value"))


def regions(spark: SparkSession, path: str, windows: DataFrame, resolution: int | None = None) -> DataFrame:
    """(id, x_bin, y_bin, value): the square windows (id, chromosome, start, end) of a stored matrix, all in one job.

    The upper triangle of each: what the window of a stripe or a domain holds. A window meets the cells of square blocks
    that are as wide as itself, rounded up to a power of two, of which it touches three at most; so what is compared grows
    with the windows' areas, not with their number times a tile. Null ends give nothing.
    """
    chosen, _ = _level(spark, path, resolution)
    low, high = floor_div(F.col("start"), chosen), floor_div(F.col("end"), chosen)
    asked = windows.filter("chromosome is not null and `end` >= start").select("id", F.col("chromosome").alias("chromosome_x"), low.alias("low"), high.alias("high"))
    asked = asked.withColumn("level", F.ceil(F.log2(F.col("high") - F.col("low") + 1)).cast("int"))
    block = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    levels = asked.agg(F.sort_array(F.collect_set("level"))).scalar()
    for side in "xy":
        asked = asked.withColumn(f"{side}_block", F.explode(F.sequence(block("low"), block("high"))))
    stored = _stored(spark, path).filter((F.col("resolution") == chosen) & (F.col("chromosome_x") == F.col("chromosome_y"))).withColumn("level", F.explode(levels))
    met = stored.withColumns({f"{s}_block": block(f"{s}_bin") for s in "xy"}).join(asked.filter("x_block <= y_block"), ["chromosome_x", "level", "x_block", "y_block"])
    return met.filter(F.col("x_bin").between(F.col("low"), F.col("high")) & F.col("y_bin").between(F.col("low"), F.col("high"))).select("id", "x_bin", "y_bin", "value")
