"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source with share p of all tokens gets weight p**t / sum(p**t). The exponent t is bisected: the largest that reaches
a target entropy, or the smallest that keeps the repetition of every source within a limit, or both. The weights are
then realised as whole and partial passes: each pass over a source is a block of its documents in an order of its own,
and the last block ends when the source's token budget is spent.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.llm.common import WORD, cut, each_copy

#: Steps of the bisection; the exponent is then good to 2**-STEPS. Of those for the entropy, WAYS are one Spark job.
STEPS, WAYS = 40, 5
#: Rows that a hash range of a block's running total should have at most.
RANGE_ROWS = 1 << 16


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, n): words of each source; sources without words have no share and are left out."""
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).filter("n > 0")


def temperature(totals: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent in [0, 1]: the largest with at least the target entropy (as a part of the most possible),
    lowered no further than the repetition limit allows. With exponent 1 the weights are the shares themselves."""
    facts = totals.agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.min("n").alias("low"), F.count("*").alias("k")).first()
    if not facts["all"] or facts["k"] < 2:
        return 1.0
    share = F.col("n") / F.lit(float(facts["all"]))

    def entropies(steps: list[float]) -> list[float]:
        """Entropy in nats at each exponent; one job for all of them."""
        sums = [x for t in steps for x in (F.sum(F.pow(share, F.lit(t))), F.sum(F.pow(share, F.lit(t)) * F.log(share) * t))]
        s = totals.agg(*(x.alias(str(i)) for i, x in enumerate(sums))).first()
        return [math.log(s[i]) - s[i + 1] / s[i] for i in range(0, len(sums), 2)]

    t = 0.0
    if entropy is not None:
        goal, low, high = entropy * math.log(facts["k"]), 0.0, 1.0
        if entropies([1.0])[0] >= goal:
            low = 1.0
        for _ in range(STEPS // WAYS if low < 1 else 0):  # the interval is cut in 2**WAYS parts at a time
            steps = [low + (high - low) * i / 2**WAYS for i in range(1, 2**WAYS)]
            reached = sum(e >= goal for e in entropies(steps))
            low, high = ([low, *steps][reached], [*steps, high][reached])
        t = low
    if repetition is not None:
        spread, low, high = math.log(facts["top"] / facts["low"]), 0.0, 1.0
        if spread > math.log(repetition):
            for _ in range(STEPS):
                mid = (low + high) / 2
                low, high = (mid, high) if (1 - mid) * spread > math.log(repetition) else (low, mid)
            t = max(t, high)
    return t


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = 4.0, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None) -> DataFrame:
    """(key, source, n_tokens, block, range, permuted, copy): the documents of the mix, a row for each time they are used.

    Tokens are counted as words. Without a ``budget`` (of tokens, for all sources) it is such that the source which is
    repeated least is used exactly once, so no document is left out; a source that is to be used r times gives floor(r) whole blocks and then documents of one
    more block, in that block's order, as long as those before them have not spent the rest of its tokens. ``block``
    numbers the passes from 0, and (range, permuted) orders a block. A null source is a source of its own. Documents
    without words (null, empty) are used once, in block 0. Repeated keys are further rows of their source; ``copy``
    numbers rows that agree in key and words. Of a text only its number of words travels, however long it is. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = rows.groupBy("k", "source", "n_tokens").agg(F.count("*").alias("copies"))
    rows = cut(each_copy(rows).withColumn("copy", F.col("copy").cast("int")))
    totals = cut(source_totals(rows))
    count, digits = rows.count(), 2
    while count > RANGE_ROWS * 16**digits:
        digits += 1
    t = round(temperature(totals, entropy, repetition), 6)
    # Weight over share is n**(t-1) up to a factor; the largest source is repeated least.
    top = totals.agg(F.max("n")).first()[0] or 1
    uses = F.pow(F.lit(float(top)) / F.col("n"), F.lit(1 - t))
    if budget is not None:
        uses = uses * (budget / (totals.agg(F.sum(F.col("n") * uses)).first()[0] or 1.0))
    uses = totals.select("source", F.round(uses, 6).alias("uses"), "n")
    uses = uses.select(F.col("source").alias("u_source"), F.floor("uses").alias("whole"), F.floor(F.col("n") * (F.col("uses") - F.floor("uses"))).alias("rest"))
    known = rows.join(F.broadcast(uses) if totals.count() <= 10_000 else uses, F.col("source").eqNullSafe(F.col("u_source")), "left").select(*rows.columns, F.coalesce("whole", F.lit(1)).alias("whole"), F.coalesce("rest", F.lit(0)).alias("rest"))
    whole = known.filter("n_tokens = 0 or whole > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.when(F.col("n_tokens") > 0, F.col("whole").cast("int") - 1).otherwise(0))))
    part = known.filter("rest > 0").withColumn("block", F.col("whole").cast("int"))

    def ordered(df: DataFrame) -> DataFrame:
        digest = F.md5(F.concat_ws("/", F.lit(seed), "block", F.col("k").cast("string"), "copy", "n_tokens").cast("binary"))
        return df.withColumn("permuted", digest).withColumn("range", F.conv(F.substring("permuted", 1, digits), 16, 10).cast("long"))

    # The running total of the partial block: totals of hash ranges first, so that no task has a whole source.
    part = ordered(part)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("source", "range").agg(F.sum("n_tokens").alias("s")).select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("spent"))
    within = Window.partitionBy("source", "range").orderBy("permuted", "k", "copy").rowsBetween(Window.unboundedPreceding, -1)
    here = part.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    part = here.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
    part = part.filter((F.col("spent") + F.col("inner") < F.col("rest")) & (F.col("n_tokens") > 0))
    cols = ["k", "source", "n_tokens", "block", "range", "permuted", "copy"]
    return ordered(whole).select(*cols).unionByName(part.select(*cols)).withColumnRenamed("k", key).withColumnRenamed("source", source)
