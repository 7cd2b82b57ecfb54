"""Document fingerprints that are sums: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph (a line) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors,
each component modulo 2**14. So the order of paragraphs does not matter, and a paragraph that is inserted or deleted is
one vector added or subtracted: nothing else of the text has to be read.

The vector of a paragraph is itself a sum, over the paragraph as a whole and its groups of three words: each of these
units has, for each of 240 components, a bit of its XXH64 hashes, 0 or 1; one more component counts the units. Taken as
-1 and 1, such vectors are nearly orthogonal, so the squared length of a fingerprint estimates the sum of squared counts
of the units, and that of a difference how much two texts do not share. Whole paragraphs alone would tell equality, but
for a text of one paragraph nothing about likeness.

Four components share a 64-bit integer, with one spare bit each that takes the carry and is cleared. All is DataFrame
functions on one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.functions.lineage import number_rows
from weftspan.llm.common import cut, each_copy

#: Bits of a component with its spare bit, components of an integer, integers of a hash (60 of its bits), hashes.
LANE, LANES, STEPS, HASHES = 15, 4, 15, 4
#: The lowest bit of each component, all its bits, its spare bit.
ONES = sum(1 << LANE * i for i in range(LANES))
LOW, SPARE = ONES * ((1 << LANE - 1) - 1), ONES << LANE - 1
HALF, MODULUS = 1 << LANE - 2, 1 << LANE - 1
#: A group of up to three words of one line, with the white space after them.
GROUP = r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,3}"


def hashes(text: Column) -> Column:
    """One 64-bit hash for each unit of the text: its lines, and the groups of words in them."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(F.lit("line"), x))
    groups = F.transform(F.regexp_extract_all(text, F.lit(GROUP), F.lit(0)), lambda x: F.xxhash64(F.lit("words"), x))
    return F.concat(lines, groups)


def _sum(h: Column, i: int) -> Column:
    """Four components: how many of the hashes have bit i, bit i + 15, bit i + 30 and bit i + 45."""
    return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a + F.shiftrightunsigned(x, i).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(LOW)))


def totals(columns: list[str]) -> Column:
    """The number of units, and the packed sums over each of the columns of their hashes."""
    count = F.array((F.size(columns[0]) % MODULUS).cast("long"))
    return F.concat(count, F.array(*(_sum(F.col(c), i) for c in columns for i in range(STEPS))))


def with_vector(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the vector of the column ``text``: the number of units, then integers of four components each."""
    names = [f"_h{j}" for j in range(HASHES)]
    rows = rows.withColumn("_h0", hashes(F.col(text)))
    again = lambda j: F.transform("_h0", lambda x: F.xxhash64(x, F.lit(j)))
    rows = rows.withColumns({names[j]: again(j) for j in range(1, HASHES)})
    return rows.withColumn(out, totals(names)).drop(*names)


def added(a: Column, b: Column) -> Column:
    """The vector of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(LOW)))


def removed(a: Column, b: Column) -> Column:
    """The vector of the paragraphs of ``a`` without those of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(F.lit(SPARE)) - y).bitwiseAND(F.lit(LOW)))


def fingerprint(vector: Column) -> Column:
    """A vector as text: 16 hexadecimal digits for each integer."""
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _lane(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, LANE * i).bitwiseAND(F.lit(MODULUS - 1))


def _squares(v: str) -> Column:
    """The sum of squares of a vector's components, with bits taken as -1 and 1; a component is the least of its class."""
    n = F.element_at(v, 1) - HALF
    signed = lambda x, i: (_lane(x, i) * 2 - n).bitwiseAND(F.lit(MODULUS - 1)) - HALF
    each = F.flatten(F.transform(F.slice(v, 2, STEPS * HASHES), lambda x: F.array(*(signed(x, i) for i in range(LANES)))))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, c: a + c * c)


def with_likeness(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``rows`` with how alike the vectors ``a`` and ``b`` are, from 0 to 1: 1 - |a - b|**2 / (|a|**2 + |b|**2).

    It estimates the units that both have among those of either (Dice's measure, by squared counts), with a standard
    error of some 0.06 to 0.09. Equal vectors give 1; those of texts that share nothing come out near 0.
    """
    rows = rows.withColumn("_d", removed(F.col(a), F.col(b)))
    rows = rows.withColumns({"_a2": _squares(a), "_b2": _squares(b), "_d2": _squares("_d")})
    both = F.col("_a2") + F.col("_b2")
    near = F.when(F.col(a) == F.col(b), 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_d2") / both))
    return rows.withColumn(out, near).drop("_d", "_a2", "_b2", "_d2")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vector, fingerprint): one row for each row of ``docs``, without a shuffle.

    A null text counts as empty, which is one empty paragraph; very long texts are read whole. Texts with the same
    paragraphs in another order, repeats included, have the same fingerprint. An empty table gives no rows; other
    columns may have any names.
    """
    rows = with_vector(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")), "t", "vector")
    return rows.select(F.col("k").alias(key), "vector", fingerprint(F.col("vector")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """(key, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next): one row for each of ``docs``.

    The edited text has its last n_chars // ``share`` code points replaced by the first as many (or all) of the next
    document; after the last comes the first. Its vector is that of the text, less the paragraphs that the edit touches,
    plus those that it makes; the others are not hashed again. near_edited and near_next compare the fingerprint with
    those of the edited text and of the next document.

    Documents are ordered by key, those that share it by a hash of key and text; a null key comes first. Rows that agree
    in key and text follow each other: they are counted, edited once as one that its own copy follows and once as the
    last of them, and dealt out at the end, so however many there are, they meet nowhere. Null texts count as empty,
    very long ones are whole in one row, an empty table gives no rows, and other columns may have any names.
    """
    code = F.coalesce(F.col("k").cast("string"), F.lit("?"))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("d", F.sha2(F.concat(code, F.lit(":"), F.col("t")).cast("binary"), 256))
    # Which document comes next, from ids and hashes alone.
    each = rows.groupBy("k", "d").agg(F.count("*").alias("copies"), F.max(F.char_length("t")).cast("long").alias("n"))
    each = cut(number_rows(each, ["k", "d"], "at"))
    count = each.count()
    before = each.select(((F.col("at") + 1) % F.lit(max(count, 1))).alias("at"), F.col("d").alias("asker"), F.floor(F.col("n") / share).alias("asked"))
    each = each.join(before, "at").select("d", "k", "copies", "n", "asker", "asked")
    # One row for each text and key; the next one's head and vector go to the row before it.
    own = with_vector(rows.select("d", "t"), "t", "v").groupBy("d").agg(F.first("t").alias("t"), F.first("v").alias("v"))
    own = own.join(each, "d")
    heads = own.select(F.col("asker").alias("d"), F.expr("left(t, cast(asked as int))").alias("head"), F.col("v").alias("next_v"))
    both = own.join(heads, "d").withColumn("tail", F.floor(F.col("n") / share).cast("int"))
    once = F.struct(F.col("head"), F.col("next_v"), F.lit(1).cast("long").alias("times"))
    again = F.struct(F.expr("left(t, tail)").alias("head"), F.col("v").alias("next_v"), (F.col("copies") - 1).alias("times"))
    both = both.withColumn("e", F.explode(F.when(F.col("copies") > 1, F.array(once, again)).otherwise(F.array(once))))
    both = both.select("k", "n", "t", "v", "tail", "e.*").withColumn("kept", F.expr("left(t, cast(n as int) - tail)"))
    # The line in which the edit begins, and all after it: as it was, and as it is now.
    both = both.withColumn("begun", F.substring_index("kept", "\n", -1))
    both = both.withColumn("old", F.expr("substring(t, char_length(kept) - char_length(begun) + 1)")).withColumn("new", F.concat("begun", "head"))
    both = with_vector(with_vector(both, "old", "old_v"), "new", "new_v")
    both = both.select("k", "n", "times", "v", "next_v", F.concat("kept", "head").alias("edited"), added(removed(F.col("v"), F.col("old_v")), F.col("new_v")).alias("edited_v"))
    both = with_likeness(with_likeness(both, "v", "edited_v", "near_edited"), "v", "next_v", "near_next")
    done = both.select(
        "k", F.col("n").alias("n_chars"), F.col("edited").alias("edited_text"), fingerprint(F.col("v")).alias("fingerprint"),
        fingerprint(F.col("edited_v")).alias("edited_fingerprint"), "near_edited", "near_next", "times",
    )
    return each_copy(done, "times").drop("copy").withColumnRenamed("k", key)
