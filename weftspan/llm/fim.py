"""Fill-in-middle: texts cut into prefix, middle and suffix at unit bounds, and put together in another order.

The cuts are made with string functions alone, by injected markers. A delimiter that stands in a text is escaped first;
then ``regexp_replace`` puts the delimiter after each unit, so counting it counts the units, and ``substring_index``
takes the units before, between and after two ranks. The pieces lose their delimiters and are unescaped.

Where a text is cut, and whether at all, follows from the seed and its key; nothing is drawn at run time, so a lost task
gives the same rows again. Each row is worked on by itself: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or white space at the end of the text. Used on escaped texts, too: neither the
#: delimiter nor what escapes it is white space.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
DELIMITER, ESCAPE = "\x01", "\x02"
#: Before prefix, suffix and middle. A text that has one of them stays as it is, as it could not be taken apart again.
MARKS = ("<P>", "<S>", "<M>")


def marked(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))
    return F.regexp_replace(escaped, UNIT, "$0" + DELIMITER)


def units(text: Column) -> Column:
    """How many units a marked text has."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(DELIMITER), F.lit("")))).cast("long")


def plain(piece: Column) -> Column:
    """A piece of a marked text as it was before."""
    bare = F.replace(piece, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _take(text: Column, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(DELIMITER), count.cast("int"))


def has_mark(text: Column) -> Column:
    found = F.lit(False)
    for m in MARKS:
        found = found | F.contains(text, F.lit(m))
    return found


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A mark stands in it once: texts that have one are left plain."""
    p, s, m = MARKS
    after, before = (lambda t, mark: F.substring_index(t, mark, -1)), (lambda t, mark: F.substring_index(t, mark, 1))
    middle = after(output, m)
    psm = F.concat(before(after(output, p), s), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, restored): one row for each row of ``docs``.

    n counts the units of the text. Of 100 texts some ``rate`` are cut, of 100 cut ones some ``spm`` have the form spm
    (suffix first), the others psm; the rest are ``plain``, and so are empty texts and those with a mark in them; their
    two lengths (code points) are null. Digits of sha256(seed:key) decide on the form and on both cuts, so repeated keys
    with equal texts have equal rows. A null text counts as empty, a null key as the empty string; very long texts are
    cut whole, and the delimiter and the character that escapes it may stand in a text. Both cuts may fall on one place,
    or on an end, which leaves pieces empty. An empty table gives no rows; other columns may have any names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("k", "t", marked(F.col("t")).alias("u"), digest.alias("d"))
    number = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long")
    rows = rows.select("k", "t", "u", units(F.col("u")).alias("n"), *(number(i).alias(f"h{i + 1}") for i in range(4)))
    at = lambda h: F.col(h) % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | (F.col("h3") % 100 >= rate) | has_mark(F.col("t")), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("k", "t", "u", "n", F.least(at("h1"), at("h2")).alias("lo"), F.greatest(at("h1"), at("h2")).alias("hi"), form.alias("form"))
    # From the right, substring_index counts the delimiter after the last unit, too.
    prefix, suffix = _take(F.col("u"), F.col("lo")), _take(F.col("u"), F.col("hi") - F.col("n") - 1)
    middle = _take(_take(F.col("u"), F.col("hi")), F.col("lo") - F.col("hi"))
    cut = F.col("form") != "plain"
    rows = rows.select("k", "t", "n", "form", *(F.when(cut, plain(x)).alias(name) for x, name in ((prefix, "p"), (middle, "m"), (suffix, "s"))))
    p, s, m = (F.lit(x) for x in MARKS)
    psm, spm_ = F.concat(p, "p", s, "s", m, "m"), F.concat(s, "s", p, "p", m, "m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("t"))
    rows = rows.select("k", "n", "form", F.char_length("p").cast("long").alias("prefix_chars"), F.char_length("m").cast("long").alias("middle_chars"), output.alias("output"))
    return rows.withColumn("restored", restore(F.col("output"), F.col("form"))).withColumnRenamed("k", key)
