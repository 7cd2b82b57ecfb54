"""From documents to token ids: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of ``documents``; others are left behind, and may have any names. Ids may
be null or repeated: a row is judged by its own text, and is lost only where a stage's rule names it. Null, empty and
very long texts, repeated rows and an empty table are allowed throughout; each stage says what becomes of them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftspan.functions.lineage import scope, shared_folder
from weftspan.llm import bpe, jaccard, mixing, substring, toxicity
from weftspan.llm.common import WORD

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; a null, empty or wordless text stays, whatever it would score.

    Equal texts go or stay together. Without labels all others have one score, so all of them stay."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    scored = toxicity.score(docs, toxicity.train(read("documents"), read("labels")), out="toxicity_score")
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return scored.filter((F.col("toxicity_score") < 0.5) | wordless).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity 0.8 or more, linked through others too) the row that
    comes first by (doc_id, text); rows without an id stay. Texts without words are copies of each other.

    The links are those of operator 3 with five words, verified, and what its bit budget does not reach (see ``jaccard``).
    """
    rows = docs.filter("doc_id is not null").withColumn("id", jaccard.identity())
    classes = jaccard.near_copies(rows)
    groups = rows.join(classes, "id", "left").groupBy(F.coalesce("component", "id").alias("component"))
    kept = groups.agg(F.min(F.struct(*COLUMNS)).alias("first")).select("first.*")
    return kept.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that also start earlier; others keep their text as it is.

    A document whose words all repeat stays, with an empty text; null texts stay null, rows without an id as they are."""
    found = substring.remove_repeats(docs, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, at least once and at most twice and a part.

    Rows that agree in id, source and words are told apart by text; rows without an id, and texts without words, are
    used once. A null source is a source of its own.
    """
    known = docs.filter("doc_id is not null").withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    alike = Window.partitionBy("doc_id", "source", "n_tokens").orderBy("text", "lang", "n_chars")
    known = known.withColumn("copy", F.row_number().over(alike))
    keys = ["doc_id", "source", "n_tokens", "copy"]
    uses = mixing.mix(docs.filter("doc_id is not null"), repetition=2.0).groupBy(*keys).agg(F.count("*").alias("uses"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    used = known.alias("d").join(uses.alias("u"), same).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    return used.select(*(f"d.{c}" for c in COLUMNS)).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, a row for each row; null and empty texts have none."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("temperature_mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: The classifier of the first stage has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again.

    A stage's input, and all that the stage has cut, is removed once its result is written, so the result of the last
    stage is all that stays there.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
