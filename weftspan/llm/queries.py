"""The registered queries of the text operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.llm import bpe, centroids, extract, fim, hamming, langid, media, mixing, multiset, sharding, simhash, substring, toxicity
from weftspan.llm.common import tables


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(tables(spark, sf_dir, "pages"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op5_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(tables(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(tables(spark, sf_dir, "documents"), texts=False).drop("kept")


def op7_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(tables(spark, sf_dir, "documents"), shards=16)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(tables(spark, sf_dir, "documents"))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(tables(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False).drop("ids", "decoded")


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir, "documents"), repetition=4.0, seed=7).drop("range")


def _sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset.edited_fingerprints(tables(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", _sha256("edited_text")).drop("edited_text")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(tables(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)
    return found.withColumns({"output_sha256": _sha256("output"), "restored_sha256": _sha256("restored")}).drop("output", "restored")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(tables(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1).drop("scans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_interleaved_media": op5_interleaved_media,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_two_pass_sharding": op7_two_pass_sharding,
    "op8_language_id": op8_language_id,
    "op9_byte_level_bpe": op9_byte_level_bpe,
    "op10_temperature_mixing": op10_temperature_mixing,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_centroid_clustering": op13_centroid_clustering,
}

OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words
), marked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) > 1 AS later FROM starts
), each_word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM marked WHERE later
), kept AS (
  SELECT e.doc_id, count(c.p) AS n_removed, coalesce(string_agg(CASE WHEN c.p IS NULL THEN e.word END, ' ' ORDER BY e.p), '') AS left_over
  FROM each_word e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.left_over, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

OP10_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), d AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, n_tokens) AS copy FROM counted
), tot AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM d GROUP BY source HAVING sum(n_tokens) > 0
), f AS (
  SELECT CAST(max(n) AS DOUBLE) AS top, CAST(min(n) AS DOUBLE) AS low, count(*) AS k FROM tot
), e AS (
  SELECT top, CASE WHEN k < 2 THEN 1.0 WHEN ln(top / low) <= ln(4.0) THEN 0.0 ELSE round(1 - ln(4.0) / ln(top / low), 6) END AS t FROM f
), u AS (
  SELECT source, n, round(pow(top / n, 1 - t), 6) AS uses FROM tot, e
), k AS (
  SELECT d.*, coalesce(CAST(floor(u.uses) AS BIGINT), 1) AS whole, coalesce(CAST(floor(u.n * (u.uses - floor(u.uses))) AS BIGINT), 0) AS rest
  FROM d LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source
), b AS (
  SELECT *, unnest(range(0, CASE WHEN n_tokens > 0 THEN whole + 1 ELSE 1 END)) AS block FROM k
), p AS (
  SELECT *, md5(concat_ws('/', '7', CAST(block AS VARCHAR), CAST(doc_id AS VARCHAR), CAST(copy AS VARCHAR), CAST(n_tokens AS VARCHAR))) AS permuted FROM b
), r AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY permuted, doc_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM p
)
SELECT doc_id, source, n_tokens, CAST(block AS INTEGER) AS block, permuted, CAST(copy AS INTEGER) AS copy FROM r
WHERE block < whole OR spent < rest
"""

OP2_SQL = """
WITH bits AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id,
    CAST(list_sum(list_transform(range(1, len(q.b) + 1), lambda i: abs(q.b[i] - r.b[i]))) AS INTEGER) AS distance
  FROM bits q JOIN bits r ON len(q.b) = len(r.b) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), c AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM d
), f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

_ROUND = """
, d{r} AS (
  SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN c{r} c ON v.i = c.i GROUP BY v.row, c.cluster
), a{r} AS (
  SELECT row, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS d FROM d{r} GROUP BY row
)"""
_MOVE = """
, s{r} AS (
  SELECT a.cluster, v.i, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN parts v ON a.row = v.row GROUP BY a.cluster, v.i
), c{next} AS (
  SELECT c.cluster, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x
  FROM c{r} c LEFT JOIN s{r} s ON c.cluster = s.cluster AND c.i = s.i
)"""
OP13_SQL = (
    """
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS row,
    list_transform(embedding, lambda x: CAST(floor(64 * greatest(-524288.0, least(524288.0, CAST(x AS DOUBLE)))) AS HUGEINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), parts AS (
  SELECT row, unnest(v) AS x, unnest(range(1, 65)) AS i FROM kept
), first AS (
  SELECT v, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster FROM kept
), c0 AS (
  SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM first WHERE cluster < 16
)"""
    + "".join(_ROUND.format(r=r) + _MOVE.format(r=r, next=r + 1) for r in range(3))
    + _ROUND.format(r=3)
    + """
, digests AS (
  SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster
)
SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, g.centroid_sha256
FROM kept k JOIN a3 a ON k.row = a.row JOIN digests g ON a.cluster = g.cluster
"""
)

ORACLES: dict[str, str] = {
    "op2_exact_top_k": OP2_SQL,
    "op10_temperature_mixing": OP10_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
