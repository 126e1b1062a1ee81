"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import embedding_dedup, exact_dedup, html_extract, language_id, mixing, sentencepiece_codec, setsketch_dedup, substring_dedup, token_output, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    ordered = mixed.repartitionByRange(F.try_element_at("positions", F.lit(1)), "doc_id").sortWithinPartitions(F.try_element_at("positions", F.lit(1)), "doc_id")
    first = F.floor(F.try_element_at("positions", F.lit(1)) * 1e9).cast("long")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight,
         source_size * 3 AS cap FROM s),
l AS (
  SELECT *, cap::DOUBLE / weight AS ratio, sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM r),
c AS (
  SELECT *, max(CASE WHEN (budget - before)::DOUBLE / rest::DOUBLE <= ratio THEN (budget - before)::DOUBLE / rest::DOUBLE END) OVER () AS common FROM l),
t AS (SELECT source, weight, source_size, least(coalesce(common, 0) * weight::DOUBLE, cap::DOUBLE) AS target FROM c),
p AS (
  SELECT d.doc_id, d.size, t.weight, t.source_size, t.target,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::DOUBLE - d.size / 2.0 AS middle
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, (middle < target)::BIGINT + (middle + source_size < target)::BIGINT + (middle + 2 * source_size < target)::BIGINT AS wanted,
         CASE WHEN target > 0 THEN least(middle / target, 1e0) ELSE 0e0 END AS share FROM p),
k AS (SELECT *, CASE WHEN source_size = 0 THEN 1 WHEN size = 0 THEN least(wanted, 1) ELSE wanted END::INT AS copies FROM n),
-- weight 5 falls from 1.5 over 1.0 to 0.5, weight 2 stays, weight 1 rises from 0.5 over 1.0 to 1.5
q AS (
  SELECT *, CASE WHEN weight = 5 AND share < 0.625e0 OR weight = 1 AND share < 0.375e0 OR weight = 2 THEN 0e0 ELSE 0.5e0 END AS t0,
         greatest(share - CASE WHEN weight = 5 AND share >= 0.625e0 THEN 0.625e0 WHEN weight = 1 AND share >= 0.375e0 THEN 0.375e0 ELSE 0e0 END, 0e0) AS rest,
         CASE WHEN weight = 5 AND share < 0.625e0 THEN 1.5e0 WHEN weight = 1 AND share < 0.375e0 THEN 0.5e0 ELSE 1e0 END AS w0,
         CASE weight WHEN 5 THEN -1e0 WHEN 2 THEN 0e0 ELSE 1e0 END AS slope FROM k)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN floor((t0 + least(CASE WHEN rest = 0 THEN 0e0 ELSE 2e0 * rest / (w0 + sqrt(greatest(w0 * w0 + 2e0 * slope * rest, 0e0))) END, CASE weight WHEN 2 THEN 1e0 ELSE 0.5e0 END)) * 1e9) END::BIGINT AS first_position
FROM q
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).drop("url")


OP3_SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokenised(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.duplicate_spans(_table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", (language_id.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_token_output": op4_token_output,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash": op8_minhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
}

SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op3_warc": OP3_SQL, "op9_exact_dedup": OP9_SQL}
