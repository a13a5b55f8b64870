"""Tables of the domain made from the test tables, in Spark and in SQL. Every row of a table takes part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions.text import with_derived_confidence
from inkgauge.storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script_id, ref, hyp, confidence: short descriptions and five kinds of misreading."""
    part = table(spark, sf_dir, "part")
    ref = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    kind = F.col("p_partkey") % 5
    rows = part.select(F.col("p_partkey").alias("script_id"), ref.alias("ref"), kind.alias("kind"), (((F.col("p_partkey") * 37) % 101) / 100.0).alias("confidence"))
    hyp = (F.when(F.col("kind") == 0, F.col("ref")).when(F.col("kind") == 1, F.upper("ref")).when(F.col("kind") == 2, F.translate("ref", "aeo", "eoa"))
           .when(F.col("kind") == 3, F.replace(F.col("ref"), F.lit("e"), F.lit("c "))).otherwise(F.substring("ref", 4, 1000)))
    return rows.withColumn("hyp", hyp).drop("kind")


PAIRS_SQL = """
pairs AS (
  SELECT script_id, ref, confidence, CASE kind WHEN 0 THEN ref WHEN 1 THEN upper(ref) WHEN 2 THEN translate(ref, 'aeo', 'eoa')
    WHEN 3 THEN replace(ref, 'e', 'c ') ELSE substring(ref, 4, 1000) END AS hyp
  FROM (SELECT p_partkey AS script_id, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS ref, p_partkey % 5 AS kind,
    ((p_partkey * 37) % 101) / 100.0::DOUBLE AS confidence FROM part)),
tokens AS (
  SELECT *, list_filter(regexp_split_to_array(hyp, '\\s+'), lambda t: t <> '') AS rh, list_filter(regexp_split_to_array(ref, '\\s+'), lambda t: t <> '') AS rr,
    trim(regexp_replace(lower(hyp), '\\s+', ' ', 'g')) AS ch, trim(regexp_replace(lower(ref), '\\s+', ' ', 'g')) AS cr,
    list_filter(regexp_split_to_array(regexp_replace(lower(hyp), '[^\\w\\s]', '', 'g'), '\\s+'), lambda t: t <> '') AS nh,
    list_filter(regexp_split_to_array(regexp_replace(lower(ref), '[^\\w\\s]', '', 'g'), '\\s+'), lambda t: t <> '') AS nr
  FROM pairs),
coded AS (
  SELECT *, list_distinct(list_concat(rh, rr)) AS rk, list_distinct(list_concat(nh, nr)) AS nk FROM tokens),
rates AS (
  SELECT script_id, hyp, ref, confidence,
    CASE WHEN length(ref) = 0 THEN CASE WHEN length(hyp) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(hyp, ref) / length(ref) END AS raw_cer,
    CASE WHEN length(cr) = 0 THEN CASE WHEN length(ch) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(ch, cr) / length(cr) END AS normalized_cer,
    CASE WHEN len(rr) = 0 THEN CASE WHEN len(rh) = 0 THEN 0.0 ELSE 1.0 END ELSE
      levenshtein(array_to_string(list_transform(rh, lambda t: chr(64 + list_position(rk, t))), ''), array_to_string(list_transform(rr, lambda t: chr(64 + list_position(rk, t))), '')) / len(rr) END AS raw_wer,
    CASE WHEN len(nr) = 0 THEN CASE WHEN len(nh) = 0 THEN 0.0 ELSE 1.0 END ELSE
      levenshtein(array_to_string(list_transform(nh, lambda t: chr(64 + list_position(nk, t))), ''), array_to_string(list_transform(nr, lambda t: chr(64 + list_position(nk, t))), '')) / len(nr) END AS normalized_wer
  FROM coded),
samples AS (
  SELECT *, normalized_cer <= 0.05 OR normalized_wer <= 0.15 AS is_acceptable FROM rates)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """confidence, is_acceptable, cer, wer (unrounded) of the pairs."""
    from inkgauge.operators.metrics import benchmark_rows

    rows = pairs(spark, sf_dir).select("script_id", F.col("hyp").alias("raw_ocr_text"), F.col("ref").alias("ground_truth_text"), "confidence")
    return benchmark_rows(rows, digits=None).select("script_id", "confidence", "is_acceptable", F.col("normalized_cer").alias("cer"), F.col("normalized_wer").alias("wer"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, confidence derived from the whole text, is_acceptable = quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rows = with_derived_confidence(docs, digits=None).select("doc_id", "confidence", (F.col("quality") == 1).alias("is_acceptable"))
    # Written, so that filters on the confidence don't make it once more below the join.
    return written(rows)


def _estimate(source: str, key: str, text: str) -> str:
    """SQL common table expressions: est(key, score, n, best) over whole texts of ``source``."""
    from inkgauge.functions.text import VOCABULARY

    words = ", ".join(f"'{w}'" for w in VOCABULARY)
    return f"""
split AS (
  SELECT {key} AS key, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+'), lambda t: t <> '') AS toks FROM {source}),
shaped AS (
  SELECT key, toks, len(toks) AS n,
    list_filter(list_transform(toks, lambda t: lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))), lambda t: t <> '') AS clean,
    len(list_filter(toks, lambda t: regexp_matches(t, '[\\^~`|{{}}\\[\\]<>\\\\]'))) AS noise,
    length(array_to_string(toks, '')) / nullif(len(toks), 0) AS mean_length FROM split),
repeats AS (
  SELECT key, max(c) AS best FROM (SELECT key, t, count(*) AS c FROM (SELECT key, unnest(toks) AS t FROM split) GROUP BY key, t) GROUP BY key),
parts AS (
  SELECT shaped.key, n, len(clean) AS n_clean, noise, mean_length, best,
    len(list_filter(clean, lambda t: t IN ({words}) OR length(t) <= 2 OR regexp_matches(t, '(ing|ed|ly|s|tion)$'))) AS plausible
  FROM shaped LEFT JOIN repeats ON shaped.key = repeats.key),
est AS (
  SELECT key, n, best, CASE WHEN n > 0 THEN greatest(0.05::DOUBLE, least(0.99::DOUBLE, 0.99::DOUBLE
    - (1.0::DOUBLE - plausible / greatest(1, n_clean)) * 0.10::DOUBLE - noise / n * 0.50::DOUBLE - (1.0::DOUBLE - n_clean / n) * 0.15::DOUBLE
    - CASE WHEN mean_length > 15 OR mean_length < 2 THEN 0.2::DOUBLE ELSE 0.0 END - CASE WHEN n > 10 AND best / n > 0.35::DOUBLE THEN 0.3::DOUBLE ELSE 0.0 END)) END AS score
  FROM parts)
"""


DOCUMENT_ESTIMATE_SQL = _estimate("documents", "doc_id", "text")
TURN_ESTIMATE_SQL = _estimate("(SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, text FROM conversations)", "id", "text")
LABELLED_SQL = DOCUMENT_ESTIMATE_SQL + """,
samples AS (SELECT doc_id, score AS confidence, quality = 1 AS is_acceptable FROM est JOIN labels ON doc_id = key)
"""
