"""Registered queries of readers and sinks: tables written to the shared folder and read again, and guards of calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge import catalogue as Q
from inkgauge import fixtures as X
from inkgauge.catalogue import query
from inkgauge.operators import calibration as C
from inkgauge.operators import metrics as M
from inkgauge.operators import routing as G
from inkgauge.operators import validation as V
from inkgauge.schemas import EVALUATION, THRESHOLD_ANALYSIS
from inkgauge.sources import backends as B
from inkgauge.sources import readers as S
from inkgauge.sources import writers as W
from inkgauge.storage import scratch


def _truth(rows: DataFrame) -> DataFrame:
    return rows.select("script_id", "image_path", F.sha2("ground_truth_text", 256).alias("digest"), "image_hash")


@query("SELECT conv_id || ':' || turn AS script_id, coalesce(role, '') AS image_path, sha256(coalesce(text, '')) AS digest, NULL::VARCHAR AS image_hash FROM conversations")
def truth_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "truth.jsonl")
    turns = X.table(spark, sf_dir, "conversations")
    turns.select(F.concat_ws(":", "conv_id", "turn").alias("script_id"), F.col("role").alias("image_path"), F.col("text").alias("ground_truth_text")).write.json(path)
    return _truth(S.ground_truth(spark, path))


@query("SELECT s_suppkey::VARCHAR AS script_id, '' AS image_path, sha256(s_name || chr(10) || '\"x\"') AS digest, 'h' AS image_hash FROM supplier")
def truth_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation that holds a list of objects."""
    path = scratch(spark, "truth.json")
    rows = X.table(spark, sf_dir, "supplier").select("s_nationkey", F.struct(F.col("s_suppkey").cast("string").alias("script_id"), F.concat("s_name", F.lit('\n"x"')).alias("ground_truth_text"), F.lit("h").alias("image_hash")).alias("r"))
    rows.groupBy("s_nationkey").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("s_nationkey").text(path)
    return _truth(S.ground_truth(spark, path))


@query("SELECT c_custkey::VARCHAR AS script_id, c_name || ',' AS image_path, sha256(c_mktsegment || ', \"' || c_nationkey || '\"' || chr(10) || 'end') AS digest, NULL::VARCHAR AS image_hash FROM customer")
def truth_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id and extracted_text_clean go before script_id and extracted_text; quotes, commas and line ends inside values."""
    path = scratch(spark, "truth.csv")
    text = F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"\nend'))
    rows = X.table(spark, sf_dir, "customer").select(
        F.lit("other").alias("script_id"), F.col("c_custkey").cast("string").alias("task_id"), F.concat("c_name", F.lit(",")).alias("image_path"), F.lit("raw").alias("extracted_text"), text.alias("extracted_text_clean"))
    W.table_csv(rows, path)
    return _truth(S.ground_truth(spark, path))


@query(f"""WITH {X.PAIRS_SQL} SELECT script_id::VARCHAR AS script_id, confidence, round(raw_cer, 4) AS raw_cer, round(normalized_cer, 4) AS normalized_cer, round(raw_wer, 4) AS raw_wer,
  round(normalized_wer, 4) AS normalized_wer, is_acceptable FROM samples""")
def benchmark_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at the default four digits through the benchmark CSV."""
    path = scratch(spark, "benchmark.csv")
    W.benchmark_csv(Q._benchmark(spark, sf_dir, 4), path)
    return S.benchmark_csv(spark, path).select("script_id", "confidence", "raw_cer", "normalized_cer", "raw_wer", "normalized_wer", "is_acceptable")


@query(Q._SQL["benchmark_summary"])
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "summary.json")
    summary = M.summarize(Q._benchmark(spark, sf_dir, 8))
    W.summary_json(summary, path, run="nightly")
    return spark.read.schema(f"metadata struct<run:string>, metrics struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in summary.schema)}>").json(path).where("metadata.run = 'nightly'").select("metrics.*")


@query(Q._SQL["routing_thresholds"])
def thresholds_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "thresholds.csv")
    W.table_csv(G.sweep(X.samples(spark, sf_dir), digits=(8, 8)), path)
    return spark.read.schema(THRESHOLD_ANALYSIS).option("header", True).csv(path)


@query("""SELECT s_suppkey::VARCHAR AS script_id, '/scans/' || s_suppkey || '.v2.png' AS image_path, 'mock' AS backend, 0.5::DOUBLE AS confidence, 'raw' AS confidence_type, 8 AS text_length,
  2 AS n_segments, 'One.' || chr(10) || 'Two' AS normalized_text, 0 AS n_errors FROM supplier""")
def records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a backend, one file each, named by their image's stem; read again and held against the required fields."""
    path = scratch(spark, "records")
    images = X.table(spark, sf_dir, "supplier").select(F.concat(F.lit("/scans/"), F.col("s_suppkey").cast("string"), F.lit(".v2.png")).alias("image_path"))
    images = images.withColumn("script_id", F.regexp_extract(S.file_stem(F.col("image_path")), r"^([0-9]+)\.v2$", 1))
    W.records_json(B.backend("Mock", mock_text="One.\nTwo ", mock_confidence=0.5)(images), path)
    back = S.ocr_results(spark, path)
    flat = B.flat(back).select("script_id", "image_path", "backend", "confidence", "confidence_type", "text_length", "n_segments", "normalized_text")
    return flat.join(back.select("script_id", F.size(V.record_errors()).alias("n_errors")), "script_id")


@query(Q._SQL["isotonic_predict"])
def calibrator_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted calibrator written, loaded and applied."""
    path = scratch(spark, "calibrator")
    rows = X.labelled(spark, sf_dir)
    W.calibrator(C.fit(rows.withColumnRenamed("is_acceptable", "label")), path)
    out = C.predict(rows, S.calibrator(spark, path))
    return out.select("doc_id", F.round("calibrated_confidence", 8).alias("calibrated_confidence"))


@query("""SELECT * FROM (VALUES ('no rows', 'platt', false, 0.4::DOUBLE), ('one label', 'platt', false, 0.4), ('one label', 'isotonic', false, 0.4), ('under five rows', 'isotonic', false, 0.4),
  ('unknown method', 'none', false, 0.4), ('fitted', 'isotonic', true, 1.0)) t("case", method, is_fitted, predicted)""")
def calibration_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrators that can't be fitted predict the confidence itself: 0.4 here."""
    regions = X.table(spark, sf_dir, "region").select(((F.col("r_regionkey") + 1) / 10.0).alias("confidence"), (F.col("r_regionkey") % 2).alias("label"))
    positive = regions.withColumn("label", F.lit(1))
    cases = [
        ("no rows", regions.limit(0), "platt", 2), ("one label", positive, "Platt_Scaling ", 2), ("one label", positive, "isotonic", 2),
        ("under five rows", regions.where("confidence < 0.45"), "isotonic", 5), ("unknown method", regions, "beta", 2), ("fitted", regions, "isotonic_regression", 5)]
    rows = []
    for case, labelled, method, least in cases:
        model = C.fit(labelled, method, least=least)
        one = C.predict(spark.range(1).select(F.lit(0.4).alias("confidence")), model).first()["calibrated_confidence"]
        rows.append((case, *model.select("method", "is_fitted").first(), one))
    return spark.createDataFrame(rows, "case string, method string, is_fitted boolean, predicted double")


@query("""SELECT o_custkey::VARCHAR AS script_id, count(*) AS n, count(o_totalprice) AS n_marked, round(sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 11 / 2 END), 6) AS total, min(o_orderpriority || ', "x"') AS feedback
FROM orders GROUP BY 1""".replace("count(o_totalprice)", "count(CASE WHEN o_orderkey % 3 <> 0 THEN 1 END)"))
def evaluation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation files of one header, read as one bag: two halves of the orders."""
    mark = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 11 / 2)
    given = {"task_id": F.col("o_orderkey"), "script_id": F.col("o_custkey"), "teacher_mark": mark, "feedback_summary": F.concat("o_orderpriority", F.lit(', "x"'))}
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVALUATION])
    paths = [scratch(spark, f"evaluations-{half}") for half in (0, 1)]
    for half, path in enumerate(paths):
        W.table_csv(rows.where(F.col("o_orderkey") % 2 == half).drop("o_orderkey"), path)
    back = S.evaluations(spark, *paths)
    return back.groupBy("script_id").agg(F.count("*").alias("n"), F.count("teacher_mark").alias("n_marked"), F.round(F.sum("teacher_mark"), 6).alias("total"), F.min("feedback_summary").alias("feedback"))


@query("SELECT o_orderkey::VARCHAR AS task_id, (o_custkey % 7)::VARCHAR AS script_id, o_orderpriority AS mark FROM orders")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks joined with references whose tasks repeat across scripts: only both keys together are unique."""
    orders = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"), (F.col("o_custkey") % 7).cast("string").alias("script_id"), F.col("o_orderpriority").alias("mark"))
    other = orders.withColumn("script_id", F.concat(F.lit("other-"), "script_id")).withColumn("mark", F.lit("wrong"))
    return M.join_truth(orders.select("task_id", "script_id"), orders.unionByName(other), ["task_id", "script_id"])
