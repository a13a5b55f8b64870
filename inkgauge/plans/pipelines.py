"""The end-to-end runs: recognise, benchmark, analyse, calibrate, route. Each returns lazy frames; writers are separate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.operators import calibration, metrics, reliability, routing
from inkgauge.sources.backends import Backend
from inkgauge.sources.readers import EngineConfig

#: Fewest rows from which a calibrator is fitted in a run.
LEAST_CALIBRATION_ROWS = 5


def recognise(images: DataFrame, backend: Backend) -> DataFrame:
    return backend(images)


def benchmark(records: DataFrame, truth: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """The fact table and its summary from OCR_RESULT records and references, joined on script_id."""
    flat = records.select(
        "script_id", F.col("input.image_path").alias("image_path"), F.col("ocr.raw_text").alias("raw_ocr_text"), F.col("ocr.normalized_text").alias("normalized_ocr_text"),
        F.col("ocr.confidence").alias("confidence"), F.col("ocr.confidence_available").alias("confidence_available"), "metadata.processing_time_seconds")
    joined = metrics.join_truth(flat, truth.select("script_id", "ground_truth_text"))
    rows = metrics.benchmark_rows(joined, max_cer=config.max_cer, max_wer=config.max_wer)
    return rows, metrics.summarize(rows)


def scored(rows: DataFrame) -> DataFrame:
    """confidence, is_acceptable, cer, wer of the fact table: the four columns that the analytics read."""
    return rows.select("confidence", "is_acceptable", F.col("normalized_cer").alias("cer"), F.col("normalized_wer").alias("wer"))


def analyse(rows: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """Reliability bins and calibration metrics."""
    s = scored(rows)
    return reliability.confidence_bins(s, config.confidence_bins), reliability.calibration_metrics(s, config.confidence_bins)


def calibrate(rows: DataFrame, method: str = "platt") -> DataFrame:
    return calibration.fit(rows.select("confidence", F.col("is_acceptable").alias("label")), method, least=LEAST_CALIBRATION_ROWS)


def route(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return routing.sweep(reliability.with_confidence(scored(rows)), config.candidate_thresholds)
