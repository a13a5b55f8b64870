"""Sinks: every one writes from the executors; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.schemas import BENCHMARK_SAMPLE


def records_json(records: DataFrame, path: str) -> None:
    """One folder per script_id with its record as a JSON line. A script_id that repeats keeps its record of the smallest image path."""
    one = records.groupBy("script_id").agg(F.min_by(F.struct(*[c for c in records.columns if c != "script_id"]), F.col("input.image_path")).alias("r"))
    text = one.select("script_id", F.to_json(F.struct("script_id", "r.*")).alias("value"))
    text.write.mode("overwrite").partitionBy("script_id").text(path)


def benchmark_csv(rows: DataFrame, path: str) -> None:
    _csv(rows.select(*BENCHMARK_SAMPLE.names), path)


def table_csv(rows: DataFrame, path: str) -> None:
    """Bins, thresholds and other reports, in their column order."""
    _csv(rows, path)


def _csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def summary_json(summary: DataFrame, path: str, **metadata: str) -> None:
    """One record with metadata and metrics as nested objects."""
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]) if metadata else F.struct(F.lit(None).cast("string").alias("run"))
    summary.select(meta.alias("metadata"), F.struct(*summary.columns).alias("metrics")).write.mode("overwrite").json(path)


def calibrator(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def report(rows: DataFrame, columns: list[str] | None = None, n: int = 50) -> None:
    """Print a table."""
    (rows.select(*columns) if columns else rows).show(n, truncate=False)
