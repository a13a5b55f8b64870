"""Record rules: a quarantine filter, or a strict mode that stops at the first bad record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE_TYPES = ("raw", "derived", "calibrated", "none")
REQUIRED = ("script_id", "input.image_path", "input.image_hash", "ocr.backend", "ocr.model", "ocr.raw_text", "ocr.normalized_text", "metadata.timestamp")


def unit_interval(c: Column) -> Column:
    """Null or within [0, 1]; NaN is not."""
    return c.isNull() | (c.between(0.0, 1.0) & ~F.isnan(c))


def record_errors(segments: bool = True) -> Column:
    """array<string> of the rules that an OCR_RESULT record breaks."""
    ok = [
        ("confidence", unit_interval(F.col("ocr.confidence"))),
        ("processing_time_seconds", F.coalesce(F.col("metadata.processing_time_seconds") >= 0, F.lit(False))),
        ("confidence_type", F.coalesce(F.col("ocr.confidence_type").isin(*CONFIDENCE_TYPES), F.lit(True))),
        *[(f, F.col(f).isNotNull()) for f in REQUIRED],
    ]
    if segments:
        ok.append(("segments", F.coalesce(F.forall("ocr.segments", lambda s: s["text"].isNotNull() & unit_interval(s["confidence"])), F.lit(True))))
    return F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in ok]), lambda e: e.isNotNull())


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the others with their errors."""
    judged = records.withColumn("errors", record_errors())
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)


def strict(records: DataFrame) -> DataFrame:
    """Records as they are; reading a bad one raises an error."""
    judged = records.withColumn("__errors", record_errors())
    message = F.concat(F.lit("invalid record "), F.coalesce("script_id", F.lit("null")), F.lit(": "), F.array_join("__errors", ", "))
    return judged.where(F.when(F.size("__errors") == 0, True).otherwise(F.raise_error(message).cast("boolean"))).drop("__errors")


def duplicate_hashes(rows: DataFrame, column: str = "image_hash") -> DataFrame:
    """column, copies: values that occur more than once."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("copies")).where("copies > 1")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
