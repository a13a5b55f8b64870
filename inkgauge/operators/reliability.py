"""Reliability bins and calibration error, one scan of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.numeric import bin_index, edges
from inkgauge.functions.text import bin_label


def with_confidence(rows: DataFrame) -> DataFrame:
    """Rows whose confidence is neither null nor NaN."""
    return rows.where(F.col("confidence").isNotNull() & ~F.isnan("confidence"))


def _binned(rows: DataFrame, n: int) -> DataFrame:
    y = F.col("is_acceptable").cast("int")
    have = set(rows.columns)
    return rows.groupBy(bin_index(F.col("confidence"), n).alias("bin_index")).agg(
        F.count("*").alias("sample_count"), F.avg("confidence").alias("c"), F.avg(y).alias("y"),
        *[(F.avg(x) if x in have else F.lit(0.0)).alias(x) for x in ("cer", "wer")],
    )


def confidence_bins(rows: DataFrame, n: int = 10, *, digits: tuple[int, int] | None = (4, 2)) -> DataFrame:
    """A row per bin, empty ones too, from confidence, is_acceptable, cer, wer. Empty bins show their midpoint and zeros."""
    e = edges(n)
    spine = rows.sparkSession.createDataFrame(
        [(i + 1, bin_label(e[i], e[i + 1]), (e[i] + e[i + 1]) / 2.0) for i in range(n)], "bin_index int, bin_range string, middle double")
    rounded = lambda c, k: c if digits is None else F.round(c, digits[k])
    found = _binned(with_confidence(rows), n).where("bin_index is not null")
    # n rows each: the bins come from a list, the aggregate has a row per bin.
    return F.broadcast(spine).join(found, "bin_index", "left").select(
        "bin_index", "bin_range", F.coalesce("sample_count", F.lit(0)).cast("long").alias("sample_count"),
        rounded(F.coalesce("c", "middle"), 0).alias("avg_confidence"), rounded(F.coalesce("cer", F.lit(0.0)), 0).alias("avg_cer"),
        rounded(F.coalesce("wer", F.lit(0.0)), 0).alias("avg_wer"), rounded(F.coalesce("y", F.lit(0.0)) * 100.0, 1).alias("acceptable_ocr_percentage"),
    )


def calibration_metrics(rows: DataFrame, n: int = 10, *, digits: int | None = 4) -> DataFrame:
    """One row: ece, mce, brier_score of confidence against is_acceptable; zeros for no rows.

    Rows outside [0, 1] fall in no bin but count in the number of rows and the Brier score.
    """
    have = with_confidence(rows)
    y = F.col("is_acceptable").cast("int")
    bins = have.groupBy(bin_index(F.col("confidence"), n).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(y).alias("y"), F.sum(F.pow(F.col("confidence") - y, F.lit(2))).alias("sq"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("y") - F.col("c")))
    rounded = lambda c: F.coalesce(c if digits is None else F.round(c, digits), F.lit(0.0))
    return bins.agg(
        rounded(F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), rounded(F.max(gap)).alias("mce"), rounded(F.sum("sq") / F.sum("n")).alias("brier_score"))
