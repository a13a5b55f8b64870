"""Running reliability of a stream of scored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.numeric import bin_index


def windowed_bins(samples: DataFrame, *, time: str = "event_time", window: str = "10 minutes", late: str = "30 minutes", n: int = 10) -> DataFrame:
    """window, bin_index and additive sums (n, confidence, acceptable, cer, wer) per tumbling window.

    ``samples`` has the time column, confidence, is_acceptable, cer, wer; batch or streaming. State per window is n + 1 rows;
    windows older than the watermark are dropped. Bins, ECE and thresholds follow from the sums of a window's rows.
    """
    rows = samples.withWatermark(time, late) if samples.isStreaming else samples
    return rows.groupBy(F.window(time, window).alias("window"), bin_index(F.col("confidence"), n).alias("bin_index")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.sum(F.col("is_acceptable").cast("int")).alias("acceptable"), F.sum("cer").alias("cer"), F.sum("wer").alias("wer"))
