"""Sweep of routing thresholds: which share goes which way, and how good each side is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def routed_high(confidence: Column, threshold: Column | float) -> Column:
    """At or above the threshold; null and NaN go low."""
    return F.coalesce((confidence >= threshold) & ~F.isnan(confidence), F.lit(False))


def sweep(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS, *, digits: tuple[int, int] | None = (4, 2)) -> DataFrame:
    """A row per threshold, in the order given, from confidence, is_acceptable, cer, wer. No rows at all give no thresholds.

    One scan: each sample counts how many distinct thresholds it reaches; sums per count are additive, so a threshold's
    high side is a suffix sum over at most len(thresholds) + 1 rows.
    """
    spark = rows.sparkSession
    levels = sorted(set(float(t) for t in thresholds))
    grid = F.array(*[F.lit(t) for t in levels])
    c = F.col("confidence")
    reached = F.when(c.isNull() | F.isnan(c), 0).otherwise(F.size(F.filter(grid, lambda t: t <= c)))
    y = F.coalesce(F.col("is_acceptable").cast("long"), F.lit(0))
    sums = rows.groupBy(reached.alias("k")).agg(F.count("*").alias("n"), F.sum(y).alias("y"), F.sum("cer").alias("cer"), F.sum("wer").alias("wer"))
    # A row per level, so that levels no sample stops at have their sums too.
    spine = spark.createDataFrame([(k,) for k in range(len(levels) + 1)], "k int")
    full = F.broadcast(spine).join(sums, "k", "left").na.fill(0)
    above, all_ = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    full = full.select("k", *[F.sum(x).over(above).alias(f"hi_{x}") for x in ("n", "y", "cer", "wer")], *[F.sum(x).over(all_).alias(f"all_{x}") for x in ("n", "y", "cer", "wer")])
    wanted = spark.createDataFrame([(i, float(t), levels.index(float(t)) + 1) for i, t in enumerate(thresholds)], "position int, threshold double, k int")
    out = F.broadcast(wanted).join(full, "k").where("all_n > 0")
    hi = {x: F.col(f"hi_{x}") for x in ("n", "y", "cer", "wer")}
    lo = {x: F.col(f"all_{x}") - F.col(f"hi_{x}") for x in hi}
    rate = lambda a, b, d, scale=1.0: (lambda v: v if digits is None else F.round(v, digits[d]))(F.coalesce(F.when(b > 0, a / b), F.lit(0.0)) * scale)
    return out.orderBy("position").select(
        "threshold",
        rate(hi["n"], F.col("all_n"), 1, 100.0).alias("pct_high_confidence"), rate(lo["n"], F.col("all_n"), 1, 100.0).alias("pct_low_confidence"),
        rate(hi["cer"], hi["n"], 0).alias("high_conf_cer"), rate(hi["wer"], hi["n"], 0).alias("high_conf_wer"), rate(hi["y"], hi["n"], 1, 100.0).alias("high_conf_acceptable_rate"),
        rate(lo["cer"], lo["n"], 0).alias("low_conf_cer"), rate(lo["wer"], lo["n"], 0).alias("low_conf_wer"), rate(lo["y"], lo["n"], 1, 100.0).alias("low_conf_acceptable_rate"),
        hi["y"].cast("long").alias("high_correct_count"), (hi["n"] - hi["y"]).cast("long").alias("high_incorrect_count"),
        lo["y"].cast("long").alias("low_correct_count"), (lo["n"] - lo["y"]).cast("long").alias("low_incorrect_count"),
    )


def total_samples(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_samples"))
