"""Numeric expressions: bins, confidence fusion, geometry, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(n: int) -> list[float]:
    """n + 1 bin edges from 0 to 1, bit for bit those of a linear space: i * (1 / n), the last exactly 1."""
    return [*(i * (1.0 / n) for i in range(n)), 1.0]


def bin_index(x: Column, n: int) -> Column:
    """1-based bin of x: half-open bins, the last closed; null outside [0, 1], for null and NaN.

    Edges are compared, not multiplied: 0.3, 0.6 and 0.7 lie just below their edges.
    """
    starts = F.array(*[F.lit(e) for e in edges(n)[:-1]])
    return F.when((x >= 0) & (x <= 1) & ~F.isnan(x), F.size(F.filter(starts, lambda e: e <= x)))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within [lo, hi]; null and NaN stay null (``greatest`` alone would skip a null)."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def mean_step_probability(step_max: Column) -> Column:
    """Mean of per-step largest probabilities; 0.85 if there are none."""
    total = F.aggregate(step_max, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.when(F.size(step_max) > 0, total / F.size(step_max)), F.lit(0.85))


def fused_confidence(lexical: Column, probability: Column) -> Column:
    """Line confidence from text plausibility (0.92 if null or 0) and token probability (0.85 if null)."""
    lexical = F.when(lexical.isNull() | (lexical == 0), 0.92).otherwise(lexical)
    return clamp(0.75 * lexical + 0.25 * (0.88 + 0.12 * F.coalesce(probability, F.lit(0.85))), 0.1, 0.99)


def resized(width: Column, height: Column, *, max_side: int = 2048, min_side: int = 600) -> Column:
    """struct(width, height) after shrinking the longest side to max_side, else enlarging the shortest to min_side."""
    longest, shortest = F.greatest(width, height), F.least(width, height)
    scale = F.when(longest > max_side, max_side / longest.cast("double")).when((shortest < min_side) & (longest < max_side), min_side / shortest.cast("double"))
    fit = lambda side: F.when(scale.isNull(), side).otherwise(F.greatest(F.lit(1), (side * scale).cast("int"))).cast("int")
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def detection_scale(width: Column, height: Column, *, canvas: float = 1280.0) -> Column:
    """Factor by which a page is shrunk before detection."""
    longest = F.greatest(width, height)
    return F.when(longest > canvas, canvas / longest).otherwise(F.lit(1.0))


def page_coordinates(points: Column, scale: Column) -> Column:
    """Detected [x, y] points in page pixels, truncated toward zero."""
    return F.transform(points, lambda p: F.transform(p, lambda v: (v / scale).cast("int")))


def upper_median(values: Column) -> Column:
    """Middle of the sorted array, the upper one of an even number; not interpolated."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def megabytes(n_bytes: Column) -> Column:
    return F.round(n_bytes / (1024 * 1024), 2)
