"""Aggregation of segment confidences, per record over arrays or over exploded rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions.numeric import clamp

METHODS = ("mean", "minimum", "length_weighted_mean", "geometric_mean")
#: Least weight, so that empty segments count a little; least value inside a logarithm.
MIN_WEIGHT, MIN_SCORE = 0.001, 1e-6


def scored(confidences: Column, weights: Column | None = None) -> Column:
    """array<struct<c, w>> of the valid scores, clamped to [0, 1]; a missing weight is 1, none is below MIN_WEIGHT."""
    pairs = F.transform(confidences, lambda c, i: F.struct(
        clamp(c.cast("double")).alias("c"),
        F.greatest(F.lit(MIN_WEIGHT), F.coalesce(F.get(weights, i).cast("double") if weights is not None else F.lit(1.0), F.lit(1.0))).alias("w"),
    ))
    return F.filter(pairs, lambda p: p["c"].isNotNull())


def aggregate_confidence(confidences: Column, weights: Column | None = None, method: str = "length_weighted_mean") -> Column:
    """One confidence from an array; null without a valid score. Unknown methods count as the default."""
    pairs = scored(confidences, weights)
    n = F.size(pairs)
    add = lambda value: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + value(p))
    method = method.lower().strip()
    if method == "mean":
        out = add(lambda p: p["c"]) / n
    elif method == "minimum":
        out = F.array_min(F.transform(pairs, lambda p: p["c"]))
    elif method == "geometric_mean":
        out = F.exp(add(lambda p: F.ln(F.greatest(F.lit(MIN_SCORE), p["c"]))) / n)
    else:
        out = add(lambda p: p["c"] * p["w"]) / add(lambda p: p["w"])
    return F.when(n > 0, out)


def confidence_aggregates(confidence: Column, weight: Column | None = None) -> dict[str, Column]:
    """The four methods as aggregate expressions over a row per segment; partial sums combine before the shuffle."""
    c = clamp(confidence.cast("double"))
    w = F.when(c.isNotNull(), F.greatest(F.lit(MIN_WEIGHT), F.coalesce(weight.cast("double") if weight is not None else F.lit(1.0), F.lit(1.0))))
    return {
        "mean": F.avg(c),
        "minimum": F.min(c),
        "length_weighted_mean": F.sum(c * w) / F.sum(w),
        "geometric_mean": F.exp(F.avg(F.when(c.isNotNull(), F.ln(F.greatest(F.lit(MIN_SCORE), c))))),
    }
