"""Calibrators: a fixed-step logistic curve and a step curve through the first positive, kept as one-row tables.

The logistic fit is 300 full-batch gradient steps, not a converged regression; the "isotonic" one is the running maximum of
labels in order of confidence, not pooled adjacent violators. Both are defined so and need no library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.operators.reliability import with_confidence
from inkgauge.schemas import CALIBRATOR
from inkgauge.storage import written

PLATT, ISOTONIC = ("platt", "platt_scaling"), ("isotonic", "isotonic_regression")
STEPS, RATE = 300, 0.1
FOLD_POINTS = 20_000


def _method(name: str) -> str:
    name = name.lower().strip()
    return "platt" if name in PLATT else "isotonic" if name in ISOTONIC else "none"


def fit(rows: DataFrame, method: str = "isotonic_regression", *, least: int = 2) -> DataFrame:
    """One row of CALIBRATOR from confidence and label (0, 1, or boolean).

    Unfitted (predicts the confidence itself) if there are fewer than two labels or ``least`` rows, or for an unknown method.
    """
    kind = _method(method)
    clean = with_confidence(rows).select("confidence", F.col("label").cast("int").alias("y")).where("y is not null")
    # One row per distinct confidence carries all that either fit needs; written, so that the facts are read once.
    stats = clean.groupBy("confidence").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    stats = written(stats) if kind != "none" else stats
    if kind == "platt":
        model = _fit_platt(stats, least)
    elif kind == "isotonic":
        model = _fit_isotonic(stats, least)
    else:
        model = rows.sparkSession.createDataFrame([(False, None, None, None, None)], "is_fitted boolean, a double, b double, x_knots array<double>, y_knots array<double>")
    return model.select(*[(F.lit(kind) if f.name == "method" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in CALIBRATOR])


def _fitted(least: int) -> Column:
    return F.coalesce((F.sum("n") >= max(2, least)) & (F.sum("s") > 0) & (F.sum("s") < F.sum("n")), F.lit(False))


def _fit_platt(stats: DataFrame, least: int) -> DataFrame:
    """Full-batch gradient steps over the sums of each distinct confidence.

    Up to FOLD_POINTS distinct values (4-digit confidences have 10,001) fold in one row of one query. With more, each step is
    a distributed sum over the written statistics and only its two numbers reach the driver.
    """
    spark = stats.sparkSession
    head = stats.agg(_fitted(least).alias("f"), F.sum("n").cast("double").alias("total"), F.count("*").alias("points")).first()
    schema = "is_fitted boolean, a double, b double, x_knots array<double>, y_knots array<double>"
    if not head["f"]:
        return spark.createDataFrame([(False, None, None, None, None)], schema)
    if head["points"] > FOLD_POINTS:
        a, b = 1.0, 0.0
        miss = lambda a, b: F.col("n") / (1.0 + F.exp(-(F.lit(a) * F.col("confidence") + F.lit(b)))) - F.col("s")
        for _ in range(STEPS):
            g = stats.agg(F.sum(miss(a, b) * F.col("confidence")).alias("a"), F.sum(miss(a, b)).alias("b")).first()
            a, b = a - RATE * g["a"] / head["total"], b - RATE * g["b"] / head["total"]
        return spark.createDataFrame([(True, a, b, None, None)], schema)
    total = F.lit(head["total"])
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    points = stats.agg(F.array_sort(F.collect_list(F.struct(F.col("confidence").alias("c"), "n", "s"))).alias("points"))

    def step(p: Column, _: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            miss = x["n"] / (1.0 + F.exp(-(p["a"] * x["c"] + p["b"]))) - x["s"]
            return pair(acc["a"] + miss * x["c"], acc["b"] + miss)

        g = F.aggregate(F.col("points"), pair(F.lit(0.0), F.lit(0.0)), add)
        # The fold over points runs once for both parts.
        return F.aggregate(F.array(g), p, lambda q, d: pair(q["a"] - RATE * d["a"] / total, q["b"] - RATE * d["b"] / total))

    done = points.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), pair(F.lit(1.0), F.lit(0.0)), step).alias("p"))
    return done.select(F.lit(True).alias("is_fitted"), "p.a", "p.b", F.lit(None).alias("x_knots"), F.lit(None).alias("y_knots"))


def _fit_isotonic(stats: DataFrame, least: int) -> DataFrame:
    """Running maximum of labels by (confidence, label), as its two knots that matter.

    b is the first confidence with a positive, x0 the last one with a negative at or below b. Both are single numbers.
    """
    first = stats.agg(F.min(F.when(F.col("s") > 0, F.col("confidence"))).alias("b"), _fitted(least).alias("is_fitted")).first()
    b, fitted = F.lit(first["b"]).cast("double"), F.lit(bool(first["is_fitted"]))
    negative = F.when((F.col("s") < F.col("n")) & (F.col("confidence") <= b), F.col("confidence"))
    alone = F.col("x0").isNull()
    return stats.agg(F.max(negative).alias("x0")).select(
        fitted.alias("is_fitted"), F.lit(None).alias("a"), F.lit(None).alias("b"),
        F.when(fitted, F.when(alone, F.array(b)).otherwise(F.array("x0", b))).alias("x_knots"),
        F.when(fitted, F.when(alone, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))).alias("y_knots"),
    )


def predict(rows: DataFrame, model: DataFrame, *, column: str = "calibrated_confidence") -> DataFrame:
    """``rows`` with the calibrated confidence; the model is one row, read once and planned as constants."""
    m = model.select("method", "is_fitted", "a", "b", "x_knots", "y_knots").first()
    return rows.withColumn(column, calibrated(F.col("confidence"), m.asDict()))


def calibrated(c: Column, model: dict) -> Column:
    """Calibrated value of confidence c; of an unfitted model c itself, not clamped. Null stays null."""
    if not model["is_fitted"]:
        return c
    if model["method"] == "platt":
        value = 1.0 / (1.0 + F.exp(-(model["a"] * c + model["b"])))
        return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return F.when(c.isNotNull(), interpolate(c, model["x_knots"], model["y_knots"]))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through knots sorted by x, constant beyond them; of equal knots the last one holds at the knot."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 2, -1, -1):
        run = xs[i + 1] - xs[i]
        between = F.lit(float(ys[i])) + (x - xs[i]) * ((ys[i + 1] - ys[i]) / run) if run > 0 else F.lit(float(ys[i]))
        out = F.when(x < xs[i + 1], between).otherwise(out)
    return F.when(x < xs[0], F.lit(float(ys[0]))).otherwise(out)
