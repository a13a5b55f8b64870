"""Agreement of marks, caps and bands between raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ceilings that a hard cap puts on a total.
CAPS = {"Letter_Missing_Layout": 2.0, "Summary_Verbatim_Length": 5.0, "Graph_External_Facts": 5.0}
SUB_SCORES = ("context_content_data", "structure_format_brevity", "language_mechanics", "originality_comparisons_paraphrase")


def quadratic_kappa(x: Column, y: Column) -> Column:
    """Quadratic weighted kappa of whole marks, by moments: no matrix of marks is formed. Null if expected disagreement is 0."""
    expected = F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)
    return 1 - F.avg((x - y) * (x - y)) / F.nullif(expected, F.lit(0.0))


def agreement(rows: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """comparison, n, mae, rmse, pearson_r, qwk, exact_pct, within_one_pct for each (name, column, column).

    Rows with a null mark on either side don't count. Kappa is on marks rounded half to even. One scan for all pairs.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(name).alias("comparison"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for name, a, b in pairs])).alias("p")
    flat = rows.select(parts).select("p.*").where("x is not null and y is not null")
    d = F.abs(F.col("x") - F.col("y"))
    return flat.groupBy("comparison").agg(
        F.count("*").alias("n"), F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr("x", "y").alias("pearson_r"),
        quadratic_kappa(F.bround("x", 0), F.bround("y", 0)).alias("qwk"),
        (100 * F.avg((d == 0).cast("double"))).alias("exact_pct"), (100 * F.avg((d <= 1).cast("double"))).alias("within_one_pct"),
    )


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, accuracy; ratios of nothing are null."""
    t, p = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    n = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    part = lambda a, b: a / F.nullif(b, F.lit(0))
    return n.select(
        "tp", "fp", "fn", "tn", part(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), part(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        part(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
    )


def band(mark: Column, full: Column) -> Column:
    """0 for no mark, then by share of the full mark: 1 below .4, 2 below .6, 3 below .8, else 4."""
    share = mark / full
    return F.when(mark <= 0, 0).when(share < 0.4, 1).when(share < 0.6, 2).when(share < 0.8, 3).when(share.isNotNull(), 4)


def band_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: exact and adjacent agreement of two bands (numbers, or text like "Band 2") in percent."""
    number = lambda c: F.regexp_extract(F.col(c).cast("string"), r"([0-9]+)", 1).try_cast("int")
    gap = F.abs(number(a) - number(b))
    return rows.agg((100 * F.avg((gap == 0).cast("double"))).alias("exact_pct"), (100 * F.avg((gap <= 1).cast("double"))).alias("adjacent_pct"))


def variant_metrics(rows: DataFrame, variants: Sequence[str], *, gold: str = "gold_score", full: str = "full_marks") -> DataFrame:
    """subject ('ALL' for all), variant, n, exact_agreement, within_half, normalized_mae; one unpivot and one rollup."""
    flat = rows.select("subject", gold, full, F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).cast("double").alias("mark")) for v in variants])).alias("v"))
    flat = flat.select("subject", "v.variant", F.abs(F.col(gold) - F.col("v.mark")).alias("err"), F.col(full).alias("full")).where("err is not null")
    out = flat.groupBy("variant", "subject").agg(F.count("*").alias("n"), F.sum((F.col("err") == 0).cast("long")).alias("exact"), F.sum((F.col("err") <= 0.5).cast("long")).alias("half"), F.sum(F.col("err") / F.col("full")).alias("share"))
    # Sums per subject add up to those of all.
    roll = out.rollup("variant", "subject").agg(F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in ("n", "exact", "half", "share")]).where("g < 3")
    return roll.select(
        F.when(F.col("g") == 1, F.lit("ALL")).otherwise(F.col("subject")).alias("subject"), "variant", "n",
        (F.col("exact") / F.col("n")).alias("exact_agreement"), (F.col("half") / F.col("n")).alias("within_half"), (F.col("share") / F.col("n")).alias("normalized_mae"),
    )


def disagreements(rows: DataFrame, k: int = 40, *, per_subject: bool = False, predicted: str = "predicted_score") -> DataFrame:
    """The k largest normalised errors, ties by id: all rows with abs_err, normalized_err; texts cut for the report."""
    err = F.abs(F.col("gold_score") - F.col(predicted))
    rows = rows.withColumn("abs_err", err).withColumn("normalized_err", err / F.col("full_marks"))
    for column, width in (("transcription", 200), ("reasoning", 300)):
        if column in rows.columns:
            rows = rows.withColumn(column, F.substring(column, 1, width))
    order = [F.desc("normalized_err"), F.asc("id")]
    if not per_subject:
        return rows.orderBy(*order).limit(k)
    # A limit pushed below the shuffle: each task keeps k rows per subject before they meet.
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy(*order))).where(F.col("rank") <= k)


def sum_check(total: Column, *parts: Column) -> Column:
    """Whether sub-scores add up to the total; null parts count as 0."""
    added = F.lit(0.0)
    for p in parts:
        added = added + F.coalesce(p, F.lit(0.0))
    return F.abs(added - total) < 1e-9


def capped(total: Column, reason: Column, caps: dict[str, float] | None = None) -> Column:
    """The total under its hard cap; unknown or absent reasons leave it."""
    rules = CAPS if caps is None else caps
    ceiling = F.lit(None).cast("double")
    for name, top in rules.items():
        ceiling = F.when(reason == name, F.lit(top)).otherwise(ceiling)
    return F.least(total, ceiling)


def evaluation_id(task: Column, grader: Column) -> Column:
    return F.concat_ws("__", task, grader)


def aspects(text: Column) -> Column:
    """Entries of a list kept as text, parted by ' | '."""
    return F.filter(F.split(text, r" \| "), lambda x: F.trim(x) != "")


def relative_reduction(before: Column, after: Column) -> Column:
    """Percent by which a rate fell."""
    return 100 * (before - after) / F.nullif(before, F.lit(0.0))


def stage_report(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """stage, metric, value: each stage's one-row frame of numbers unpivoted, then a bag union."""
    out = None
    for name, frame in stages:
        part = frame.select(F.lit(name).alias("stage"), *[F.col(c).cast("double") for c in frame.columns]).unpivot("stage", frame.columns, "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def join_marks(evaluations: DataFrame, marks: DataFrame) -> DataFrame:
    """Evaluations with reference marks on (task_id, script_id). task_id alone repeats across scripts and would fan out."""
    from inkgauge.operators.metrics import join_truth

    return join_truth(evaluations, marks, ["task_id", "script_id"])
