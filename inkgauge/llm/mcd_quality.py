"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Each text gives counts (words, their characters, symbols, repeated lines and repeated windows of words). Texts that fail
the base rules are out. The others' counts become a vector of five transformed statistics (``FEATURES``), held as
integers of 1e-4, so that sums are exact and don't depend on the order of rows. Each language and source gets a minimum-
covariance-determinant estimate. Concentration steps (mean and covariance of the ``CORE`` share of vectors with the smallest
distances, then new distances) run from several starts at once: the vectors are put in units of median deviations
from the medians, and a start takes those nearest by all features together, by the worst one, by the text's length and
words alone, or by symbols and repeats alone. After ``FIRST_STEPS`` steps the start of the smallest determinant goes on until
no determinant falls, at most ``STEPS`` steps more; a step that doesn't lower it is not taken. Every covariance has the
features' granted variances on its diagonal, so the determinant is the regularised one, and a constant statistic rejects
nothing for a trifle. Quantiles are exact percentiles of bounded numbers of buckets, counted before the shuffle, so a source
that holds a third of all rows is one small row per task. Vectors whose squared Mahalanobis distance is above ``CUTOFF``, times what
the core's distances exceed the chi-squared distribution's, are rejected.

A language and source of fewer than ``least`` texts (``LEAST``: five per feature) can't bear an estimate of its own: it is judged by its
language's, a language with fewer by that of all texts; with fewer in all, none is rejected. Column ``estimate`` says which one judged
a text: source, language, all, or null for none and for texts that fail the base rules. Null language or source are
values of their own. A null text has no words and fails. Repeated rows count and are judged each. Texts are taken whole. An empty table gives
an empty result. Only doc_id, text, lang and source are read, other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import BLANKS, written

SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, and the share of words in repeated 5-word windows in percent.
MIN_WORDS, MAX_REPEAT = 10, 20
LEAST, FIRST_STEPS, STEPS, CORE = 25, 2, 6, 0.75
#: Chi-squared with 5 degrees of freedom: its 0.75 quantile, and the usual one at 0.999.
CHI2_CORE, CUTOFF = 6.6257, 20.515
SCALE = 10_000
#: Statistic and the standard deviation that every group is granted, so that constant statistics reject nothing for a trifle.
#: Pseudo-counts (20 words of 5 characters) draw short texts towards the middle.
FEATURES: list[tuple[str, float]] = [
    ("ln(1 + n_words)", 0.5),
    ("ln((word_chars + 100) / (n_words + 20))", 0.08),
    ("sqrt(n_symbols / (word_chars + 100))", 0.08),
    ("sqrt(n_dup_lines / (n_words + 20))", 0.06),
    ("sqrt(n_repeat_words / (n_words + 20))", 0.1),
]
_P = range(len(FEATURES))
#: Features whose deviations make a start's first distance, and whether the worst counts alone.
STARTS: list[tuple[tuple[int, ...], bool]] = [((0, 1, 2, 3, 4), False), ((0, 1, 2, 3, 4), True), ((0, 1), False), ((2, 3, 4), False)]
#: Width of a bucket of a feature in units of 1 / SCALE, and buckets per unit of ln(distance), for quantiles.
WIDTH, SPREAD = 50, 32


def base_counts(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``extra`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*extra, text.alias("text"))
    size = lambda a: F.size(a).cast("long")
    blank = F.lit(BLANKS)
    rows = rows.select(
        *extra,
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, blank) != "").alias("lines"),
    )
    rows = rows.select(*extra, "words", "word_chars", "n_symbols", size("words").alias("n_words"), (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"))
    at = lambda i, k: F.get(F.col("words"), i + k)
    grams = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", grams.alias("grams"))
    # Only texts that repeat a window sort their windows; equal ones are then neighbours.
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    ordered = F.when(repeats, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.select(*extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", ordered.alias("ordered"))
    near = lambda x, i: F.coalesce(F.get(F.col("ordered"), i)["h"] == x["h"], F.lit(False))
    twice = F.transform(F.filter("ordered", lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["i"])
    # A window at i covers 5 words, less those that the window before it covers.
    start = F.struct(F.lit(-5).alias("before"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(F.array_sort(twice), start, lambda a, i: F.struct(i.alias("before"), (a["n"] + F.least(F.lit(5), i - a["before"])).cast("long").alias("n")), lambda a: a["n"])
    return rows.select(*extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def vectors(counts: DataFrame) -> DataFrame:
    """(counts, grp, x0..x4, n) for each distinct vector of a group: equal vectors are one row with their number n."""
    xs = [F.round(F.expr(sql) * SCALE).cast("long").alias(f"x{i}") for i, (sql, _) in enumerate(FEATURES)]
    return counts.where(~base_failed()).select("lang", "source", *xs).groupBy("lang", "source", *[f"x{i}" for i in _P]).agg(F.count("*").alias("n"))


def groups_of(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(of_lang, of_source, grp, estimate): the group whose estimate judges a language and source; null if there are too few texts."""
    sizes = written(rows.groupBy("lang", "source").agg(F.sum("n").alias("n")))
    langs = sizes.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("n_lang"))
    n_all = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    key = F.to_json(F.struct("lang", "source"))
    level = F.when(F.col("n") >= least, "source").when(F.col("n_lang") >= least, "language").otherwise(F.lit("all" if n_all >= least else None))
    rows = sizes.join(langs, F.col("lang").eqNullSafe(F.col("of_lang"))).select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "lang", key.alias("key"), level.alias("estimate"))
    grp = F.when(F.col("estimate") == "source", F.concat(F.lit("s"), "key")).when(F.col("estimate") == "language", F.concat(F.lit("l"), F.to_json(F.struct("lang")))).otherwise(F.col("estimate"))
    return rows.select("of_lang", "of_source", grp.alias("grp"), "estimate")


def _bucket(d: Column) -> Column:
    return F.floor(F.ln(d + F.lit(1e-6)) * F.lit(float(SPREAD))).cast("int")


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _first_distances(rows: DataFrame) -> DataFrame:
    """``rows`` once per start, with start and d, the start's first distance."""
    bucket = lambda x: F.round(x / WIDTH).cast("long")
    middle = lambda x: F.percentile(bucket(x), 0.5, F.col("n")) * WIDTH
    median = written(rows.groupBy("grp").agg(*[middle(F.col(f"x{i}")).alias(f"m{i}") for i in _P]))
    off = rows.join(median, "grp")
    spread = written(off.groupBy("grp").agg(*[middle(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"a{i}") for i in _P]))
    z = [F.pow((F.col(f"x{i}") - F.col(f"m{i}")) / F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FEATURES[i][1] * SCALE)), F.lit(2)) for i in _P]
    first = [F.struct(F.lit(k).alias("start"), (F.greatest(*[z[i] for i in of]) if worst else _total([z[i] for i in of])).alias("d")) for k, (of, worst) in enumerate(STARTS)]
    return off.join(spread, "grp").select(*rows.columns, F.inline(F.array(*first)))


def _core(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors of the smallest distances, and (grp, start, q): the bucket that ends them."""
    ends = written(measured.groupBy("grp", "start").agg(F.floor(F.percentile(_bucket(F.col("d")), CORE, F.col("n"))).alias("q")))
    return measured.join(ends, ["grp", "start"]).where(_bucket(F.col("d")) <= F.col("q")).drop("q", "d"), ends


def _concentrate(near: DataFrame) -> DataFrame:
    """grp, start, m0.., l00.., ln_det: mean of ``near`` (weights n), Cholesky factor of its covariance in units of SCALE, ln of the determinant."""
    exact = lambda c: F.sum((c).cast("decimal(28,0)"))
    n = F.col("n")
    sums = [exact(F.col(f"x{i}") * n).cast("double").alias(f"s{i}") for i in _P]
    prods = [exact(F.col(f"x{i}").cast("decimal(14,0)") * F.col(f"x{j}") * n).cast("double").alias(f"p{i}{j}") for i in _P for j in range(i + 1)]
    rows = near.groupBy("grp", "start").agg(F.sum("n").cast("double").alias("w"), *sums, *prods)
    rows = rows.select("grp", "start", *[(F.col(f"s{i}") / F.col("w") / SCALE).alias(f"m{i}") for i in _P], *[
        (F.col(f"p{i}{j}") / F.col("w") / SCALE**2 - F.col(f"s{i}") / F.col("w") / SCALE * (F.col(f"s{j}") / F.col("w") / SCALE)
         + F.lit(FEATURES[i][1] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in _P for j in range(i + 1)])
    for j in _P:  # one column of the factor after the other
        inner = lambda i, j: _total([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)])
        rows = rows.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner(j, j), F.lit(1e-9))))
        rows = rows.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - inner(i, j)) / F.col(f"l{j}{j}") for i in range(j + 1, len(FEATURES))}) if j + 1 < len(FEATURES) else rows
    ln_det = _total([2 * F.ln(F.col(f"l{j}{j}")) for j in _P])
    return written(rows.select("grp", "start", *_MODEL, ln_det.alias("ln_det")))


_MODEL = [f"m{i}" for i in _P] + [f"l{i}{j}" for i in _P for j in range(i + 1)]


def _distances(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with start and d, the squared Mahalanobis distance: forward substitution in the Cholesky factor."""
    joined = rows.join(model, ["grp", "start"] if "start" in rows.columns else "grp")
    for i in _P:
        rest = _total([F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)])
        joined = joined.withColumn(f"z{i}", (F.col(f"x{i}") / F.lit(float(SCALE)) - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    return joined.select(*[c for c in rows.columns if c != "start"], "start", _total([F.col(f"z{i}") * F.col(f"z{i}") for i in _P]).alias("d"))


def estimate(rows: DataFrame) -> DataFrame:
    """(grp, start, m.., l.., ln_det, cut): location, scatter, and the squared distance above which a vector is rejected, from (grp, x.., n)."""
    started = written(_first_distances(rows))
    core, _ = _core(started)
    for _ in range(FIRST_STEPS):
        model = _concentrate(core)
        core, _ = _core(_distances(started.drop("d"), model))
    every = _concentrate(core)
    best = every.groupBy("grp").agg(F.min_by("start", F.struct("ln_det", "start")).alias("start"))
    model = written(every.join(best, ["grp", "start"]))
    core, ends = _core(_distances(rows, model))
    for _ in range(STEPS):
        new = _concentrate(core)
        better = written(new.join(model.select("grp", F.col("ln_det").alias("old")), "grp").where("ln_det < old - 1e-9").drop("old"))
        if better.isEmpty():
            break
        model = written(model.join(better, "grp", "left_anti").unionByName(better))
        core, ends = _core(_distances(rows, model))
    # A group tighter than the granted deviations is not blown up to fit the chi-squared distribution.
    widen = F.greatest(F.lit(1.0), F.exp((F.col("q") + 1) / F.lit(float(SPREAD))) / CHI2_CORE)
    return written(model.join(ends, ["grp", "start"]).withColumn("cut", widen * CUTOFF).drop("q"))


def judge(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and estimate of each row."""
    counts = base_counts(docs, ["doc_id", "lang", "source"])
    # The texts' counts are made once and then judged: a small table beside the texts.
    counts = written(counts.withColumn("base_failed", base_failed()))
    rows = written(vectors(counts))
    groups = written(groups_of(rows, least))
    on = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    placed = written(rows.join(groups, on).drop("of_lang", "of_source", "estimate").where("grp is not null"))
    model = estimate(written(placed.groupBy("grp", *[f"x{i}" for i in _P]).agg(F.sum("n").alias("n"))))
    # Each distinct vector is judged once per group, and the rejected ones, few, are looked up.
    out = _distances(placed, model.drop("cut", "ln_det")).join(model.select("grp", "cut"), "grp").where("d > cut")
    rejected = written(out.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[F.col(f"x{i}").alias(f"y{i}") for i in _P], F.lit(True).alias("outlier")).distinct())
    xs = [F.round(F.expr(sql) * SCALE).cast("long").alias(f"x{i}") for i, (sql, _) in enumerate(FEATURES)]
    marked = counts.join(groups.drop("grp"), on, "left").drop("of_lang", "of_source").select("*", *[F.when(~F.col("base_failed"), x).alias(f"x{i}") for i, x in enumerate(xs)])
    same = reduce(lambda a, b: a & b, [F.col(f"x{i}") == F.col(f"y{i}") for i in _P])
    return marked.join(rejected, on & same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("outlier").isNull()).alias("kept"), F.when(~F.col("base_failed"), F.col("estimate")).alias("estimate"))
