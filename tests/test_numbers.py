import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.functions import numeric as N
from inkgauge.operators import agreement as A
from inkgauge.operators import calibration as C
from inkgauge.operators import confidence as K
from inkgauge.operators import layout as L
from inkgauge.operators import metrics as M
from inkgauge.operators import reliability as R
from inkgauge.operators import routing as G


def test_edges_and_bins(spark):
    for n in (1, 3, 10, 77):
        assert N.edges(n) == list(np.linspace(0, 1, n + 1))
    values = [0.0, 0.05, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0, 1.2, -0.1, float("nan"), None]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "c double").select(N.bin_index(F.col("c"), 10).alias("b")).collect()]
    e = np.linspace(0, 1, 11)
    want = [None if v is None or math.isnan(v) or not 0 <= v <= 1 else min(10, int(np.sum(e[:-1] <= v))) for v in values]
    assert got == want and got[3] == 3 and got[4] == 6 and got[5] == 7


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.0, 0.3, 0.6, 0.7, 1.0, round(rng.random(), 2)]), rng.random() < 0.6, rng.random(), rng.random()) for _ in range(300)]
    rows = [r for r in rows if not 0.2 <= r[0] < 0.3]
    frame = spark.createDataFrame(rows + [(None, True, 0.5, 0.5), (float("nan"), False, 0.5, 0.5)], "confidence double, is_acceptable boolean, cer double, wer double")
    return frame.cache(), rows


def test_bins_and_calibration_metrics(samples):
    frame, rows = samples
    e = N.edges(10)
    got = R.confidence_bins(frame, digits=None).orderBy("bin_index").collect()
    ece = mce = 0.0
    assert len(got) == 10
    for i, g in enumerate(got):
        inside = [r for r in rows if e[i] <= r[0] < e[i + 1] or (i == 9 and r[0] == 1.0)]
        assert g.sample_count == len(inside) and g.bin_range == f"{e[i]:.1f}-{e[i + 1]:.1f}"
        if not inside:
            assert (g.avg_confidence, g.avg_cer, g.acceptable_ocr_percentage) == ((e[i] + e[i + 1]) / 2, 0.0, 0.0)
            continue
        c, y = np.mean([r[0] for r in inside]), np.mean([r[1] for r in inside])
        assert g.avg_confidence == pytest.approx(c) and g.avg_wer == pytest.approx(np.mean([r[3] for r in inside]))
        ece, mce = ece + len(inside) / len(rows) * abs(y - c), max(mce, abs(y - c))
    m = R.calibration_metrics(frame, digits=None).first()
    assert (m.ece, m.mce) == (pytest.approx(ece), pytest.approx(mce))
    assert m.brier_score == pytest.approx(np.mean([(r[0] - r[1]) ** 2 for r in rows]))


def test_metrics_of_nothing(samples):
    frame, _ = samples
    none = frame.limit(0)
    assert R.calibration_metrics(none).first().asDict() == {"ece": 0.0, "mce": 0.0, "brier_score": 0.0}
    assert R.confidence_bins(none).count() == 10 and G.sweep(none).count() == 0


def test_threshold_sweep(samples):
    frame, _ = samples
    rows = [(r.confidence, r.is_acceptable, r.cer, r.wer) for r in frame.collect()]
    taus = [0.9, 0.3, 0.3, 0.0, 1.1, 0.7]
    got = G.sweep(frame, taus, digits=None).collect()
    assert [g.threshold for g in got] == taus
    for g in got:
        high = [r for r in rows if r[0] is not None and r[0] >= g.threshold]
        low = [r for r in rows if not (r[0] is not None and r[0] >= g.threshold)]
        assert (g.high_correct_count, g.high_incorrect_count) == (sum(r[1] for r in high), sum(not r[1] for r in high))
        assert (g.low_correct_count, g.low_incorrect_count) == (sum(r[1] for r in low), sum(not r[1] for r in low))
        assert g.pct_high_confidence == pytest.approx(100 * len(high) / len(rows))
        assert g.high_conf_cer == pytest.approx(np.mean([r[2] for r in high]) if high else 0.0)
        assert g.low_conf_wer == pytest.approx(np.mean([r[3] for r in low]) if low else 0.0)


@pytest.mark.parametrize("method", K.METHODS)
def test_confidence_aggregation(spark, method):
    rows = [([0.8, 0.9, 1.0], [1.0, 1.0, 1.0]), ([0.5, 1.0], [10.0, 90.0]), ([], []), ([None, float("nan")], [1.0, 1.0]), ([1.5, -0.2, None, 0.4], [2.0, 0.0, 9.0, None])]
    got = spark.createDataFrame(rows, "c array<double>, w array<double>").select("c", "w", K.aggregate_confidence(F.col("c"), F.col("w"), method).alias("a")).collect()
    for g in got:
        valid = [(min(1.0, max(0.0, c)), max(0.001, 1.0 if w is None else w)) for c, w in zip(g.c, g.w) if c is not None and not math.isnan(c)]
        if not valid:
            assert g.a is None
            continue
        cs = [c for c, _ in valid]
        want = {"mean": np.mean(cs), "minimum": min(cs), "length_weighted_mean": sum(c * w for c, w in valid) / sum(w for _, w in valid), "geometric_mean": math.exp(np.mean([math.log(max(1e-6, c)) for c in cs]))}[method]
        assert g.a == pytest.approx(want)


POINTS = [(0.2, 0), (0.4, 0), (0.6, 1), (0.8, 1), (0.9, 1)]


def platt(points):
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    a, b = 1.0, 0.0
    for _ in range(300):
        miss = 1 / (1 + np.exp(-(a * x + b))) - y
        a, b = a - 0.1 * np.mean(miss * x), b - 0.1 * np.mean(miss)
    return a, b


def test_platt(spark, monkeypatch):
    frame = spark.createDataFrame(POINTS * 3 + [(None, 1)], "confidence double, label int")
    want = platt(POINTS * 3)
    model = C.fit(frame, " Platt ")
    m = model.first()
    assert (m.method, m.is_fitted) == ("platt", True) and (m.a, m.b) == (pytest.approx(want[0]), pytest.approx(want[1]))
    monkeypatch.setattr(C, "FOLD_POINTS", 2)
    assert C.fit(frame, "platt_scaling").first().a == pytest.approx(want[0])
    got = C.predict(spark.createDataFrame([(0.85,), (None,)], "confidence double"), model).collect()
    assert got[0].calibrated_confidence > 0.5 and got[1].calibrated_confidence is None


def test_isotonic_matches_running_maximum(spark):
    rng = random.Random(1)
    for _ in range(6):
        points = [(rng.choice([0.1, 0.2, 0.35, 0.5, 0.7, 0.9]), int(rng.random() < 0.4)) for _ in range(8)]
        if len({y for _, y in points}) < 2:
            continue
        ordered = sorted(points)
        xs, ys = [p[0] for p in ordered], np.maximum.accumulate([p[1] for p in ordered])
        grid = [0.0, 0.1, 0.15, 0.2, 0.3, 0.5, 0.6, 0.85, 1.0]
        frame = spark.createDataFrame(points, "confidence double, label int")
        got = C.predict(spark.createDataFrame([(g,) for g in grid], "confidence double").coalesce(1), C.fit(frame)).collect()
        first = min(x for x, y in points if y)
        for g in got:
            want = 1.0 if g.confidence >= first else float(np.interp(g.confidence, xs, ys))
            assert g.calibrated_confidence == pytest.approx(want), (points, g)


def test_unfitted_calibrators_pass_confidences_through(spark):
    for points, method in (([(0.3, 1), (0.4, 1)], "platt"), ([(0.3, 1)], "isotonic"), (POINTS, "nonsense")):
        model = C.fit(spark.createDataFrame(points, "confidence double, label int"), method)
        assert not model.first().is_fitted
        assert C.predict(spark.createDataFrame([(1.7,)], "confidence double"), model).first().calibrated_confidence == 1.7


def lines_of(boxes):
    centres = sorted(((sum(p[1] for p in b) / len(b), i, b) for i, b in boxes), key=lambda t: (t[0], t[1]))
    heights = sorted(max(p[1] for p in b) - min(p[1] for p in b) for _, _, b in centres)
    gap, out = max(15, 0.6 * heights[len(heights) // 2]), [[centres[0]]]
    for c in centres[1:]:
        if abs(c[0] - out[-1][-1][0]) <= gap:
            out[-1].append(c)
        else:
            out.append([c])
    return [[i for _, i, _ in sorted(line, key=lambda t: min(p[0] for p in t[2]))] for line in out]


def test_line_clusters(spark):
    rng = random.Random(9)
    pages = {}
    for page in range(30):
        pages[page] = []
        for i in range(rng.randint(1, 14)):
            x, y, h = rng.randint(0, 500), rng.randint(0, 200), rng.randint(10, 60)
            pages[page].append((i, [[x, y], [x + 40, y + 1], [x + 40, y + h], [x, y + h]]))
    frame = spark.createDataFrame([(p, i, b) for p, bs in pages.items() for i, b in bs], "page int, box_index int, bbox array<array<int>>")
    lined = L.line_clusters(L.boxes_of(frame))
    got = {}
    for r in lined.orderBy("page", "line_index", "position").collect():
        got.setdefault(r.page, {}).setdefault(r.line_index, []).append(r.box_index)
    for page, boxes in pages.items():
        assert list(got[page].values()) == lines_of(boxes)
    one = L.line_boxes(lined).where("page = 0 and line_index = 0").first()
    members = got[0][0]
    xs = [p[0] for i, b in pages[0] if i in members for p in b]
    assert (one.x_min, one.x_max) == (max(0, min(xs) - 8), max(xs) + 8)


def test_geometry(spark):
    sizes = [(4000, 1000), (300, 500), (2048, 100), (1000, 1000), (1, 5000)]
    got = spark.createDataFrame(sizes, "w int, h int").select("w", "h", N.resized(F.col("w"), F.col("h")).alias("r")).collect()
    for g in got:
        big, small = max(g.w, g.h), min(g.w, g.h)
        s = 2048 / big if big > 2048 else 600 / small if small < 600 and big < 2048 else None
        want = (g.w, g.h) if s is None else (max(1, int(g.w * s)), max(1, int(g.h * s)))
        assert (g.r.width, g.r.height) == want
    row = spark.range(1).select(N.page_coordinates(F.array(F.array(F.lit(10.9), F.lit(-3.2))), F.lit(2.0)).alias("p"), N.upper_median(F.array(*[F.lit(x) for x in (4, 1, 3, 2)])).alias("m"), N.fused_confidence(F.lit(0.0), F.lit(None).cast("double")).alias("f"), N.mean_step_probability(F.array().cast("array<double>")).alias("s")).first()
    assert row.p == [[5, -1]] and row.m == 3 and row.s == 0.85 and row.f == pytest.approx(0.75 * 0.92 + 0.25 * (0.88 + 0.12 * 0.85))


def kappa(x, y):
    x, y = [round(v) for v in x], [round(v) for v in y]
    n = len(x)
    seen = sum((a - b) ** 2 for a, b in zip(x, y)) / n
    return 1 - seen / (sum((a - b) ** 2 for a in x for b in y) / n**2)


def test_agreement(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 20) / 2, rng.randint(0, 20) / 2) for _ in range(50)]
    got = A.agreement(spark.createDataFrame(rows + [(None, 1.0)], "a double, b double"), [("p", "a", "b")]).first()
    x, y = np.array(rows).T
    assert got.n == 50 and got.mae == pytest.approx(np.mean(abs(x - y))) and got.pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got.qwk == pytest.approx(kappa(x, y)) and got.within_one_pct == pytest.approx(100 * np.mean(abs(x - y) <= 1))


def test_caps_bands_and_sums(spark):
    row = spark.createDataFrame([(7.0, "Letter_Missing_Layout"), (7.0, "None"), (1.0, "Letter_Missing_Layout"), (7.0, None)], "t double, r string").select(A.capped(F.col("t"), F.col("r")).alias("c")).collect()
    assert [r.c for r in row] == [2.0, 7.0, 1.0, 7.0]
    bands = spark.createDataFrame([(m,) for m in (0.0, 3.9, 4.0, 5.9, 6.0, 8.0, None)], "m double").select(A.band(F.col("m"), F.lit(10.0)).alias("b")).collect()
    assert [b.b for b in bands] == [0, 1, 2, 2, 3, 4, None]
    one = spark.range(1).select(A.sum_check(F.lit(3.0), F.lit(1.5), F.lit(1.5), F.lit(None)).alias("s"), A.evaluation_id(F.lit("T"), F.lit("g")).alias("e"), A.relative_reduction(F.lit(10.2972), F.lit(10.2931)).alias("r")).first()
    assert one.s and one.e == "T__g" and round(one.r, 2) == 0.04
    frame = spark.createDataFrame([("Band 2", "Band 3"), ("Band 1", "Band 1"), ("Band 0", "Band 4")], "a string, b string")
    assert [round(v, 2) for v in A.band_agreement(frame, "a", "b").first()] == [33.33, 66.67]


def test_confusion_of_published_counts(spark):
    rows = [(True, True)] * 4 + [(False, True)] * 20 + [(True, False)] * 16 + [(False, False)] * 101
    got = A.confusion(spark.createDataFrame(rows, "t boolean, p boolean"), "t", "p").first()
    assert (got.tp, got.fp, got.fn, got.tn) == (4, 20, 16, 101)
    assert [round(v, 4) for v in (got.precision, got.recall, got.f1, got.accuracy)] == [0.1667, 0.2, 0.1818, 0.7447]


def test_joins_refuse_keys_that_repeat(spark):
    evals = spark.createDataFrame([("t1", "s1"), ("t1", "s2")], "task_id string, script_id string")
    marks = spark.createDataFrame([("t1", "s1", 4.0), ("t1", "s2", 5.0)], "task_id string, script_id string, mark double")
    assert A.join_marks(evals, marks).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        M.join_truth(evals, marks, "task_id")
