import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import text as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rate(h, r):
    return (0.0 if not h else 1.0) if not r else distance(h, r) / len(r)


def cer_form(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).lower()).strip()


def wer_form(t):
    return re.sub(r"[^\w\s]", "", unicodedata.normalize("NFC", t).lower()).split()


PAIRS = [
    ("cat", "hat"), ("", ""), ("x", ""), ("", "abc"), ("the quick brown fox", "the quick brown dog"), ("Hello  World", "hello world"),
    ("a, b. c!", "a b c"), ("été", "été"), ("a b　c", "a b c"), ("কা খ", "ক খ"), ("\r\nx\x1cy", "x y"), ("Same", "Same"),
]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    words = ["the", "cat", "é", "naïve", "x_1", "don't", "  ", "\t", "ing.", "A"]
    rows = PAIRS + [(" ".join(rng.choices(words, k=rng.randint(0, 12))), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(60)]
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)], "id int, h string, r string").cache()


def test_error_rates_match_brute_force(frame):
    rows = frame.withColumn("nh", T.nfc(F.col("h"))).withColumn("nr", T.nfc(F.col("r"))).select(
        "h", "r", T.cer(F.col("h"), F.col("r")).alias("c"), T.wer(F.col("h"), F.col("r")).alias("w"),
        T.cer(F.col("h"), F.col("r"), normalize=True).alias("nc"), T.wer(F.col("nh"), F.col("nr"), normalize=True).alias("nw")).collect()
    for x in rows:
        assert x.c == pytest.approx(rate(x.h, x.r)), x
        assert x.w == pytest.approx(rate(x.h.split(), x.r.split())), x
        assert x.nc == pytest.approx(rate(cer_form(x.h), cer_form(x.r))), x
        assert x.nw == pytest.approx(rate(wer_form(x.h), wer_form(x.r))), x


def test_null_texts_count_as_empty(spark):
    row = spark.createDataFrame([(None, "x")], "h string, r string").select(T.cer(F.col("h"), F.col("r")).alias("c"), T.cer(F.col("h"), F.col("r"), normalize=True).alias("n"), T.derived_confidence(F.col("h")).alias("d")).first()
    assert (row.c, row.n, row.d) == (1.0, 1.0, None)


def test_safe_normalize(spark):
    given = "  Hello   World \r\n  é  line\t two \rX\n\n"
    got = spark.createDataFrame([(given,), (None,)], "t string").select(T.safe_normalize(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["Hello World\né line two\nX", ""]


def plausibility(text):
    tokens = text.split()
    if not tokens:
        return None
    clean = [c for c in (re.sub(r"[^\w]", "", t).lower() for t in tokens) if c]
    ok = sum(c in T.VOCABULARY or len(c) <= 2 or c.endswith(("ing", "ed", "ly", "s", "tion")) for c in clean)
    noise = sum(any(c in "^~`|{}[]<>\\" for c in t) for t in tokens)
    n, mean = len(tokens), sum(map(len, tokens)) / len(tokens)
    score = 0.99 - 0.1 * (1 - ok / max(1, len(clean))) - 0.5 * noise / n - 0.15 * (1 - len(clean) / n) - (0.2 if mean > 15 or mean < 2 else 0)
    score -= 0.3 if n > 10 and max(tokens.count(t) for t in set(tokens)) / n > 0.35 else 0
    return max(0.05, min(0.99, score))


def test_derived_confidence(spark):
    texts = ["The student will write an answer about technology.", "~~ ^^ || {} [] <> \\\\ ``", "", "   ", "a a a a a a a a a a a b", "x", "Supercalifragilisticexpialidocious", "... !!", "nothing matches here whatsoever", "কা"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.derived_confidence(F.col("t"), digits=None).alias("c")).collect()
    for x in got:
        want = plausibility(x.t)
        assert (x.c is None and want is None) or x.c == pytest.approx(want), x
    assert got[0].c > 0.6 and got[0].c > got[1].c


def test_word_distance_of_many_distinct_tokens(spark):
    row = spark.range(1).select(T.word_distance(F.transform(F.sequence(F.lit(1), F.lit(40000)), lambda i: i.cast("string")), F.array(F.lit("7"), F.lit("39999"), F.lit("x"))).alias("d"))
    assert row.first()["d"] == 39998
    two = spark.range(1).select(T.word_distance(F.split(F.lit("a b c d 𐐀"), " "), F.split(F.lit("b c x d 𐐁"), " ")).alias("d"))
    assert two.first()["d"] == 3


def test_only_non_ascii_texts_reach_python(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(T.nfc(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" in plan
