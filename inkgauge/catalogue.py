"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge import fixtures as X
from inkgauge.functions import numeric as N
from inkgauge.functions import text as T
from inkgauge.operators import agreement as A
from inkgauge.operators import calibration as C
from inkgauge.operators import confidence as K
from inkgauge.operators import layout as L
from inkgauge.operators import metrics as M
from inkgauge.operators import reliability as R
from inkgauge.operators import routing as G
from inkgauge.operators import validation as V
from inkgauge.sources import backends as B
from inkgauge.sources import readers as S
from inkgauge.streaming.monitor import windowed_bins

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from inkgauge import roundtrips  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from inkgauge import roundtrips  # noqa: F401

    return dict(_SQL)


def r8(c, name: str):
    return F.round(c, 8).alias(name)


# --- error rates and the benchmark -------------------------------------------------------------------------------------


@query(f"WITH {X.PAIRS_SQL} SELECT script_id, round(raw_cer, 8) AS raw_cer, round(normalized_cer, 8) AS normalized_cer FROM samples")
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyp, ref = F.col("hyp"), F.col("ref")
    return X.pairs(spark, sf_dir).select("script_id", r8(T.cer(hyp, ref), "raw_cer"), r8(T.cer(hyp, ref, normalize=True), "normalized_cer"))


@query(f"WITH {X.PAIRS_SQL} SELECT script_id, round(raw_wer, 8) AS raw_wer, round(normalized_wer, 8) AS normalized_wer FROM samples")
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyp, ref = F.col("hyp"), F.col("ref")
    rows = X.pairs(spark, sf_dir).select("script_id", "hyp", "ref", T.nfc(hyp).alias("h"), T.nfc(ref).alias("r"))
    return rows.select("script_id", r8(T.wer(hyp, ref), "raw_wer"), r8(T.wer(F.col("h"), F.col("r"), normalize=True), "normalized_wer"))


def _benchmark(spark: SparkSession, sf_dir: str, digits: int | None) -> DataFrame:
    rows = X.pairs(spark, sf_dir).select("script_id", F.col("hyp").alias("raw_ocr_text"), F.col("ref").alias("ground_truth_text"), "confidence")
    return M.benchmark_rows(rows, digits=digits)


@query(f"""WITH {X.PAIRS_SQL} SELECT script_id::VARCHAR AS script_id, hyp AS raw_ocr_text, ref AS ground_truth_text, confidence, true AS confidence_available,
  round(raw_cer, 8) AS raw_cer, round(normalized_cer, 8) AS normalized_cer, round(raw_wer, 8) AS raw_wer, round(normalized_wer, 8) AS normalized_wer, is_acceptable FROM samples""")
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir, 8).select(
        "script_id", "raw_ocr_text", "ground_truth_text", "confidence", "confidence_available", "raw_cer", "normalized_cer", "raw_wer", "normalized_wer", "is_acceptable")


@query(f"""WITH {X.PAIRS_SQL}, r AS (SELECT confidence, is_acceptable, round(raw_cer, 8) AS raw_cer, round(normalized_cer, 8) AS c, round(raw_wer, 8) AS raw_wer, round(normalized_wer, 8) AS w FROM samples)
SELECT count(*) AS total_samples, round(avg(raw_cer), 4) AS mean_raw_cer, round(avg(c), 4) AS mean_normalized_cer, round(avg(raw_wer), 4) AS mean_raw_wer, round(avg(w), 4) AS mean_normalized_wer,
  round((1 - least(1, avg(c))) * 100, 2) AS character_accuracy_percentage, round((1 - least(1, avg(w))) * 100, 2) AS word_accuracy_percentage,
  round(avg(confidence), 4) AS mean_confidence, round(avg(is_acceptable::INT) * 100, 2) AS acceptable_ocr_percentage FROM r""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summarize(_benchmark(spark, sf_dir, 8))


# --- text --------------------------------------------------------------------------------------------------------------


@query(f"WITH {X.DOCUMENT_ESTIMATE_SQL} SELECT key AS doc_id, round(score, 8) AS confidence FROM est")
def derived_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_derived_confidence(X.table(spark, sf_dir, "documents").select("doc_id", "text"), digits=None).select("doc_id", r8(F.col("confidence"), "confidence"))


@query(f"WITH {X.DOCUMENT_ESTIMATE_SQL} SELECT key AS doc_id, n AS n_tokens, coalesce(best, 0) AS largest_repeat FROM est")
def token_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("doc_id", T.split_words(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), T.largest_repeat(F.col("t")).cast("long").alias("largest_repeat"))


_STRIP = r"'^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g'"


@query(rf"""SELECT doc_id, length(t) AS length, sha256(t) AS digest FROM (
  SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(replace(replace(nfc_normalize(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
    lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), {_STRIP})), chr(10)), {_STRIP}) AS t FROM documents)""")
def safe_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.table(spark, sf_dir, "documents").select("doc_id", T.safe_normalize(F.col("text")).alias("t"))
    return text.select("doc_id", F.char_length("t").cast("long").alias("length"), F.sha2("t", 256).alias("digest"))


@query(rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'), {_STRIP})) AS cer_digest,
  len(w) AS n_words, sha256(array_to_string(w, ' ')) AS wer_digest FROM (
  SELECT doc_id, t, list_filter(regexp_split_to_array(regexp_replace(t, '[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]', '', 'g'), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, lower(nfc_normalize(coalesce(text, ''))) AS t FROM documents))""")
def metric_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "documents").select("doc_id", T.nfc(F.coalesce("text", F.lit(""))).alias("t"))
    rows = rows.select("doc_id", T.normalize_for_cer(F.col("t"), composed=True).alias("c"), T.normalize_for_wer(F.col("t"), composed=True).alias("w"))
    return rows.select("doc_id", F.sha2("c", 256).alias("cer_digest"), F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("wer_digest"))


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select(V.content_hash(F.coalesce("text", F.lit(""))).alias("digest"))
    return V.duplicate_hashes(docs, "digest")


@query("""SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE trim(text) <> '') AS text FROM conversations GROUP BY conv_id""")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.joined_text(X.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# --- reliability, routing, calibration ----------------------------------------------------------------------------------

_BINS = """, e AS (SELECT i, CASE i WHEN 10 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 10) END AS lo FROM range(0, 11) t(i)),
spine AS (SELECT a.i + 1 AS bin_index, a.lo, b.lo AS hi FROM e a JOIN e b ON b.i = a.i + 1),
placed AS (SELECT bin_index, s.* FROM spine JOIN samples s ON s.confidence >= lo AND (s.confidence < hi OR (bin_index = 10 AND s.confidence <= 1)))
"""
_BIN_ROWS = """ SELECT spine.bin_index::INT AS bin_index, printf('%.1f-%.1f', lo, hi) AS bin_range, count(p.bin_index) AS sample_count,
  round(coalesce(avg(p.confidence), (lo + hi) / 2), 8) AS avg_confidence, CER AS avg_cer, WER AS avg_wer,
  round(coalesce(avg(p.is_acceptable::INT), 0) * 100, 8) AS acceptable_ocr_percentage
FROM spine LEFT JOIN placed p ON p.bin_index = spine.bin_index GROUP BY spine.bin_index, lo, hi"""
_ECE = """ SELECT round(coalesce(sum(n * gap) / (SELECT count(*) FROM samples WHERE confidence IS NOT NULL), 0), 8) AS ece, round(coalesce(max(gap), 0), 8) AS mce,
  round(coalesce((SELECT avg(pow(confidence - is_acceptable::INT, 2)) FROM samples), 0), 8) AS brier_score
FROM (SELECT bin_index, count(*) AS n, abs(avg(is_acceptable::INT) - avg(confidence)) AS gap FROM placed GROUP BY bin_index)"""
_MEANS = {"CER": "round(coalesce(avg(p.normalized_cer), 0), 8)", "WER": "round(coalesce(avg(p.normalized_wer), 0), 8)"}


@query(f"WITH {X.PAIRS_SQL} {_BINS}" + _BIN_ROWS.replace("CER", _MEANS["CER"]).replace("WER", _MEANS["WER"]))
def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.confidence_bins(X.samples(spark, sf_dir), digits=(8, 8))


@query(f"WITH {X.PAIRS_SQL} {_BINS}{_ECE}")
def calibration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.calibration_metrics(X.samples(spark, sf_dir), digits=8)


@query(f"WITH {X.LABELLED_SQL} {_BINS}" + _BIN_ROWS.replace("CER", "0.0::DOUBLE").replace("WER", "0.0::DOUBLE"))
def confidence_bins_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.confidence_bins(X.labelled(spark, sf_dir), digits=(8, 8))


@query(f"WITH {X.LABELLED_SQL} {_BINS}{_ECE}")
def calibration_metrics_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.calibration_metrics(X.labelled(spark, sf_dir), digits=8)


_TAUS = ", ".join(f"({t}::DOUBLE)" for t in G.THRESHOLDS)


@query(f"""WITH {X.PAIRS_SQL}, tau(threshold) AS (VALUES {_TAUS}), s AS (SELECT *, confidence >= threshold AS hi FROM samples, tau)
SELECT threshold, round(avg(hi::INT) * 100, 8) AS pct_high_confidence, round(100 - avg(hi::INT) * 100, 8) AS pct_low_confidence,
  round(coalesce(avg(normalized_cer) FILTER (WHERE hi), 0), 8) AS high_conf_cer, round(coalesce(avg(normalized_wer) FILTER (WHERE hi), 0), 8) AS high_conf_wer,
  round(coalesce(avg(is_acceptable::INT) FILTER (WHERE hi), 0) * 100, 8) AS high_conf_acceptable_rate,
  round(coalesce(avg(normalized_cer) FILTER (WHERE NOT hi), 0), 8) AS low_conf_cer, round(coalesce(avg(normalized_wer) FILTER (WHERE NOT hi), 0), 8) AS low_conf_wer,
  round(coalesce(avg(is_acceptable::INT) FILTER (WHERE NOT hi), 0) * 100, 8) AS low_conf_acceptable_rate,
  count(*) FILTER (WHERE hi AND is_acceptable) AS high_correct_count, count(*) FILTER (WHERE hi AND NOT is_acceptable) AS high_incorrect_count,
  count(*) FILTER (WHERE NOT hi AND is_acceptable) AS low_correct_count, count(*) FILTER (WHERE NOT hi AND NOT is_acceptable) AS low_incorrect_count
FROM s GROUP BY threshold""")
def routing_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sweep(X.samples(spark, sf_dir), digits=(8, 8))


_PLATT = """, stats AS (SELECT confidence AS c, count(*) AS n, sum(is_acceptable::INT) AS s FROM samples GROUP BY 1),
steps(i, a, b) AS (
  SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, a - 0.1::DOUBLE * ga, b - 0.1::DOUBLE * gb FROM (
    SELECT i, a, b, sum((n / (1 + exp(-(a * c + b))) - s) * c) / sum(n) AS ga, sum(n / (1 + exp(-(a * c + b))) - s) / sum(n) AS gb
    FROM steps, stats WHERE i < 300 GROUP BY i, a, b)),
model AS (SELECT a, b FROM steps WHERE i = 300)
"""


@query(f"WITH RECURSIVE {X.PAIRS_SQL} {_PLATT} SELECT 'platt' AS method, true AS is_fitted, round(a, 6) AS a, round(b, 6) AS b FROM model")
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = C.fit(X.samples(spark, sf_dir).withColumnRenamed("is_acceptable", "label"), "platt")
    return model.select("method", "is_fitted", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"WITH RECURSIVE {X.PAIRS_SQL} {_PLATT} SELECT script_id::VARCHAR AS script_id, round(1 / (1 + exp(-(a * confidence + b))), 6) AS calibrated_confidence FROM samples, model")
def platt_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.samples(spark, sf_dir)
    out = C.predict(s, C.fit(s.withColumnRenamed("is_acceptable", "label"), "platt"))
    return out.select("script_id", F.round("calibrated_confidence", 6).alias("calibrated_confidence"))


_KNOTS = """, first AS (SELECT min(confidence) AS b FROM samples WHERE is_acceptable),
knots AS (SELECT b, (SELECT max(confidence) FROM samples, first WHERE NOT is_acceptable AND confidence <= b) AS a FROM first)
"""


@query(f"WITH {X.PAIRS_SQL} {_KNOTS} SELECT a AS first_knot, b AS last_knot FROM knots")
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = C.fit(X.samples(spark, sf_dir).withColumnRenamed("is_acceptable", "label"))
    return model.select(F.when(F.size("x_knots") > 1, F.get("x_knots", F.lit(0))).alias("first_knot"), F.element_at("x_knots", -1).alias("last_knot"))


@query(f"""WITH {X.LABELLED_SQL} {_KNOTS} SELECT doc_id, round(CASE WHEN confidence >= b OR a IS NULL THEN 1.0 WHEN confidence < a THEN 0.0 ELSE (confidence - a) / (b - a) END, 8) AS calibrated_confidence
FROM samples, knots""")
def isotonic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.labelled(spark, sf_dir)
    out = C.predict(s, C.fit(s.withColumnRenamed("is_acceptable", "label")))
    return out.select("doc_id", r8(F.col("calibrated_confidence"), "calibrated_confidence"))


@query("""SELECT date_trunc('day', ts) + INTERVAL (10 * (extract('hour' FROM ts) * 6 + extract('minute' FROM ts) // 10)) MINUTE AS started,
  (1 + floor(floor(value % 1 * 4) / 4 * 10))::INT AS bin_index, count(*) AS n, round(sum(floor(value % 1 * 4) / 4), 6) AS confidence, sum((event_type = 'click')::INT) AS acceptable
FROM events GROUP BY 1, 2""")
def windowed_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").select(
        F.col("ts").alias("event_time"), (F.floor(F.col("value") % 1 * 4) / 4).alias("confidence"), (F.col("event_type") == "click").alias("is_acceptable"), F.lit(0.0).alias("cer"), F.lit(0.0).alias("wer"))
    return windowed_bins(rows).select(F.col("window.start").alias("started"), "bin_index", "n", F.round("confidence", 6).alias("confidence"), "acceptable")


# --- confidence of records ----------------------------------------------------------------------------------------------

_SEGMENTS = X.TURN_ESTIMATE_SQL + """, seg AS (
  SELECT conv_id, greatest(0, least(1, score)) AS c, greatest(0.001, length(text)) AS w FROM conversations JOIN est ON key = conv_id::VARCHAR || ':' || turn::VARCHAR WHERE score IS NOT NULL)
SELECT conv_id, round(avg(c), 8) AS mean, round(min(c), 8) AS minimum, round(sum(c * w) / sum(w), 8) AS length_weighted_mean, round(exp(avg(ln(greatest(1e-6, c)))), 8) AS geometric_mean
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN seg USING (conv_id) GROUP BY conv_id"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.derived_confidence(F.col("text"), digits=None).alias("c"), F.char_length("text").cast("double").alias("w"))


@query(f"WITH {_SEGMENTS}")
def segment_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four aggregates over a row per segment."""
    found = K.confidence_aggregates(F.col("c"), F.col("w"))
    return _segments(spark, sf_dir).groupBy("conv_id").agg(*[F.round(v, 8).alias(k) for k, v in found.items()])


@query(f"WITH {_SEGMENTS}")
def segment_confidence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a record's array of segments."""
    records = _segments(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "c", "w"))).alias("s"))
    return records.select("conv_id", *[F.round(K.aggregate_confidence(F.col("s.c"), F.col("s.w"), m), 8).alias(m) for m in K.METHODS])


@query("""SELECT event_id, round(greatest(0.1, least(0.99, 0.75 * CASE WHEN x = 0 THEN 0.92 ELSE x END + 0.25 * (0.88 + 0.12 * p))), 8) AS fused,
  round((0.2 + x) / 2, 8) AS mean_probability
FROM (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS x, (event_id % 7) / 7.0::DOUBLE AS p FROM events)""")
def fused_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 11) / 10.0).alias("x"), ((F.col("event_id") % 7) / 7.0).alias("p"))
    return e.select("event_id", r8(N.fused_confidence(F.col("x"), F.col("p")), "fused"), r8(N.mean_step_probability(F.array(F.lit(0.2), F.col("x"))), "mean_probability"))


@query("""SELECT conv_id || ':' || turn AS script_id, 'mock' AS backend, 0.5::DOUBLE AS confidence, 'raw' AS confidence_type, 11 AS text_length, 2 AS n_segments,
  'One.' || chr(10) || 'Two' || chr(10) || 'x y' AS normalized_text FROM conversations""".replace("11 AS", "12 AS").replace("2 AS n", "3 AS n"))
def mock_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = X.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("script_id"))
    return B.flat(B.backend("Test", mock_text="One.\nTwo\nx   y", mock_confidence=0.5)(images)).select("script_id", "backend", "confidence", "confidence_type", "text_length", "n_segments", "normalized_text")


@query(f"""WITH {X.TURN_ESTIMATE_SQL}, seg AS (
  SELECT conv_id, turn, trim(text) AS t, score AS c, length(trim(text)) AS w FROM conversations JOIN est ON key = conv_id::VARCHAR || ':' || turn::VARCHAR WHERE trim(text) <> '')
SELECT conv_id::VARCHAR AS script_id, sha256(string_agg(t, ' ' ORDER BY turn)) AS raw_digest, count(*) AS n_segments, round(sum(c * greatest(0.001, w)) / sum(greatest(0.001, w)), 4) AS confidence FROM seg GROUP BY conv_id""")
def recognised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records assembled from detected segments, as after a backend's inference."""
    turns = X.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "text", T.derived_confidence(F.col("text"), digits=None).alias("confidence"), F.lit(None).cast("array<array<int>>").alias("bbox")).alias("s"))
    images = turns.groupBy(F.col("conv_id").cast("string").alias("script_id")).agg(F.array_sort(F.collect_list("s")).alias("segments"))
    records = B.recognised(images, backend="easyocr", model="detector", segments=F.col("segments"))
    return records.select("script_id", F.sha2("ocr.raw_text", 256).alias("raw_digest"), F.size("ocr.segments").cast("long").alias("n_segments"), F.col("ocr.confidence").alias("confidence"))


@query("""SELECT c_mktsegment AS name, CASE trim(lower(c_mktsegment)) WHEN 'trocr' THEN 'trocr' WHEN 'mock' THEN 'mock' ELSE 'infinite' END AS backend, count(*) AS n FROM (
  SELECT CASE c_custkey % 4 WHEN 0 THEN ' TrOCR ' WHEN 1 THEN 'MOCK' WHEN 2 THEN 'qwen' ELSE c_mktsegment END AS c_mktsegment FROM customer) GROUP BY 1, 2""")
def backend_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    names = X.table(spark, sf_dir, "customer").select(F.when(k == 0, " TrOCR ").when(k == 1, "MOCK").when(k == 2, "qwen").otherwise(F.col("c_mktsegment")).alias("name"))
    return names.groupBy("name", B.canonical_column(F.col("name")).alias("backend")).agg(F.count("*").alias("n"))


# --- layout and geometry ------------------------------------------------------------------------------------------------

_BOXES = """boxes AS (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box_index, l_linenumber * 20 + l_partkey % 25 AS y_center, 18 + l_suppkey % 9 AS height, l_partkey % 900 AS x_min FROM lineitem),
gaps AS (SELECT page AS gap_page, greatest(15.0, 0.6 * list_sort(list(height))[count(*) // 2 + 1]) AS gap FROM boxes GROUP BY page),
flags AS (SELECT boxes.*, gap, CASE WHEN abs(y_center - lag(y_center) OVER (PARTITION BY page ORDER BY y_center, box_index)) > gap THEN 1 ELSE 0 END AS f FROM boxes JOIN gaps ON page = gap_page),
lined AS (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY y_center, box_index) AS line_index FROM flags)
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = X.table(spark, sf_dir, "lineitem").withColumn("box_index", F.row_number().over(order))
    x, y, h = F.col("l_partkey") % 900, F.col("l_linenumber") * 20 + F.col("l_partkey") % 25, 18 + F.col("l_suppkey") % 9
    # Corners: centre y +- half the height.
    top, bottom = y - h / 2, y + h / 2
    corners = F.array(F.array(x.cast("double"), top), F.array(x + 80.0, top), F.array(x + 80.0, bottom), F.array(x.cast("double"), bottom))
    return L.boxes_of(rows.select(F.col("l_orderkey").alias("page"), "box_index", corners.alias("bbox")))


@query(f"WITH {_BOXES} SELECT page, box_index, line_index, row_number() OVER (PARTITION BY page, line_index ORDER BY x_min, y_center, box_index) AS position FROM lined")
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_clusters(_boxes(spark, sf_dir)).select("page", "box_index", "line_index", "position")


@query(f"""WITH {_BOXES} SELECT page, line_index, count(*) AS n_boxes, greatest(0, min(x_min) - 8)::DOUBLE AS x_min, greatest(0, min(y_center - height / 2) - 8)::DOUBLE AS y_min,
  (max(x_min) + 88)::DOUBLE AS x_max, (max(y_center + height / 2) + 8)::DOUBLE AS y_max FROM lined GROUP BY page, line_index""")
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_boxes(L.line_clusters(_boxes(spark, sf_dir)))


@query("""SELECT p_partkey, width, height, CASE WHEN s IS NULL THEN width ELSE greatest(1, trunc(width * s))::INT END AS new_width, CASE WHEN s IS NULL THEN height ELSE greatest(1, trunc(height * s))::INT END AS new_height,
  round(CASE WHEN greatest(width, height) > 1280 THEN 1280.0::DOUBLE / greatest(width, height) ELSE 1.0 END, 8) AS scale FROM (
  SELECT *, CASE WHEN greatest(width, height) > 2048 THEN 2048::DOUBLE / greatest(width, height) WHEN least(width, height) < 600 AND greatest(width, height) < 2048 THEN 600::DOUBLE / least(width, height) END AS s
  FROM (SELECT p_partkey, (1 + p_partkey * 37 % 4000)::INT AS width, (1 + p_size * 53)::INT AS height FROM part))""")
def resize_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_partkey") * 37 % 4000).cast("int").alias("width"), (1 + F.col("p_size") * 53).cast("int").alias("height"))
    out = p.withColumn("r", N.resized(F.col("width"), F.col("height")))
    return out.select("p_partkey", "width", "height", F.col("r.width").alias("new_width"), F.col("r.height").alias("new_height"), r8(N.detection_scale(F.col("width"), F.col("height")), "scale"))


@query("""SELECT s_suppkey, page, CASE WHEN n = 1 THEN s_name || '.png' ELSE printf('%s_p%02d.png', s_name, page) END AS file_name
FROM (SELECT s_suppkey, s_name, n, unnest(generate_series(1, n))::INT AS page FROM (SELECT s_suppkey, s_name, (s_suppkey % 4)::INT AS n FROM supplier))""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("stem"), (F.col("s_suppkey") % 4).alias("n_pages"))
    return S.page_names(files).select("s_suppkey", "page", "file_name")


@query("SELECT path FROM (SELECT 'scans/' || s_name || CASE s_suppkey % 2 WHEN 0 THEN '.PDF' ELSE '.png' END AS path FROM supplier) WHERE lower(path) LIKE '%.pdf' ORDER BY path LIMIT 25")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document files by path, the first 25: the listing operator's own top."""
    files = X.table(spark, sf_dir, "supplier").select(F.concat(F.lit("scans/"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, ".PDF").otherwise(".png")).alias("path"))
    return S.first_paths(S.documents_else_all(files), 25)


# --- marks --------------------------------------------------------------------------------------------------------------

_MARKS = "marks AS (SELECT o_orderkey AS id, o_orderpriority AS subject, 10.0::DOUBLE AS full_marks, (o_orderkey % 21) / 2.0::DOUBLE AS gold, (o_custkey % 21) / 2.0::DOUBLE AS a, (o_custkey % 17) / 2.0::DOUBLE AS b FROM orders)"


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda c, n: F.col(c) % n / 2.0
    return X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"), F.lit(10.0).alias("full_marks"), half("o_orderkey", 21).alias("gold_score"), half("o_custkey", 21).alias("a"), half("o_custkey", 17).alias("b"))


def _pair_sql(name: str, x: str, y: str) -> str:
    rx, ry = f"round_even({x}, 0)", f"round_even({y}, 0)"
    return f"""SELECT '{name}' AS comparison, count(*) AS n, round(avg(abs({x} - {y})), 8) AS mae, round(sqrt(avg(({x} - {y}) * ({x} - {y}))), 8) AS rmse, round(corr({x}, {y}), 8) AS pearson_r,
  round(1 - avg(({rx} - {ry}) * ({rx} - {ry})) / (avg({rx} * {rx}) + avg({ry} * {ry}) - 2 * avg({rx}) * avg({ry})), 8) AS qwk,
  round(100 * avg(({x} = {y})::INT), 8) AS exact_pct, round(100 * avg((abs({x} - {y}) <= 1)::INT), 8) AS within_one_pct FROM marks"""


@query(f"WITH {_MARKS} {_pair_sql('a vs gold', 'a', 'gold')} UNION ALL {_pair_sql('b vs gold', 'b', 'gold')} UNION ALL {_pair_sql('a vs b', 'a', 'b')}")
def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.agreement(_marks(spark, sf_dir), [("a vs gold", "a", "gold_score"), ("b vs gold", "b", "gold_score"), ("a vs b", "a", "b")])
    return out.select("comparison", "n", *[r8(F.col(c), c) for c in ("mae", "rmse", "pearson_r", "qwk", "exact_pct", "within_one_pct")])


@query("""SELECT tp, fp, fn, tn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy
FROM (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn
  FROM (SELECT l_tax > 0.05 AS t, l_returnflag = 'R' AS p FROM lineitem))""")
def cap_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").select((F.col("l_tax") > 0.05).alias("t"), (F.col("l_returnflag") == "R").alias("p"))
    return A.confusion(rows, "t", "p").select("tp", "fp", "fn", "tn", *[r8(F.col(c), c) for c in ("precision", "recall", "f1", "accuracy")])


_BAND = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} / 10 < 0.4 THEN 1 WHEN {0} / 10 < 0.6 THEN 2 WHEN {0} / 10 < 0.8 THEN 3 ELSE 4 END"


@query(f"WITH {_MARKS} SELECT round(100 * avg((x = y)::INT), 8) AS exact_pct, round(100 * avg((abs(x - y) <= 1)::INT), 8) AS adjacent_pct FROM (SELECT {_BAND.format('gold')} AS x, {_BAND.format('a')} AS y FROM marks)")
def band_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marks(spark, sf_dir).select(A.band(F.col("gold_score"), F.col("full_marks")).alias("x"), F.concat(F.lit("Band "), A.band(F.col("a"), F.col("full_marks"))).alias("y"))
    return A.band_agreement(rows, "x", "y").select(r8(F.col("exact_pct"), "exact_pct"), r8(F.col("adjacent_pct"), "adjacent_pct"))


@query(f"""WITH {_MARKS}, v AS (SELECT subject, full_marks, abs(gold - mark) AS err, variant FROM marks UNPIVOT (mark FOR variant IN (a, b)))
SELECT CASE WHEN grouping(subject) = 1 THEN 'ALL' ELSE subject END AS subject, variant, count(*) AS n, round(avg((err = 0)::INT), 8) AS exact_agreement, round(avg((err <= 0.5)::INT), 8) AS within_half,
  round(avg(err / full_marks), 8) AS normalized_mae FROM v GROUP BY GROUPING SETS ((subject, variant), (variant))""")
def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.variant_metrics(_marks(spark, sf_dir), ["a", "b"])
    return out.select("subject", "variant", "n", *[r8(F.col(c), c) for c in ("exact_agreement", "within_half", "normalized_mae")])


@query(f"WITH {_MARKS} SELECT id, subject, gold, a, abs(gold - a) AS abs_err, round(abs(gold - a) / 10, 8) AS normalized_err FROM marks ORDER BY abs(gold - a) / 10 DESC, id LIMIT 40")
def topk_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.disagreements(_marks(spark, sf_dir), predicted="a").select("id", "subject", F.col("gold_score").alias("gold"), "a", "abs_err", r8(F.col("normalized_err"), "normalized_err"))


@query(f"""WITH {_MARKS} SELECT id, subject, abs(gold - a) AS abs_err, row_number() OVER (PARTITION BY subject ORDER BY abs(gold - a) / 10 DESC, id) AS rank FROM marks
QUALIFY row_number() OVER (PARTITION BY subject ORDER BY abs(gold - a) / 10 DESC, id) <= 40""")
def topk_disagreements_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.disagreements(_marks(spark, sf_dir), per_subject=True, predicted="a").select("id", "subject", "abs_err", "rank")


_CAP = "CASE l_shipmode WHEN 0 THEN 'Letter_Missing_Layout' WHEN 1 THEN 'Graph_External_Facts' ELSE 'None' END"


@query(f"""SELECT reason, count(*) AS n, sum(total) AS total, sum(least(total, CASE reason WHEN 'Letter_Missing_Layout' THEN 2.0 WHEN 'Graph_External_Facts' THEN 5.0 ELSE total END)) AS capped, sum((parts = total)::INT) AS passed
FROM (SELECT {_CAP} AS reason, l_linenumber * 1.0::DOUBLE AS total, (l_linenumber - l_partkey % 3 + l_suppkey % 3)::DOUBLE AS parts FROM (SELECT *, l_orderkey % 3 AS l_shipmode FROM lineitem)) GROUP BY reason""")
def caps_and_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") % 3
    rows = X.table(spark, sf_dir, "lineitem").select(
        F.when(k == 0, "Letter_Missing_Layout").when(k == 1, "Graph_External_Facts").otherwise("None").alias("reason"), F.col("l_linenumber").cast("double").alias("total"),
        A.sum_check(F.col("l_linenumber").cast("double"), F.col("l_linenumber").cast("double"), -(F.col("l_partkey") % 3), F.col("l_suppkey") % 3, F.lit(None)).alias("ok"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.sum(A.capped(F.col("total"), F.col("reason"))).alias("capped"), F.sum(F.col("ok").cast("long")).alias("passed"))


@query("""SELECT e.o_orderkey AS evaluation, e.o_custkey || '__' || e.o_orderstatus AS evaluation_id, round(abs(e.o_totalprice - c.c_acctbal), 6) AS gap
FROM orders e JOIN customer c ON c.c_custkey = e.o_custkey""")
def joined_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References joined on a composite key that is checked to be unique."""
    marks = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.lit(1).alias("script_id"), "c_acctbal")
    evals = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.lit(1).alias("script_id"), F.col("o_orderkey").alias("evaluation"), "o_orderstatus", "o_totalprice")
    return A.join_marks(evals, marks).select("evaluation", A.evaluation_id(F.col("task_id"), F.col("o_orderstatus")).alias("evaluation_id"), F.round(F.abs(F.col("o_totalprice") - F.col("c_acctbal")), 6).alias("gap"))


@query("""SELECT 'orders' AS stage, 'mean' AS metric, round(avg(o_totalprice), 4) AS value FROM orders UNION ALL SELECT 'orders', 'n', count(*) FROM orders
UNION ALL SELECT 'events', 'n', count(*) FROM events UNION ALL SELECT 'events', 'reduction', round(100 * (max(value) - min(value)) / max(value), 4) FROM events""")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"))
    e = X.table(spark, sf_dir, "events").agg(F.count("*").alias("n"), A.relative_reduction(F.max("value"), F.min("value")).alias("reduction"))
    return A.stage_report([("orders", o), ("events", e)]).withColumn("value", F.round("value", 4))


@query("SELECT p_partkey, unnest(list_filter(string_split(p_name || ' | ' || p_type || ' | ', ' | '), lambda x: trim(x) <> '')) AS aspect FROM part")
def list_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "part").select("p_partkey", F.explode(A.aspects(F.concat("p_name", F.lit(" | "), "p_type", F.lit(" | ")))).alias("aspect"))


# --- validation ---------------------------------------------------------------------------------------------------------


@query("""SELECT errors, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN c < 0 OR c > 1 THEN 'confidence' END, CASE WHEN t < 0 THEN 'processing_time_seconds' END, CASE WHEN k = 'odd' THEN 'confidence_type' END, CASE WHEN s < 0 OR s > 1 THEN 'segments' END) AS errors
FROM (SELECT event_id % 13 / 10.0 - 0.1 AS c, event_id % 5 - 1 AS t, CASE event_id % 3 WHEN 0 THEN 'odd' WHEN 1 THEN 'raw' END AS k, event_id % 7 / 5.0 AS s FROM events)) WHERE errors <> '' GROUP BY errors""")
def validate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    s = F.lit("x")
    rows = X.table(spark, sf_dir, "events").select(
        k.cast("string").alias("script_id"), F.struct(s.alias("image_path"), s.alias("image_hash")).alias("input"),
        F.struct(s.alias("backend"), s.alias("model"), s.alias("raw_text"), s.alias("normalized_text"), F.expr("cast(event_id % 13 as decimal(10,1)) / 10.0 - 0.1").cast("double").alias("confidence"),
                 F.when(k % 3 == 0, "odd").when(k % 3 == 1, "raw").alias("confidence_type"), F.array(F.struct(s.alias("text"), (k % 7 / 5.0).alias("confidence"))).alias("segments")).alias("ocr"),
        F.struct((k % 5 - 1).cast("double").alias("processing_time_seconds"), s.alias("timestamp")).alias("metadata"))
    _, bad = V.split_valid(rows)
    return bad.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))
