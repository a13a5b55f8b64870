import json

import pytest
from pyspark.sql import functions as F

from inkgauge.operators import validation as V
from inkgauge.plans import pipelines as P
from inkgauge.schemas import OCR_RESULT
from inkgauge.sources import backends as B
from inkgauge.sources import readers as S
from inkgauge.sources import writers as W
from inkgauge.streaming.monitor import windowed_bins


def record(i="s1", confidence=0.9, **changes):
    r = {
        "script_id": i, "input": {"image_path": "a.png", "image_hash": "h", "image_size": [1000, 1500], "page_number": 1},
        "ocr": {"backend": "mock", "model": "m", "raw_text": "x", "normalized_text": "x", "confidence": confidence, "confidence_type": "raw", "confidence_available": True, "segments": [{"text": "x", "confidence": 0.5, "bbox": [[0, 1], [2, 3]]}]},
        "metadata": {"processing_time_seconds": 0.1, "device": "cpu", "gpu_memory_peak_mb": None, "cpu_memory_mb": None, "timestamp": "2024-01-01T00:00:00+00:00"},
    }
    for path, value in changes.items():
        a, b = path.split("__")
        r[a][b] = value
    return r


def test_ground_truth_formats(spark, tmp_path):
    rows = [{"script_id": "1", "image_path": "p", "ground_truth_text": "t"}, {"image_path": None}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps(rows))
    (tmp_path / "c.json").write_text(json.dumps(rows[0]))
    (tmp_path / "d.csv").write_text('task_id,script_id,extracted_text_clean,extracted_text\nT,S,"a ""b""\nc",no\nU,V,,no\n')
    for name in ("a.jsonl", "b.json"):
        got = [tuple(r)[:3] for r in S.ground_truth(spark, str(tmp_path / name)).collect()]
        assert got == [("1", "p", "t"), ("unknown", "", "")]
    assert S.ground_truth(spark, str(tmp_path / "c.json")).count() == 1
    assert [r.ground_truth_text for r in S.ground_truth(spark, str(tmp_path / "d.csv")).collect()] == ['a "b"\nc', None]
    assert [r.ground_truth_text for r in S.ground_truth_csv(spark, str(tmp_path / "d.csv"), parity=True).collect()] == ['a "b"\nc', "nan"]
    assert S.ground_truth(spark, str(tmp_path / "e.txt")).count() == 0


def test_listing(spark, tmp_path):
    for n in ("b.PNG", "a.jpg", "c.txt", "d.v2.pdf"):
        (tmp_path / n).write_bytes(b"x")
    files = S.image_files(spark, str(tmp_path))
    assert sorted(r.script_id for r in files.collect()) == ["a", "b", "d.v2"]
    assert S.first_paths(files, 2).count() == 2 and S.first_paths(files, 0).count() == 3
    assert S.documents_else_all(files).count() == 1
    assert [r.h for r in S.image_files(spark, str(tmp_path), content=True).select(V.content_hash(F.col("content")).alias("h")).distinct().collect()] == ["2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"]
    pages = S.page_names(spark.createDataFrame([("x", 1), ("y", 2), ("z", 0)], "stem string, n_pages int"))
    assert sorted(r.file_name for r in pages.collect()) == ["x.png", "y_p01.png", "y_p02.png"]
    assert sorted(r.file_name for r in S.page_names(spark.createDataFrame([("y", 2)], "stem string, n_pages int"), first_page_only=True).collect()) == ["y.png"]


def test_config():
    c = S.engine_config("confidence: {calibration_method: platt}\nevaluation:\n  acceptable_ocr: {max_cer: 0.1}\n  candidate_thresholds: [0.5]\n")
    assert (c.calibration_method, c.max_cer, c.max_wer, c.candidate_thresholds) == ("platt", 0.1, 0.15, (0.5,))
    assert S.engine_config("") == S.EngineConfig()


def test_validation(spark):
    cases = [record("ok"), record("null", None), record("edge", 1.0), record("high", 1.5), record("low", -0.1), record("nan", float("nan")), record("slow", metadata__processing_time_seconds=-1.0),
             record("kind", ocr__confidence_type="odd"), record("path", input__image_path=None), record("segment", ocr__segments=[{"text": "x", "confidence": 2.0, "bbox": None}])]
    good, bad = V.split_valid(spark.createDataFrame(cases, OCR_RESULT))
    assert sorted(r.script_id for r in good.collect()) == ["edge", "null", "ok"]
    assert {r.script_id: r.errors for r in bad.collect()} == {"high": ["confidence"], "low": ["confidence"], "nan": ["confidence"], "slow": ["processing_time_seconds"], "kind": ["confidence_type"], "path": ["input.image_path"], "segment": ["segments"]}
    assert V.strict(spark.createDataFrame(cases[:3], OCR_RESULT)).count() == 3
    with pytest.raises(Exception, match="invalid record (high|low|nan|slow|kind|path|segment)"):
        V.strict(spark.createDataFrame(cases, OCR_RESULT)).collect()


def test_backends(spark):
    assert [B.canonical(n) for n in (" TrOCR", "craft", "TEST", "unlimited_ocr/baidu", None)] == ["trocr", "easyocr", "mock", "infinite", "infinite"]
    with pytest.raises(LookupError):
        B.backend("craft")
    images = spark.createDataFrame([("s", "p")], "script_id string, image_path string")
    got = B.backend("mock", mock_text="One\n\n  two", confidence_available=False)(images).first()
    assert got.ocr.confidence is None and got.ocr.confidence_type == "none" and [s.text for s in got.ocr.segments] == ["One", "  two"]
    assert got.ocr.normalized_text == "One\n\ntwo"
    segments = F.array(F.struct(F.lit(" ab ").alias("text"), F.lit(0.5).alias("confidence"), F.lit(None).cast("array<array<int>>").alias("bbox")), F.struct(F.lit("  ").alias("text"), F.lit(0.1).alias("confidence"), F.lit(None).cast("array<array<int>>").alias("bbox")), F.struct(F.lit("cdef").alias("text"), F.lit(0.8).alias("confidence"), F.lit(None).cast("array<array<int>>").alias("bbox")))
    joined = B.recognised(images, backend="easyocr", model="m", segments=segments).first().ocr
    assert joined.raw_text == "ab cdef" and joined.confidence == 0.7 and len(joined.segments) == 2
    derived = B.recognised(images, backend="vlm", model="m", segments=F.array().cast("array<struct<text:string,confidence:double,bbox:array<array<int>>>>"), raw_text=F.lit("The answer is good"), derive_if_missing=True).first().ocr
    assert derived.confidence_type == "derived" and derived.confidence == 0.99


def test_run_from_images_to_reports(spark, tmp_path):
    images = spark.createDataFrame([(f"s{i}", f"{i}.png") for i in range(6)], "script_id string, image_path string")
    records = P.recognise(images, B.backend("mock", mock_text="the cat sat", mock_confidence=0.8))
    truth = spark.createDataFrame([(f"s{i}", "the cat sat" if i % 2 else "a dog") for i in range(6)], "script_id string, ground_truth_text string")
    rows, summary = P.benchmark(records, truth)
    assert summary.first().acceptable_ocr_percentage == 50.0
    W.records_json(records, str(tmp_path / "json"))
    again = S.ocr_results(spark, str(tmp_path / "json" / "*" / "*.txt"))
    assert again.count() == 6 and again.first().ocr.raw_text == "the cat sat"
    W.benchmark_csv(rows, str(tmp_path / "csv"))
    back = S.benchmark_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.drop("image_path").collect())) == sorted(map(tuple, rows.drop("image_path").collect()))
    bins, metrics = P.analyse(back)
    assert bins.where("sample_count > 0").first().bin_index == 9 and metrics.first().ece == pytest.approx(0.3)
    model = P.calibrate(back)
    W.calibrator(model, str(tmp_path / "model"))
    assert S.calibrator(spark, str(tmp_path / "model")).first() == model.first()
    assert P.route(back).where("threshold = 0.8").first().high_correct_count == 3
    W.summary_json(summary, str(tmp_path / "summary"), backend="mock")
    assert spark.read.json(str(tmp_path / "summary")).first().metrics.total_samples == 6


def test_streaming_bins(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 0.15, True), ("2024-01-01 00:02:00", 0.12, False), ("2024-01-01 00:15:00", 0.95, True)], "t string, confidence double, is_acceptable boolean")
    rows = rows.selectExpr("cast(t as timestamp) event_time", "confidence", "is_acceptable", "0.1D cer", "0.2D wer")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_bins(stream).writeStream.outputMode("update").format("memory").queryName("bins").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.bin_index, r.n, r.acceptable) for r in spark.table("bins").collect())
    assert got == [(2, 2, 1), (10, 1, 1)] == sorted((r.bin_index, r.n, r.acceptable) for r in windowed_bins(rows).collect())


def test_command_line(spark, tmp_path, capsys):
    from inkgauge.__main__ import main

    (tmp_path / "images").mkdir()
    for i in range(6):
        (tmp_path / "images" / f"s{i}.png").write_bytes(b"x")
    at = lambda *p: str(tmp_path.joinpath(*p))
    assert main(["recognise", "--input", at("images"), "--output", at("records")], spark) == 0
    (tmp_path / "truth.jsonl").write_text("\n".join(json.dumps({"script_id": f"s{i}", "ground_truth_text": "Sample text. Second line." if i else "other"}) for i in range(6)))
    (tmp_path / "config.yaml").write_text("evaluation: {candidate_thresholds: [0.9, 0.95]}")
    assert main(["benchmark", "--records", at("records", "*", "*.txt"), "--dataset", at("truth.jsonl"), "--output_csv", at("csv"), "--output_json", at("json")], spark) == 0
    assert main(["analyse", "--benchmark_csv", at("csv"), "--output_dir", at("out"), "--bins", "5"], spark) == 0
    assert main(["calibrate", "--benchmark_csv", at("csv"), "--output_model", at("model")], spark) == 0
    assert main(["route", "--benchmark_csv", at("csv"), "--config", at("config.yaml"), "--output_csv", at("routes")], spark) == 0
    assert spark.read.option("header", True).csv(at("routes")).count() == 2 and spark.read.option("header", True).csv(at("out", "confidence_bins")).count() == 5
    assert S.calibrator(spark, at("model")).first().is_fitted
    assert main(["benchmark", "--records", at("records"), "--dataset", at("none.txt"), "--output_csv", at("x"), "--output_json", at("y")], spark) == 1
