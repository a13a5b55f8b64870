"""Readers with declared schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkgauge.operators.metrics import MAX_CER, MAX_WER
from inkgauge.operators.routing import THRESHOLDS
from inkgauge.schemas import BENCHMARK_SAMPLE, CALIBRATOR, GROUND_TRUTH, OCR_RESULT

IMAGES = ("jpg", "jpeg", "png", "webp", "pdf")


def ground_truth_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _with_defaults(spark.read.schema(GROUND_TRUTH).json(path))


def ground_truth_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects or one object per file."""
    return _with_defaults(spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path))


def _with_defaults(rows: DataFrame) -> DataFrame:
    text = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return rows.select(text("script_id", "unknown"), text("image_path", ""), text("ground_truth_text", ""), "image_hash")


def ground_truth_csv(spark: SparkSession, path: str, *, parity: bool = False) -> DataFrame:
    """task_id before script_id, extracted_text_clean before extracted_text, by the header's columns.

    parity=True shows missing values as the text 'nan', as the CSV loader of the evaluation scripts does.
    """
    header = spark.read.option("header", True).csv(path).columns
    rows = spark.read.schema(StructType([StructField(c, StringType()) for c in header])).option("header", True).option("multiLine", True).option("escape", '"').csv(path)

    def pick(names: tuple[str, ...], default: str) -> Column:
        name = next((n for n in names if n in header), None)
        return F.lit(default) if name is None else F.coalesce(F.col(name), F.lit("nan")) if parity else F.col(name)

    return rows.select(
        pick(("task_id", "script_id"), "unknown").alias("script_id"), pick(("image_path",), "").alias("image_path"),
        pick(("extracted_text_clean", "extracted_text"), "").alias("ground_truth_text"), F.lit(None).cast("string").alias("image_hash"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending; an unknown one gives no samples."""
    reader = {".jsonl": ground_truth_jsonl, ".json": ground_truth_json, ".csv": ground_truth_csv}.get(PurePosixPath(path).suffix.lower())
    return reader(spark, path) if reader else spark.createDataFrame([], GROUND_TRUTH)


def benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK_SAMPLE).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """A directory of one JSON record per file."""
    return spark.read.schema(OCR_RESULT).option("multiLine", True).json(path)


def image_files(spark: SparkSession, folder: str, *, content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of image files of a folder, not below it. Only wanted columns are read."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(rf"\.({'|'.join(IMAGES)})$"))
    return files.withColumn("script_id", file_stem(F.col("path"))) if content else files.select("path", "modificationTime", "length", file_stem(F.col("path")).alias("script_id"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def page_names(files: DataFrame, *, first_page_only: bool = False) -> DataFrame:
    """A row per page image of stem, n_pages: page (from 1) and its file name."""
    last = F.lit(1) if first_page_only else F.col("n_pages")
    rows = files.where("n_pages > 0").select("*", F.explode(F.sequence(F.lit(1), last.cast("int"))).alias("page"))
    single = F.lit(first_page_only) | (F.col("n_pages") == 1)
    return rows.withColumn("file_name", F.when(single, F.concat("stem", F.lit(".png"))).otherwise(F.format_string("%s_p%02d.png", "stem", "page")))


def first_paths(files: DataFrame, top: int | None) -> DataFrame:
    """Files by path, the first ``top`` of them if that is positive."""
    ordered = files.orderBy("path")
    return ordered.limit(top) if top and top > 0 else ordered


def documents_else_all(items: DataFrame) -> DataFrame:
    """Items that are PDF files; all items if none is."""
    pdf = F.lower("path").endswith(".pdf")
    return items.where(pdf) if items.where(pdf).limit(1).count() else items


def evaluations(spark: SparkSession, *paths: str) -> DataFrame:
    """A bag union of per-script evaluation files of one header."""
    from inkgauge.schemas import EVALUATION

    return spark.read.schema(EVALUATION).option("header", True).option("multiLine", True).option("escape", '"').csv(list(paths))


def calibrator(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATOR).parquet(path)


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a YAML tree; absent keys keep these defaults."""

    aggregation_method: str = "length_weighted_mean"
    derive_if_missing: bool = True
    calibration_method: str = "none"
    max_cer: float = MAX_CER
    max_wer: float = MAX_WER
    candidate_thresholds: tuple[float, ...] = field(default=THRESHOLDS)
    confidence_bins: int = 10


def engine_config(text: str) -> EngineConfig:
    """From YAML text; '' gives the defaults. Keys the engine doesn't use are ignored."""
    import yaml

    tree = yaml.safe_load(text) or {}
    conf, evaluation = tree.get("confidence") or {}, tree.get("evaluation") or {}
    limits = evaluation.get("acceptable_ocr") or {}
    base = EngineConfig()
    return EngineConfig(
        conf.get("aggregation_method", base.aggregation_method), conf.get("derive_if_missing", base.derive_if_missing), conf.get("calibration_method", base.calibration_method),
        float(limits.get("max_cer", base.max_cer)), float(limits.get("max_wer", base.max_wer)),
        tuple(float(t) for t in evaluation.get("candidate_thresholds", base.candidate_thresholds)), int(evaluation.get("confidence_bins", base.confidence_bins)))
