"""The boundary to text recognition: a backend turns images (script_id, image_path, image_hash, ...) into OCR_RESULT records.

Neural backends are outside; what happens after their inference is here: blank segments dropped, texts joined and
normalised, confidences aggregated or derived. The mock backend is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.text import derived_confidence, safe_normalize, strip
from inkgauge.operators.confidence import aggregate_confidence
from inkgauge.schemas import OCR_RESULT

Backend = Callable[[DataFrame], DataFrame]
# Names by which a backend is chosen; any other name means the first.
ALIASES = {
    "infinite": ("infinite_ocr", "nanonets", "qwen", "qwen_vl"),
    "trocr": ("trocr", "trocr_handwritten"),
    "easyocr": ("easyocr", "craft"),
    "mock": ("mock", "test"),
}
_registry: dict[str, Callable[..., Backend]] = {}


def canonical(name: str | None) -> str:
    name = (name or "infinite_ocr").lower().strip()
    return next((k for k, names in ALIASES.items() if name in names), "infinite")


def canonical_column(name: Column) -> Column:
    """The same for a column."""
    name, out = F.lower(strip(name)), F.lit("infinite")
    for kind, names in ALIASES.items():
        out = F.when(name.isin(*names), kind).otherwise(out)
    return out


def register(kind: str, make: Callable[..., Backend]) -> None:
    _registry[kind] = make


def backend(name: str | None = None, **options) -> Backend:
    kind = canonical(name)
    if kind not in _registry:
        raise LookupError(f"no backend registered for {kind!r}; register() one that returns OCR_RESULT records")
    return _registry[kind](**options)


def recognised(images: DataFrame, *, backend: str, model: str, segments: Column, raw_text: Column | None = None, method: str = "length_weighted_mean", derive_if_missing: bool = False, separator: str = " ") -> DataFrame:
    """OCR_RESULT records from images and their detected segments (array<struct<text, confidence, bbox>>).

    Confidence is the segments' aggregate weighted by trimmed length, else derived from the text if asked for, else null.
    """
    kept = F.filter(F.transform(segments, lambda s: F.struct(strip(s["text"]).alias("text"), F.round(s["confidence"].cast("double"), 4).alias("confidence"), s["bbox"].alias("bbox"), s["confidence"].cast("double").alias("exact"))), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    rows = images.withColumn("__segments", F.coalesce(kept, F.array().cast("array<struct<text:string,confidence:double,bbox:array<array<int>>,exact:double>>")))
    joined = raw_text if raw_text is not None else F.array_join(F.transform("__segments", lambda s: s["text"]), separator)
    rows = rows.withColumn("__raw", joined).withColumn("__text", safe_normalize(F.col("__raw")))
    of_segments = aggregate_confidence(F.transform("__segments", lambda s: s["exact"]), F.transform("__segments", lambda s: F.char_length(s["text"]).cast("double")), method)
    derived = derived_confidence(F.col("__text")) if derive_if_missing else F.lit(None).cast("double")
    rows = rows.withColumn("__own", F.round(of_segments, 4)).withColumn("__derived", derived)
    confidence = F.coalesce("__own", "__derived")
    kind = F.when(F.col("__own").isNotNull(), "raw").when(F.col("__derived").isNotNull(), "derived").otherwise("none")
    plain = F.transform("__segments", lambda s: F.struct(s["text"].alias("text"), s["confidence"].alias("confidence"), s["bbox"].alias("bbox")))
    return _records(rows, backend, model, F.col("__raw"), F.col("__text"), confidence, kind, plain)


def _records(rows: DataFrame, backend: str, model: str, raw: Column, text: Column, confidence: Column, kind: Column, segments: Column) -> DataFrame:
    have = set(rows.columns)
    given = lambda c, default=None: F.col(c) if c in have else F.lit(default)
    out = rows.select(
        "script_id",
        F.struct(given("image_path", "").alias("image_path"), given("image_hash", "").alias("image_hash"), given("image_size").alias("image_size"), given("page_number", 1).alias("page_number")).alias("input"),
        F.struct(F.lit(backend).alias("backend"), F.lit(model).alias("model"), raw.alias("raw_text"), text.alias("normalized_text"), confidence.alias("confidence"), kind.alias("confidence_type"), confidence.isNotNull().alias("confidence_available"), segments.alias("segments")).alias("ocr"),
        F.struct(given("processing_time_seconds", 0.0).alias("processing_time_seconds"), given("device", "cpu").alias("device"), given("gpu_memory_peak_mb").alias("gpu_memory_peak_mb"), given("cpu_memory_mb").alias("cpu_memory_mb"),
                 F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp")).alias("metadata"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OCR_RESULT])


def mock(mock_text: str = "Sample text.\nSecond line.", mock_confidence: float = 0.94, confidence_available: bool = True) -> Backend:
    """The same text for every image, a segment per non-blank line, a constant confidence or none."""

    def run(images: DataFrame) -> DataFrame:
        confidence = F.lit(mock_confidence if confidence_available else None).cast("double")
        lines = F.filter(F.split(F.lit(mock_text), "\n", -1), lambda line: strip(line) != "")
        segments = F.transform(lines, lambda line: F.struct(line.alias("text"), confidence.alias("confidence"), F.lit(None).cast("array<array<int>>").alias("bbox")))
        kind = F.lit("raw" if confidence_available else "none")
        return _records(images, "mock", "mock-deterministic-v1", F.lit(mock_text), safe_normalize(F.lit(mock_text)), confidence, kind, segments)

    return run


register("mock", mock)


def flat(records: DataFrame) -> DataFrame:
    """Nested records as a flat comparison table; absent parts are null."""
    return records.select(
        "script_id", F.col("input.image_path").alias("image_path"), F.col("ocr.backend").alias("backend"), F.col("ocr.model").alias("model"),
        F.col("ocr.confidence").alias("confidence"), F.col("ocr.confidence_type").alias("confidence_type"), F.char_length("ocr.normalized_text").alias("text_length"),
        F.size("ocr.segments").alias("n_segments"), F.col("metadata.processing_time_seconds").alias("processing_time_seconds"), F.col("ocr.normalized_text").alias("normalized_text"))
