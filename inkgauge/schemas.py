"""Schemas of the tables that the library reads and writes. Readers declare them; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"STRING": StringType(), "DOUBLE": DoubleType(), "INT": IntegerType(), "BIGINT": LongType(), "BOOLEAN": BooleanType(), "TIMESTAMP": TimestampType(), "ARRAY<DOUBLE>": ArrayType(DoubleType())}


def fields(ddl: str, **nested: DataType) -> StructType:
    """Flat columns "name TYPE, ..."; a name without a type takes it from ``nested``. Needs no session, unlike a DDL parser."""
    pairs = [part.split() for part in ddl.split(",")]
    return StructType([StructField(p[0], _TYPES[p[1]] if len(p) == 2 else nested[p[0]]) for p in pairs])


SEGMENT = fields("text STRING, confidence DOUBLE, bbox", bbox=ArrayType(ArrayType(IntegerType())))

#: One record per recognised image.
OCR_RESULT = fields(
    "script_id STRING, input, ocr, metadata",
    input=fields("image_path STRING, image_hash STRING, image_size, page_number INT", image_size=ArrayType(IntegerType())),
    ocr=fields("backend STRING, model STRING, raw_text STRING, normalized_text STRING, confidence DOUBLE, confidence_type STRING, confidence_available BOOLEAN, segments", segments=ArrayType(SEGMENT)),
    metadata=fields("processing_time_seconds DOUBLE, device STRING, gpu_memory_peak_mb DOUBLE, cpu_memory_mb DOUBLE, timestamp STRING"),
)

GROUND_TRUTH = fields("script_id STRING, image_path STRING, ground_truth_text STRING, image_hash STRING")

#: The fact table, in the order of its CSV columns.
BENCHMARK_SAMPLE = fields("""
    script_id STRING, image_path STRING, raw_ocr_text STRING, normalized_ocr_text STRING, ground_truth_text STRING,
    confidence DOUBLE, confidence_available BOOLEAN, raw_cer DOUBLE, normalized_cer DOUBLE, raw_wer DOUBLE,
    normalized_wer DOUBLE, is_acceptable BOOLEAN, processing_time_seconds DOUBLE
""")

CONFIDENCE_BINS = fields("""
    bin_index INT, bin_range STRING, sample_count BIGINT, avg_confidence DOUBLE, avg_cer DOUBLE, avg_wer DOUBLE,
    acceptable_ocr_percentage DOUBLE
""")

THRESHOLD_ANALYSIS = fields("""
    threshold DOUBLE, pct_high_confidence DOUBLE, pct_low_confidence DOUBLE, high_conf_cer DOUBLE, high_conf_wer DOUBLE,
    high_conf_acceptable_rate DOUBLE, low_conf_cer DOUBLE, low_conf_wer DOUBLE, low_conf_acceptable_rate DOUBLE,
    high_correct_count BIGINT, high_incorrect_count BIGINT, low_correct_count BIGINT, low_incorrect_count BIGINT
""")

CALIBRATOR = fields("method STRING, is_fitted BOOLEAN, a DOUBLE, b DOUBLE, x_knots ARRAY<DOUBLE>, y_knots ARRAY<DOUBLE>")

#: Artifacts of a marking run.
EVALUATION = fields("""
    evaluation_id STRING, task_id STRING, script_id STRING, grader STRING, max_mark INT, teacher_mark DOUBLE, total_score DOUBLE,
    performance_band STRING, context_content_data DOUBLE, structure_format_brevity DOUBLE, language_mechanics DOUBLE,
    originality_comparisons_paraphrase DOUBLE, is_attempted BOOLEAN, cap_applied BOOLEAN, cap_reason STRING, frequent_errors STRING,
    positive_aspects STRING, feedback_summary STRING, sum_check_passed BOOLEAN, band_check_passed BOOLEAN, model_version STRING,
    prompt_version STRING, temperature DOUBLE, raw_json_path STRING, eval_timestamp TIMESTAMP
""")
COMPARATIVE_MARKS = fields("""
    task_id STRING, script_id STRING, question_type STRING, max_mark DOUBLE, teacher_mark DOUBLE, gemini_mark DOUBLE,
    pipeline_gemma_mark DOUBLE, abs_error_pipeline_vs_teacher DOUBLE, abs_error_gemini_vs_teacher DOUBLE,
    abs_error_pipeline_vs_gemini DOUBLE, teacher_band STRING, gemini_band STRING, pipeline_band STRING,
    band_match_pipeline_vs_teacher BOOLEAN, band_match_pipeline_vs_gemini BOOLEAN, gemini_cap_applied BOOLEAN,
    gemini_cap_reason STRING, pipeline_cap_applied BOOLEAN, pipeline_cap_reason STRING, cap_match BOOLEAN
""")
DISAGREEMENTS = fields("""
    id BIGINT, subject STRING, gold_score DOUBLE, predicted_score DOUBLE, full_marks DOUBLE, abs_err DOUBLE, normalized_err DOUBLE,
    transcription STRING, reasoning STRING
""")
