"""Recognition against reference text: benchmark rows and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import text as T
from inkgauge.schemas import BENCHMARK_SAMPLE

MAX_CER, MAX_WER = 0.05, 0.15


def acceptable(cer: Column, wer: Column, *, max_cer: float = MAX_CER, max_wer: float = MAX_WER) -> Column:
    """Either rate within its limit; on unrounded rates."""
    return (cer <= max_cer) | (wer <= max_wer)


def benchmark_rows(samples: DataFrame, *, max_cer: float = MAX_CER, max_wer: float = MAX_WER, digits: int | None = 4) -> DataFrame:
    """The fact table from script_id, raw_ocr_text, ground_truth_text and optional columns of BENCHMARK_SAMPLE.

    Raw rates compare the texts as they are, normalised rates the recognised text's safe form in the metrics' normal forms.
    Each text is brought to NFC once.
    """
    given = set(samples.columns)
    nfc = samples.withColumn("__hyp", T.nfc(F.coalesce("raw_ocr_text", F.lit("")))).withColumn("__ref", T.nfc(F.coalesce("ground_truth_text", F.lit(""))))
    safe = T.safe_normalize(F.col("__hyp"), composed=True) if "normalized_ocr_text" not in given else T.nfc(F.coalesce("normalized_ocr_text", F.lit("")))
    rows = nfc.withColumn("__safe", safe)
    rows = rows.withColumns({
        "__ct": T.normalize_for_cer(F.col("__safe"), composed=True), "__cr": T.normalize_for_cer(F.col("__ref"), composed=True),
        "__wt": T.normalize_for_wer(F.col("__safe"), composed=True), "__wr": T.normalize_for_wer(F.col("__ref"), composed=True),
        "__rt": T.split_words(F.col("raw_ocr_text")), "__rr": T.split_words(F.col("ground_truth_text")),
    })
    rates = {
        "raw_cer": T.cer(F.col("raw_ocr_text"), F.col("ground_truth_text")), "normalized_cer": T.cer(F.col("__ct"), F.col("__cr")),
        "raw_wer": T.wer_of_tokens(F.col("__rt"), F.col("__rr")), "normalized_wer": T.wer_of_tokens(F.col("__wt"), F.col("__wr")),
    }
    rows = rows.withColumns(rates)
    rows = rows.withColumn("is_acceptable", acceptable(F.col("normalized_cer"), F.col("normalized_wer"), max_cer=max_cer, max_wer=max_wer))
    if "normalized_ocr_text" not in given:
        rows = rows.withColumn("normalized_ocr_text", F.col("__safe"))
    if digits is not None:
        rows = rows.withColumns({c: F.round(c, digits) for c in rates})
    if "confidence" in given and "confidence_available" not in given:
        rows = rows.withColumn("confidence_available", F.col("confidence").isNotNull())
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in BENCHMARK_SAMPLE])


def summarize(rows: DataFrame) -> DataFrame:
    """One row: means of the (rounded) rates over all rows, mean confidence over rows that have one, shares in percent."""
    mean_cer, mean_wer = F.avg("normalized_cer"), F.avg("normalized_wer")
    accuracy = lambda m: F.round((1.0 - F.least(F.lit(1.0), m)) * 100.0, 2)
    return rows.agg(
        F.count("*").alias("total_samples"),
        F.round(F.avg("raw_cer"), 4).alias("mean_raw_cer"), F.round(mean_cer, 4).alias("mean_normalized_cer"),
        F.round(F.avg("raw_wer"), 4).alias("mean_raw_wer"), F.round(mean_wer, 4).alias("mean_normalized_wer"),
        accuracy(mean_cer).alias("character_accuracy_percentage"), accuracy(mean_wer).alias("word_accuracy_percentage"),
        F.round(F.avg(F.when(~F.isnan("confidence"), F.col("confidence"))), 4).alias("mean_confidence"),
        F.round(F.avg(F.col("is_acceptable").cast("double")) * 100.0, 2).alias("acceptable_ocr_percentage"),
    )


def join_truth(recognised: DataFrame, truth: DataFrame, on: list[str] | str = "script_id") -> DataFrame:
    """Recognised texts with their references. Raises if the references' key is not unique: such a join would repeat samples."""
    keys = [on] if isinstance(on, str) else list(on)
    repeated = truth.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"reference key {keys} is not unique, e.g. {repeated[0].asDict()}")
    return recognised.join(truth, keys)
