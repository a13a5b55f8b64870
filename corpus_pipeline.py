"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame over everything its predecessor kept; all but the last
return the columns of ``docs``. Edge cases are those of the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import cuckoo_lines, harmonic_packing, minhash_dedup, template_decontam, zstd_langid
from inkgauge.llm.common import freed, table
from inkgauge.llm.queries import tokenizer_path

#: Compression, tokenizers and sketches are not SQL: tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by a clear margin."""
    return zstd_langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a smaller doc_id holds; n_chars follows the text."""
    out = cuckoo_lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash_dedup.keep_smallest(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return template_decontam.keep_clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents' tokens and their places in sequences."""
    return harmonic_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents; between stages tables are written and read again, and what a stage leaves is removed."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with freed(last=k > 0) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
