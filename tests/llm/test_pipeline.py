import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from inkgauge.llm import queries
from tests.conftest import SF
from tests.llm import brute


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and out.schema == docs.schema
        before, after = [(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r for r in out.collect()}
        seen[name] = (len(before), len(after))
        if name == "line dedup":
            assert {i: r.text for i, r in after.items()} == {i: t for i, (_, _, t) in brute.without_lines(before).items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near-dedup":
            assert sorted(after) == sorted(i for i, (_, c) in brute.components(before).items() if c == i)
        else:
            texts = dict(before)
            assert all(r.text == texts[i] for i, r in after.items())
        docs = out
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(item in (r.text or "") for r in docs.collect() for item in items)
    assert seen["language ID"][1] > 0.9 * seen["language ID"][0]
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) for p in pieces)
    whole = corpus_pipeline.run(spark, SF)
    total = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert total(whole.collect()) == total(pieces)


def test_stages_keep_extra_columns_and_survive_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("class", F.lit("clash")).withColumn("n_lines", F.lit(7))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, empty, SF).collect() == []
    assert corpus_pipeline.packing(spark, empty, SF).collect() == []
