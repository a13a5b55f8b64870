"""Language ID by compression: the language whose zstandard raw-content dictionary compresses a text smallest wins.

Learning takes a bounded, documented sample: of each language's labelled documents the ``SAMPLE_DOCS`` with the smallest hash of
doc_id, at most ``DOC_BYTES`` bytes from the middle of each, joined to a dictionary of at most ``DICT_BYTES``. Every language
is learned; all samples together take at most ``TOTAL_BYTES``, so that beyond some 200 languages each one's share, and with it
the number of its sample documents, is smaller. Predictions read whole texts.

Languages are only compared by dictionaries of one size, so none wins by length, and a small one does not cut the others:
in the first round languages of similar sizes, the largest, compete, in each further round also those of half the size or
less, against the others' dictionaries cut to theirs. A language that joins in a round takes the text if it wins the round
by the margin and by no lower score than was found before; else what was found before stands. Below ``LEAST_BYTES`` there is one last round, in which still smaller
dictionaries stay as they are: such languages win only texts that are much like the little that was learned.

Each text is compressed once per language and round. Texts of over ``BLOCK_BYTES`` are compressed whole in equal blocks of at most
that size, each from the dictionary anew, and
the sizes added up: what a dictionary saves is bounded, so in one piece the score would fall with the length. The
score is 1 - smallest / second smallest of the sizes net of the frames' fixed bytes. A text is rejected if its score is below
``margin``, or if it has no letter (``und``, score 0). Ties go to the alphabetically first language with score 0 and so are rejected.
A worker holds ``COMPRESSORS`` compressors at a time and takes a batch's texts language by language.

Null or empty texts: ``und``. Rows with a null lang or doc_id teach nothing. Repeated rows are each predicted, and count once in the
sample; a learner
without labelled texts predicts ``und`` throughout; an empty table gives an empty result. lang, source and doc_id are never inputs of
a prediction. Columns other than doc_id, text and lang are not read and may have any names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, map_slices, slices, written

#: Bounds of the learning sample, per language and in all.
SAMPLE_DOCS, DOC_BYTES, DICT_BYTES, TOTAL_BYTES = 160, 2048, 112_640, 1 << 26
LEVEL = 12
#: Longer texts are compressed in blocks of at most so many bytes.
BLOCK_BYTES = 16_384
#: Dictionaries are not cut below this size.
LEAST_BYTES = 4096
#: Compressors that a worker holds, of about 2 MB each.
COMPRESSORS = 32
MARGIN = 0.005


def held_out_mask(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2, the fold that is not learned from; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Language to dictionary content, from doc_id, text and lang of ``labelled``. Only the bounded sample reaches the driver."""
    rows = labelled.where("doc_id is not null and lang is not null and length(text) > 0").select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("draw"), "text")
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n")))
    n_langs = sizes.count()
    if not n_langs:
        return {}
    docs = max(1, min(SAMPLE_DOCS, TOTAL_BYTES // (n_langs * DOC_BYTES)))
    # Twice the wanted share, so that sampling by hash seldom leaves fewer than wanted; the rest is cut below.
    near = sizes.select("lang", (F.least(F.lit(1.0), F.lit(2.0 * docs) / F.col("n")) * (1 << 40)).cast("long").alias("until"))
    middle = F.expr(f"substring(cast(text as binary), cast(greatest(1, (octet_length(text) - {DOC_BYTES}) div 2) as int), {DOC_BYTES})")
    drawn = rows.join(near, "lang").where("draw < until").select("lang", "draw", "doc_id", middle.alias("part")).distinct()
    # The limit per language keeps the bound whatever the rows are; tasks apply it before the shuffle.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "part"))
    drawn = drawn.withColumn("nth", nth).where(F.col("nth") <= docs).orderBy("lang", "nth").collect()
    parts: dict[str, list[bytes]] = {}
    for r in drawn:
        parts.setdefault(r["lang"], []).append(bytes(r["part"]))
    most = min(DICT_BYTES, docs * DOC_BYTES)
    return {lang: b"\n".join(reversed(p))[-most:] for lang, p in sorted(parts.items()) if any(p)}


def rounds(sizes: dict[str, int]) -> list[tuple[int, set[str], list[str]]]:
    """(size, languages that join, all languages so far) of each round, from the dictionaries' sizes."""
    out: list[tuple[int, set[str], list[str]]] = []
    joined: list[str] = []
    left = sorted(sizes, key=lambda x: (-sizes[x], x))
    while left:
        top = sizes[left[0]]
        group = [x for x in left if sizes[x] > top // 2 or top <= LEAST_BYTES]
        if not joined and len(group) == 1 and len(left) > 1:  # nothing to compare with: the next size joins
            group = [x for x in left if sizes[x] > sizes[left[1]] // 2 or sizes[left[1]] <= LEAST_BYTES]
        left = left[len(group) :]
        joined = joined + group
        out.append((max(min(sizes[x] for x in group), LEAST_BYTES), set(group), sorted(joined)))
    return out


class Classifier:
    """Predictions from dictionaries; compressors are made as they are needed and the last ones kept."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN) -> None:
        self.margin, self.dictionaries = margin, dictionaries
        self.rounds = rounds({k: len(v) for k, v in dictionaries.items()})
        self.compressor = functools.lru_cache(maxsize=COMPRESSORS)(self._compressor)

    def _compressor(self, lang: str, size: int):
        import zstandard as z

        own = z.ZstdCompressionDict(self.dictionaries[lang][-size:], dict_type=z.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        return z.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.rounds:
            return out
        asked = [k for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        blocks = [_blocks(texts[k].encode()) for k in asked]
        for turn, (size, new, langs) in enumerate(self.rounds):
            sizes = []
            for lang in langs:
                compress = self.compressor(lang, size).compress
                sizes.append([max(1, sum(len(compress(b)) - 9 for b in bs)) for bs in blocks])
            for k, own in zip(asked, zip(*sizes, strict=True), strict=True):
                first, *rest = sorted(zip(own, langs, strict=True))
                found = first[1], 1 - first[0] / rest[0][0] if rest else 1.0
                if not turn or (found[0] in new and found[1] >= max(self.margin, out[k][1])):
                    out[k] = found
        return out


def _blocks(data: bytes) -> list[bytes]:
    step = -(-len(data) // -(-len(data) // BLOCK_BYTES))
    return [data[at : at + step] for at in range(0, len(data), step)]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)

    def work():
        classifier = Classifier(shared.value, margin)

        def run(ids: list, texts: list) -> list:
            found = classifier.predict_all(texts)
            return [ids, [x for x, _ in found], [s for _, s in found], [x == "und" or s < margin for x, s in found]]

        return run

    return map_slices(docs, "doc_id long, lang_pred string, score double, rejected boolean", work, ["doc_id", "text"])


def classify_held_out(docs: DataFrame, *, margin: float = MARGIN) -> DataFrame:
    """Learn from the folds but 2 and predict all: doc_id, held_out, lang_pred, score, rejected."""
    dictionaries = learn(docs.where(~held_out_mask(F.col("doc_id"))))
    return identify(docs, dictionaries, margin=margin).withColumn("held_out", held_out_mask(F.col("doc_id")))


def keep_identified(docs: DataFrame, *, margin: float = MARGIN) -> DataFrame:
    """``docs`` without the rows that identification rejects, all columns kept. Learns as ``classify_held_out`` does."""
    dictionaries = learn(docs.where(~held_out_mask(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        import pyarrow as pa

        classifier = Classifier(shared.value, margin)
        for batch in batches:
            for part in slices(batch):
                found = classifier.predict_all(part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= margin for x, s in found], pa.bool_()))

    return map_arrow(docs, run, schema)
