"""Harmonic packing of tokenized documents into sequences of fixed capacity.

A piece of length L belongs to the reciprocal class k = capacity // L, and a bin of that class holds k pieces. Because
documents may be cut freely, only lengths that fill their class are made: capacity // k for k up to ``capacity // TAIL``
(4096, 2048, 1365, ... tokens), cut greedily from a document's front, then one tail below ``TAIL``. All pieces of a class
then have one length, so the i-th piece of a class lies in the class's bin i // k at offset (i % k) * L: every worker
places its pieces by arithmetic on its own counts, once it knows how many pieces of the class lie with workers before
it. Only those counts (workers x classes) are shuffled. The last, partly filled bin of each class is one run of tokens;
these runs, at most one per class and so a bounded number, are merged first-fit by decreasing length.

Null texts count as empty: a document's only id is then the end id. Repeated rows are packed once each; a null doc_id is
carried along. An empty table gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import Remembered, map_slices, written

#: Pieces shorter than this are tails of documents: a class for each length.
TAIL = 64
#: Words of one generation of the encoder's memory: 105 MB for a worker with its two generations and tokenizer, as measured.
WORDS = 200_000
#: A mark after letters that stay single letters when lowered and composed. Of other letters some become a letter and a
#: combining mark, which the tokenizer joins to the mark after it, so such words are encoded whole.
_MARKED = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]")


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_path: str, *, end_id: int) -> Callable[[list[str | None]], list[bytes]]:
    """Texts to little-endian 32-bit ids, end id last. Remembers words.

    For tokenizers that drop white space between words, as the given one does: a word's ids don't depend on its
    neighbours. A Python worker keeps the encoder, and so the words, from task to task. New words go to the library as one text, parted by a special token, which no word's ids run across.
    """
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
    parting, parting_id = next(iter(special.items()), ("", -1))
    end = np.array([end_id], "<u4").tobytes()
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True

    def alone(word: str) -> bytes:
        return np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def parted(words: list[str]) -> list[bytes]:
        """Any words, as one text with a special token between them."""
        if not parting or not words:
            return [alone(w) for w in words]
        odd = {i for i, w in enumerate(words) if any(s in w for s in special)}
        ids = encoded(parting.join("" if i in odd else w for i, w in enumerate(words)))
        out = cut_at(ids, np.flatnonzero(ids == parting_id), skip=1)
        for i in odd:
            out[i] = alone(words[i])
        return out

    def letters(words: list[str]) -> list[bytes]:
        """Words of letters only, with blanks between them: each is one unit of the tokenizer, which ends in a word-end token."""
        ids = encoded(" ".join(words))
        last = np.flatnonzero(ends_word[ids]) if suffix else np.empty(0, int)
        # Letters that the tokenizer's normal form splits make more units than words.
        return cut_at(ids, last[:-1] + 1, skip=0) if len(last) == len(words) else parted(words)

    def encoded(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def cut_at(ids: np.ndarray, cuts: np.ndarray, skip: int) -> list[bytes]:
        data = ids.tobytes()
        starts, ends = [0, *(4 * (cuts + skip)).tolist()], [*(4 * cuts).tolist(), len(data)]
        return [data[a:b] for a, b in zip(starts, ends, strict=True)]

    def from_library(words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for only, work in ((True, letters), (False, parted)):
            some = [w for w in words if w.isalpha() is only]
            for at in range(0, len(some), 4096):
                out.update(zip(some[at : at + 4096], work(some[at : at + 4096]), strict=True))
        return out

    def ids_of(words: list[str]) -> list[bytes]:
        """Through a plainer form that has the same ids: A-Z lowered, a mark after plain letters on its own."""
        plain = [(w.lower() if w.isascii() and "<|" not in w else w) for w in words]
        stems = [w[:-1] if w[-1:] in marks and _MARKED.fullmatch(w) else w for w in plain]
        ids = {w: known.get(w) for w in {*stems, *marks}}
        ids.update(from_library([w for w, x in ids.items() if x is None]))
        return [ids[s] if s is w else ids[s] + ids[w[-1]] for s, w in zip(stems, plain, strict=True)]

    marks = (".", ",")  # those of _MARKED
    known = Remembered(ids_of, WORDS)

    def encode(texts: list[str | None]) -> list[bytes]:
        words = [_split(t) if t else [] for t in texts]
        value = known.of(set().union(*words)).__getitem__
        return [b"".join(map(value, w)) + end for w in words]

    return encode


def _split(text: str) -> list[str]:
    """At blanks and line ends only; other white space stays inside a word, for the tokenizer to treat.

    The tokenizer lowers letters itself; doing it before for ASCII texts without special tokens makes fewer distinct words.
    """
    if text.isascii() and "<|" not in text:
        text = text.lower()
    return text.replace("\n", " ").split(" ")


def class_lengths(capacity: int) -> list[int]:
    """Lengths that pieces may have, longest first: they fill bins of their class but for a few tokens."""
    return sorted({capacity // k for k in range(1, capacity // TAIL + 1)} | set(range(1, min(TAIL, capacity + 1))), reverse=True)


def cut(n_tokens: int, capacity: int, lengths: list[int]) -> list[int]:
    """Greedy lengths from a document's front; each is one of ``lengths``."""
    out = [capacity] * (n_tokens // capacity)
    left = n_tokens % capacity
    while left:
        k = -(-capacity // left)  # the largest capacity // k that is at most left; tails fit as they are
        while left >= TAIL and capacity // k > left:
            k += 1
        out.append(left if left < TAIL else capacity // k)
        left -= out[-1]
    return out


def cut_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int, end_id: int) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, worker, place (of its class on that worker)."""

    def work():
        from collections import Counter

        from pyspark import TaskContext

        encode, lengths, seen = encoder(tokenizer_path, end_id=end_id), class_lengths(capacity), Counter()
        worker = TaskContext.get().partitionId()

        def run(ids: list, texts: list) -> list:
            out: list[tuple] = []
            for doc_id, data in zip(ids, encode(texts), strict=True):
                n, start = len(data) // 4, 0
                for length in cut(n, capacity, lengths):
                    out.append((doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, worker, seen[length]))
                    seen[length] += 1
                    start += length
            return [list(x) for x in zip(*out, strict=True)] if out else [[]] * 7

        return run

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, place long"
    return map_slices(docs, schema, work, ["doc_id", "text"])


def merge_last_bins(totals: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, bin size k, first sequence, sequence of the last partial bin, its offset there) for each class.

    ``totals`` has a count for each length, so its size is bounded by the classes.
    """
    first, out, runs = 0, {}, []
    for length in sorted(totals, reverse=True):
        k = capacity // length
        out[length] = [length, k, first, -1, 0]
        first += totals[length] // k
        if totals[length] % k:
            runs.append((totals[length] % k * length, length))
    fill: list[int] = []
    for size, length in sorted(runs, reverse=True):
        into = next((i for i, used in enumerate(fill) if used + size <= capacity), len(fill))
        if into == len(fill):
            fill.append(0)
        out[length][3:] = [first + into, fill[into]]
        fill[into] += size
    return [tuple(x) for x in out.values()]


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    # The pieces' places are facts of one run of the cutting tasks: written down, so that a lost executor can't change them.
    pieces = written(cut_documents(docs, tokenizer_path, capacity=capacity, end_id=end_id))
    held = pieces.groupBy("worker", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("worker", "length", "before", "n")
    held = written(held)
    totals = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per class
    plan = spark.createDataFrame(merge_last_bins(totals, capacity), "length long, k long, first long, last long, last_offset long")
    total = spark.createDataFrame(list(totals.items()), "length long, total long")
    at = F.col("before") + F.col("place")
    whole = at < F.col("total") - F.col("total") % F.col("k")
    inside = (at % F.col("k")) * F.col("length")
    return (
        pieces.join(held.drop("n"), ["worker", "length"])
        .join(F.broadcast(plan.join(F.broadcast(total), "length")), "length")
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            F.when(whole, F.col("first") + F.expr("(before + place) div k")).otherwise(F.col("last")).alias("sequence_id"),
            F.when(whole, inside).otherwise(F.col("last_offset") + inside).alias("offset"),
        )
    )
