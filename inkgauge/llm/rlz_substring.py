"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

Documents are parsed relative to all smaller documents. Reference blocks are ``BLOCK`` words long and chosen by their
content (the smallest block hash within every ``SPAN`` words), so a passage of ``SPAN`` words holds the same block
wherever it stands. The index gives each block that several documents hold its smallest document and place there. A document
is factored greedily: from a block, the factor grows over the following blocks while they match the same reference
document at the same displacement, which proves equality of every word between the first block's start and the last one's
end. Factors of ``SPAN`` words and more are duplicate spans. A block's smallest document is one reference of many; so every
window of ``SPAN`` words that touches a shared block but lies in no factor, at the factors' boundaries, is looked up exactly
by its own hash among the windows of all documents there. Nothing else can be a duplicate: a repeated window holds a shared block.

Only blocks, and windows at boundaries, are shuffled; both are pre-aggregated, and a passage that a third of all documents
share is dealt over many tasks when the references are joined back. No pair of documents is ever formed.

Null texts have no words. Rows with a null doc_id lose nothing and are no reference. Rows that share a doc_id don't remove
words from each other; each is parsed by itself, as a row is known by its doc_id and a hash of its text, and each is returned
(equal rows equally). Texts are processed whole. An empty table gives an empty result. Of the other columns those named n_words
and n_removed are replaced, the rest are kept whatever their names are, except names that start with two underscores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import WordHash, map_slices, rewrite, signed, skew_join, windows, written

SPAN, BLOCK = 50, 26
#: Blocks in a span; neighbouring chosen blocks are at most so far apart, and so leave no word between them.
REACH = SPAN - BLOCK + 1


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def chosen_blocks(blocks: np.ndarray) -> np.ndarray:
    """For each window of REACH blocks the place of its smallest, the leftmost on ties."""
    view = np.lib.stride_tricks.sliding_window_view(blocks, REACH)
    return view.argmin(axis=1) + np.arange(len(view))


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with __row, which tells rows of one doc_id apart."""
    return docs.withColumn("__row", F.xxhash64("text"))


def _flat(found: list[tuple[np.ndarray, int, int, np.ndarray]]) -> list:
    """Hashes, doc_id, row and place of each entry of (hashes, doc_id, row, places)."""
    if not found:
        return [[], [], [], []]
    sizes = [len(p) for _, _, _, p in found]
    repeated = lambda k: np.repeat(np.array([x[k] for x in found], np.int64), sizes)
    return [signed(np.concatenate([x[0] for x in found])), repeated(1), repeated(2), np.concatenate([x[3] for x in found]).astype(np.int32)]


def block_rows(docs: DataFrame) -> DataFrame:
    """(block, doc_id, row, place) of the chosen blocks, and of each document's first and last block, of documents with a span."""

    def work():
        hashes = WordHash()

        def run(ids: list, rows: list, texts: list) -> list:
            out: list[tuple[np.ndarray, int, int, np.ndarray]] = []
            for i, row, text in zip(ids, rows, texts, strict=True):
                words = split(text)
                if i is None or len(words) < SPAN:
                    continue
                blocks = windows(hashes.of(words), BLOCK)
                places = np.unique(np.r_[0, chosen_blocks(blocks), len(blocks) - 1])
                out.append((blocks[places], i, row, places))
            return _flat(out)

        return run

    return map_slices(docs, "block long, doc_id long, row long, place int", work, ["doc_id", "__row", "text"])


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, __row, __matches): each row's shared blocks as (place, reference document, reference row, place there)."""
    rows = written(block_rows(docs))
    # All three parts of a reference come from the same row: ties are settled alike in aggregates over one input.
    index = rows.groupBy("block").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"), F.min_by("row", "doc_id").alias("ref_row"), F.min_by("place", "doc_id").alias("ref_place"))
    index = written(index.where("ref < last").drop("last"))
    return skew_join(rows, index, "block", "row").groupBy("doc_id", F.col("row").alias("__row")).agg(F.collect_set(F.struct("place", "ref", "ref_row", "ref_place")).alias("__matches"))


class Parsed:
    """One document's windows: ``sure`` lie in factors, ``open`` touch a shared block but lie in none."""

    def __init__(self, hashes: np.ndarray, doc_id: int, place: np.ndarray, ref: np.ndarray, ref_row: np.ndarray, ref_place: np.ndarray) -> None:
        order = np.argsort(place)
        place, ref, ref_row, ref_place = place[order], ref[order], ref_row[order], ref_place[order]
        n = len(hashes) - SPAN + 1
        chosen = chosen_blocks(windows(hashes, BLOCK))
        shared = np.zeros(len(hashes), bool)
        shared[place] = True
        self.sure = np.zeros(n, bool)
        older = ref < doc_id
        place, ref, ref_row, shift = place[older], ref[older], ref_row[older], (place - ref_place)[older]
        if len(place):
            breaks = np.flatnonzero((ref[1:] != ref[:-1]) | (ref_row[1:] != ref_row[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] - place[:-1] > BLOCK)) + 1
            starts, ends = place[np.r_[0, breaks]], place[np.r_[breaks - 1, len(place) - 1]] + BLOCK
            step = np.zeros(n + 1, np.int64)
            long = ends - starts >= SPAN
            np.add.at(step, starts[long], 1)
            np.add.at(step, ends[long] - SPAN + 1, -1)
            self.sure = np.cumsum(step[:-1]) > 0
        self.open = shared[chosen] & ~self.sure


def _arrays(found: list) -> tuple[np.ndarray, ...]:
    return tuple(np.array([m[k] for m in found], np.int64) for k in ("place", "ref", "ref_row", "ref_place"))


def boundary_windows(matched: DataFrame) -> DataFrame:
    """(window, doc_id, row, start): windows to be looked up exactly, from doc_id, __row, text and __matches."""

    def work():
        words_of = WordHash()

        def run(ids: list, rows: list, texts: list, found: list) -> list:
            out: list[tuple[np.ndarray, int, int, np.ndarray]] = []
            for i, row, text, m in zip(ids, rows, texts, found, strict=True):
                hashes = words_of.of(split(text))
                starts = np.flatnonzero(Parsed(hashes, i, *_arrays(m)).open)
                out.append((windows(hashes, SPAN)[starts], i, row, starts))
            return _flat(out)

        return run

    return map_slices(matched, "window long, doc_id long, row long, start int", work, ["doc_id", "__row", "text", "__matches"])


def confirmed(boundary: DataFrame) -> DataFrame:
    """(doc_id, __row, __starts): boundary windows that also start in a smaller document."""
    rows = written(boundary)
    first = rows.groupBy("window").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = written(first.where("first < last").drop("last"))
    return skew_join(rows, first, "window", "row").where("doc_id > first").groupBy("doc_id", F.col("row").alias("__row")).agg(F.collect_set("start").alias("__starts"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with text of the kept words joined by one space (null stays null), n_words (before), n_removed.

    Columns of these two names are replaced.
    """
    docs, on = identified(docs), ["doc_id", "__row"]
    found = written(matches(docs))
    boundary = boundary_windows(docs.select(*on, "text").join(found, on))
    marks = found.join(confirmed(boundary), on, "left")

    def work():
        words_of = WordHash()

        def run(ids: list, texts: list, found: list, starts: list) -> list:
            out, n_words, n_removed = [], [], []
            for i, text, m, s in zip(ids, texts, found, starts, strict=True):
                words = split(text)
                gone = 0
                if m:
                    starts_here = Parsed(words_of.of(words), i, *_arrays(m)).sure
                    starts_here[s or []] = True
                    step = np.zeros(len(words) + 1, np.int64)
                    step[:-SPAN] += starts_here
                    step[SPAN:] -= starts_here
                    covered = np.cumsum(step[:-1]) > 0
                    gone = int(covered.sum())
                    if gone:
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                out.append(None if text is None else b" ".join(words).decode())
                n_words.append(len(words) + gone)
                n_removed.append(gone)
            return [out, n_words, n_removed]

        return run

    return rewrite(docs.join(marks, on, "left"), ["doc_id", "text", "__matches", "__starts"], "text string, n_words long, n_removed long", work)
