"""Reversible, incremental line dedup: exact reference counts of line keys behind sharded cuckoo filters.

A line's key is the line without ASCII blanks at its ends, A-Z lower-cased, hashed to 128 bits. The index holds
* ``postings`` (key, doc_id): which document holds which key, distinct;
* ``fresh`` (key, n_docs, first_doc): a row per key, as it stood when the key first came;
* ``more`` (key, n_docs, first_doc): what later insertions added to keys; both together are the exact reference counts;
* ``filters`` (shard, n_keys, content): a cuckoo filter of the keys of each shard, of 16-bit fingerprints.
Inserting documents pre-aggregates their keys, so a line that a third of all documents hold is one row, and asks the
shard's filter: keys it doesn't know are certainly new and are appended to ``fresh`` unseen; only those it may know are looked
up in the exact table. Tables are appended to, never rewritten. So after all insertions the repeated keys are those that repeated
within one insertion or came again, and all other keys, which are most, are known to be single without a count over the whole.
Deleting documents takes their postings back, lowers the counts and removes keys that reach 0 from the filters, which Bloom
filters can't do. After an insertion and the deletion of the same documents, counts and the filters' answers are as before.

``dedup_lines`` inserts a table in ``BATCHES`` parts by a hash of doc_id: its result rests on the filters' answers.

Documents lose every line whose key has at least ``MIN_CHARS`` code points and is held by a smaller doc_id.

Null or empty texts are one empty line. Rows with a null doc_id hold no postings and keep all lines. Rows that share a
doc_id are one document to the counts, and each loses its own lines. Documents that the index holds already are not inserted
again: a repeated insertion has no effect. Empty tables give empty results. Of the other columns those named n_lines and n_dropped
are replaced, the rest are kept whatever their names are, except names that start with two underscores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm.common import BLANKS, map_slices, mix, rewrite, skew_join, written

MIN_CHARS = 10
#: Keys of one shard when an index is first filled; shards are what one task holds at a time.
SHARD_KEYS = 100_000
#: Insertions that a whole table is dealt over.
BATCHES = 4
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints of 64-bit hashes in buckets of four; a hash has two buckets, each found from the other."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.rng = np.random.default_rng(7)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(1, math.ceil(math.log2(max(1, n) / (SLOTS * 0.84)))), SLOTS), np.uint16))

    @classmethod
    def load(cls, content: bytes) -> CuckooFilter:
        return cls(np.frombuffer(content, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)  # 0 is an empty slot
        first = (hashes & mask).astype(np.int64)
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(hashes)
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> np.ndarray:
        """True where the hash found a place. A filter with refusals must be rebuilt larger from the exact table."""
        mark, first, second = self._places(hashes)
        placed = np.zeros(len(hashes), bool)
        for bucket in (first, second):
            left = np.flatnonzero(~placed)
            order = left[np.argsort(bucket[left], kind="stable")]
            b = bucket[order]
            nth = np.arange(len(b)) - np.searchsorted(b, b)  # among newcomers to this bucket
            empty = self.table[b] == 0
            goes = nth < empty.sum(axis=1)
            slot = np.argmax(empty.cumsum(axis=1) == (nth + 1)[:, None], axis=1)
            self.table[b[goes], slot[goes]] = mark[order[goes]]
            placed[order[goes]] = True
        for i in np.flatnonzero(~placed):
            placed[i] = self._kick(mark[i], int(first[i]))
        return placed

    def _kick(self, mark: np.uint16, bucket: int) -> bool:
        trail = []
        for _ in range(500):
            slot = int(self.rng.integers(SLOTS))
            trail.append((bucket, slot, self.table[bucket, slot]))
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket ^= int(self._jump(np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        for b, s, m in reversed(trail):  # as it was, so that no other key is lost
            self.table[b, s] = m
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Hashes must have been inserted."""
        mark, first, second = self._places(hashes)
        for m, a, b in zip(mark, first, second, strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == m)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def line_key(line: str) -> bytes | None:
    """128-bit key of a line, None if it is too short to be judged."""
    line = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= MIN_CHARS else None


def line_postings(docs: DataFrame) -> DataFrame:
    """(key, doc_id), distinct."""

    def work():
        def run(ids: list, texts: list) -> list:
            pairs = [(key, i) for i, t in zip(ids, texts, strict=True) if i is not None and t for key in {*map(line_key, t.split("\n"))} - {None}]
            return [[k for k, _ in pairs], [i for _, i in pairs]]

        return run

    return map_slices(docs, "key binary, doc_id long", work, ["doc_id", "text"])


def _hashes(keys) -> np.ndarray:
    return mix(np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)[:, 0].copy()) if len(keys) else np.empty(0, np.uint64)


def _probe_shard(keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Which keys of a shard its filter may hold."""
    known = CuckooFilter.load(state["content"].iloc[0]).contains(_hashes(keys["key"])) if len(state) and len(keys) else np.zeros(len(keys), bool)
    return keys.drop(columns="shard").assign(known=known)


def _fill_shard(room: float, change: int):
    """A shard's filter after distinct keys came in (change 1) or went out (-1); a new one has room for ``room`` times its keys."""

    def fill(keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        shard = int((keys if len(keys) else state)["shard"].iloc[0])
        content = CuckooFilter.load(state["content"].iloc[0]) if len(state) else CuckooFilter.sized(math.ceil(len(keys) * room))
        hashes = _hashes(keys["key"])
        full = False
        if change > 0:
            full = not content.insert(hashes).all()
        else:
            content.delete(hashes)
        return pd.DataFrame({"shard": [shard], "n_keys": [int(state["n_keys"].sum()) + change * len(keys)], "content": [content.dump()], "full": [full]})

    return fill


_FILTERS = "shard long, n_keys long, content binary"
_COUNTS = "key binary, n_docs long, first_doc long"


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))


@dataclass(frozen=True)
class LineIndex:
    """State of the dedup. Methods return new states; their tables are written."""

    shards: int
    postings: DataFrame
    fresh: DataFrame
    more: DataFrame
    filters: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> LineIndex:
        frame = lambda ddl: spark.createDataFrame([], ddl)
        return LineIndex(0, frame("key binary, doc_id long"), frame(_COUNTS), frame(_COUNTS), frame(_FILTERS))

    @property
    def counts(self) -> DataFrame:
        """(key, n_docs, first_doc): the exact reference counts."""
        return _summed(self.fresh.unionByName(self.more))

    def _sharded(self, keys: DataFrame):
        return keys.select(F.pmod(F.xxhash64("key"), F.lit(max(1, self.shards))).alias("shard"), *keys.columns).groupBy("shard").cogroup(self.filters.groupBy("shard"))

    def _filled(self, keys: DataFrame, change: int) -> LineIndex:
        """With the filters changed by distinct ``keys``; rebuilt larger from the exact table if one is full."""
        filters = written(self._sharded(keys.select("key")).applyInPandas(_fill_shard(1.0, change), _FILTERS + ", full boolean"))
        if not filters.where("full").isEmpty():
            return self.rebuilt()
        return replace(self, filters=filters.drop("full"))

    def rebuilt(self, room: float = 1.0) -> LineIndex:
        """The same counts, with filters of a fitting number of shards filled anew, with room for ``room`` times the keys held."""
        shards = max(1, math.ceil(self.counts.count() * room / SHARD_KEYS))
        bare = replace(self, shards=shards, filters=self.filters.limit(0))
        filters = written(bare._sharded(self.counts.select("key")).applyInPandas(_fill_shard(room, 1), _FILTERS + ", full boolean"))
        return replace(bare, filters=filters.drop("full")) if filters.where("full").isEmpty() else self.rebuilt(room * 1.1)

    def known(self, keys: DataFrame) -> DataFrame:
        """Distinct ``keys``, with their other columns, and known: whether the filters may hold them; ``false`` is certain."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
        return self._sharded(keys).applyInPandas(_probe_shard, schema + ", known boolean")

    def insert(self, docs: DataFrame, *, room: float = 1.0) -> LineIndex:
        """Add documents; those whose doc_id the index holds have no effect. ``room`` says how many times their keys a first filling makes room for."""
        new = line_postings(docs).distinct()
        if self.shards:
            new = new.join(self.postings.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id")
        return self._insert(written(new), room)

    def _insert(self, new: DataFrame, room: float) -> LineIndex:
        """Add the postings of documents that the index doesn't hold."""
        batch = written(new.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")))
        if not self.shards:
            return replace(self, postings=new, fresh=batch).rebuilt(room)
        asked = written(self.known(batch))
        maybe = asked.where("known").drop("known")
        # Only keys that the filters don't rule out are looked up in the exact table.
        held = written(self.fresh.select("key").join(maybe.select("key"), "key", "left_semi"))
        met = written(maybe.join(held, "key", "left_semi"))
        fresh = written(asked.where("not known").drop("known").unionByName(maybe.join(held, "key", "left_anti")))
        grown = replace(self, postings=self.postings.unionByName(new), fresh=self.fresh.unionByName(fresh), more=self.more.unionByName(met))
        return grown._filled(fresh, 1)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take back the documents in column doc_id; ids that the index doesn't hold change nothing."""
        gone = doc_ids.select("doc_id").distinct()
        taken = self.postings.join(gone, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("less"))
        left = written(self.postings.join(gone, "doc_id", "left_anti").select("key", "doc_id"))
        counts = written(self.counts)
        touched = counts.join(taken, "key")
        first = left.join(touched.select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("first_now"))
        now = written(touched.join(first, "key", "left").select("key", (F.col("n_docs") - F.col("less")).alias("n_docs"), F.col("first_now").alias("first_doc")))
        counts = written(counts.join(now, "key", "left_anti").unionByName(now.where("n_docs > 0")))
        return replace(self, postings=left, fresh=counts, more=self.more.limit(0))._filled(now.where("n_docs = 0"), -1)

    def repeated(self) -> DataFrame:
        """(key, first_doc, n): keys of several documents. Keys that came once and in one document only are not counted again."""
        again = self.more.select("key", F.lit(True).alias("again")).distinct()
        rows = self.fresh.join(again, "key", "left").where("n_docs > 1 or again").select(*self.more.columns).unionByName(self.more)
        return _summed(rows).where("n_docs > 1").select("key", "first_doc", F.col("n_docs").alias("n"))

    def drops(self) -> DataFrame:
        """(doc_id, __drops): the keys each document loses, those of several documents in all but the smallest."""
        lost = skew_join(self.postings, written(self.repeated()), "key", "doc_id").where("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("__drops"))


def drop_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` with text rewritten, and n_lines (before) and n_dropped; columns of these two names are replaced."""

    def work():
        def run(texts: list, dropped: list) -> list:
            out, before, less = [], [], []
            for text, keys in zip(texts, dropped, strict=True):
                lines = (text or "").split("\n")
                keys = set(map(bytes, keys or ()))
                kept = [x for x in lines if line_key(x) not in keys] if keys else lines
                out.append("\n".join(kept) if keys else text)
                before.append(len(lines))
                less.append(len(lines) - len(kept))
            return [out, before, less]

        return run

    return rewrite(docs.join(drops, "doc_id", "left"), ["text", "__drops"], "text string, n_lines long, n_dropped long", work)


def index_of(docs: DataFrame, *, batches: int = BATCHES) -> LineIndex:
    """All of ``docs``, inserted in parts by a hash of doc_id; texts are read once."""
    index = LineIndex.empty(docs.sparkSession)
    postings = written(line_postings(docs).distinct())
    for part in range(batches):
        index = index._insert(postings.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == part), float(batches))
    return index


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Index all of ``docs`` and drop their repeated lines."""
    return drop_lines(docs, index_of(docs).drops())
