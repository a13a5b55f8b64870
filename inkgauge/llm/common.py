"""Helpers shared by the corpus operators: word hashing, batch iteration, joins that split frequent keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.storage import freed, shared_folder, written  # noqa: F401  for the operators

#: The six ASCII white-space characters that separate words: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A Python worker handles at most so many rows, and about so many bytes, at once.
SLICE, SLICE_BYTES = 1024, 2_000_000
#: Spark sends a worker batches of about so many bytes (or one row), unless the session says otherwise. Its own 64 MB, or
#: 10,000 rows, lie several times in the JVM's and the worker's memory.
BATCH_BYTES = 4 << 20
#: Entries, and bytes of words and values, of one generation of a worker's word cache; two generations are held.
CACHE_WORDS, CACHE_BYTES = 200_000, 24_000_000
#: A key with over 1 / PIECES of a task's fair share of a join's rows is split into pieces of that size.
PIECES, LEAST_PIECE = 4, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """A-Z to lower case, other letters unchanged."""
    return F.translate(column, UPPER, LOWER)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = min(SLICE, max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory to the system. A Python worker lives from task to task and from stage to stage, so what one
    task has freed would stay beside the JVM's memory while the next stage runs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        return


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over small batches, which gives memory back when a task's rows are done. Sets the session's batch bytes if unset."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(whole, schema)


def map_slices(df: DataFrame, schema: str, work: Callable[[], Callable[[list[dict], list], list]], columns: list[str]) -> DataFrame:
    """Run ``work()`` once per task, then its result on slices of the rows.

    The inner function gets one list per input column and returns one list or array per output column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = work()
        for batch in batches:
            for part in slices(batch):
                out = inner(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                arrays = [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, type=f.type) for x, f in zip(out, target, strict=True)]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return map_arrow(df.select(*columns), run, schema)


class Remembered:
    """Values of words that ``compute`` gives for lists of words. Words not met for a generation are forgotten.

    A generation ends at ``limit`` words or CACHE_BYTES of their texts, or with the call that exceeds them.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = CACHE_WORDS) -> None:
        self.compute, self.limit, self.now, self.past, self.size = compute, limit, {}, {}, 0

    def get(self, word):
        """The value of a remembered word, else None."""
        return self.now.get(word, self.past.get(word))

    def of(self, words: set) -> dict:
        """A mapping that holds all of ``words``."""
        fresh = words.difference(self.now)
        if self.now and (len(self.now) + len(fresh) > self.limit or self.size > CACHE_BYTES):
            self.now, self.past, fresh, self.size = {}, self.now if self.size <= CACHE_BYTES else {}, words, 0
        past, new = self.past, []
        for w in fresh:
            if w in past:
                self.now[w] = past[w]
            else:
                new.append(w)
        self.size += sum(map(len, fresh))
        self.now.update(zip(new, self.compute(new), strict=True))
        return self.now


class WordHash(dict):
    """Word (bytes) to a 64-bit hash; the same on every worker. Emptied when it holds CACHE_WORDS or CACHE_BYTES."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS or self.size >= CACHE_BYTES:
            self.clear()
            self.size = 0
        self.size += len(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries; empty if there are fewer."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def rewrite(df: DataFrame, inputs: list[str], added: str, work: Callable[[], Callable[..., list]]) -> DataFrame:
    """``df`` with columns computed in Python: ``added`` (DDL) replaces columns of the same names, others stay as they are.

    ``work()`` runs once per task; its result gets one list per column of ``inputs`` and returns one list per added
    column. Inputs that start with ``__`` are helpers and don't appear in the result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in new.names and not f.name.startswith("__")]
    schema = StructType([*kept, *new.fields])
    target = to_arrow_schema(StructType(new.fields))
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = work()
        for batch in batches:
            for part in slices(batch):
                out = inner(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs])
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept_names]
                arrays += [pa.array(x, type=f.type) for x, f in zip(out, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_arrow(df, run, schema)


def skew_join(rows: DataFrame, other: DataFrame, key: str, spread: str, *, index: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` and ``other`` on ``key`` that splits frequent keys.

    ``index`` (``other`` itself by default) has one row per key and in column ``n`` the number of rows with it. Keys that would
    fill a good part of a task are dealt by a hash of column ``spread`` over pieces, and the other side's rows are repeated for
    each piece. At most PIECES keys per shuffle partition can be so frequent, which bounds what is broadcast. ``index`` should
    be a written table; its ``n`` isn't in the result.
    """
    spark = rows.sparkSession
    own = index is None
    index = other if own else index
    total = index.agg(F.sum("n")).first()[0] or 0
    piece = max(LEAST_PIECE, total // (PIECES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    heavy = F.broadcast(index.where(F.col("n") > piece).select(key, F.ceil(F.col("n") / piece).cast("int").alias("__pieces")))
    dealt = rows.join(heavy, key, "left").withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__pieces")), F.lit(0)).cast("int")).drop("__pieces")
    copies = other.drop("n") if own else other
    copies = copies.join(heavy, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    return dealt.join(copies, [key, "__piece"]).drop("__piece")


def distinct_sorted(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h
