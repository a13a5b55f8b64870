"""Collapse of cumulative conversation snapshots, then rendering.

Loggers that store a conversation after every turn leave many conversations that are prefixes of longer ones. Each
conversation gets a rolling hash of its turns: position-weighted sums of turn hashes modulo two 31-bit primes, so the
hash of the first k turns is a running sum. A conversation whose hash of all turns equals a longer conversation's hash
of as many turns is dropped by an anti-join; of equal conversations the smallest conv_id stays. Length and four sums of
31 bits are compared, 124 bits over two independent hashes of each turn.

Turns are ordered by (turn, role, text), nulls first. Null roles and texts count as empty strings and render so; rows
with a null conv_id are left out, as they belong to no conversation. Repeated rows count as repeated turns. An empty table gives an empty result.
Columns other than conv_id, turn, role and text are not read and may have any names; turns of any length are hashed and rendered whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two primes below 2**31, so that products fit in 64 bits, and a base for each.
_FIELDS = ((2147483647, 1103515245), (2147483629, 69069069))


def _power(base: int, exponent: Column, prime: int) -> Column:
    """base ** exponent mod prime by the binary digits of exponent, as one expression without loops over rows."""
    factors = [F.when(F.shiftright(exponent, bit).bitwiseAND(F.lit(1)) == 1, F.lit(pow(base, 1 << bit, prime))).otherwise(F.lit(1)) for bit in range(31)]
    return reduce(lambda x, y: (x * y) % F.lit(prime), [f.cast("long") for f in factors])


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, position from 1, n, role, text, h1..h4): the hashes cover the turns up to this one of n.

    The four sums take two independent 64-bit turn hashes over two primes each; 124 bits together.
    """
    clean = turns.where("conv_id is not null").select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = clean.withColumn("position", F.row_number().over(ordered)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    key = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumn("a", F.xxhash64(key)).withColumn("b", F.xxhash64(F.concat(F.lit("#"), key)))
    until = ordered.rowsBetween(Window.unboundedPreceding, 0)
    for i, (value, (prime, base)) in enumerate([(v, f) for v in "ab" for f in _FIELDS], 1):
        term = (F.pmod(F.col(value), F.lit(prime)) * _power(base, F.col("position"), prime)) % F.lit(prime)
        # A running sum of terms below 2**31 stays exact for 2**32 turns.
        rows = rows.withColumn(f"h{i}", F.sum(term).over(until) % F.lit(prime))
    return rows.drop("a", "b", "turn")


_HASH = ["position", "h1", "h2", "h3", "h4"]


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal) of conversations that no longer conversation starts with; n_equal counts equal ones."""
    prefixes = rolling_prefixes(turns).select("conv_id", F.struct(*_HASH).alias("h"), (F.col("position") == F.col("n")).alias("whole"))
    whole = prefixes.where("whole").groupBy("h").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    # Distinct prefixes first: a first turn that a third of all conversations share becomes one row.
    proper = prefixes.where("not whole").select("h").distinct()
    return whole.join(proper, "h", "left_anti").select("conv_id", F.col("h.position").cast("long").alias("n_turns"), "n_equal")


def render(turns: DataFrame, conversations: DataFrame, *, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> DataFrame:
    """``conversations`` with ``rendered``: each turn as opening, role, line end, text, closing."""
    clean = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = clean.join(conversations, "conv_id")
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), "role", "text"))), lambda t: F.concat(F.lit(opening), t["role"], F.lit("\n"), t["text"], F.lit(closing)))
    return kept.groupBy("conv_id", *[c for c in conversations.columns if c != "conv_id"]).agg(F.array_join(said, "").alias("rendered"))


def collapse_and_render(turns: DataFrame, **style: str) -> DataFrame:
    """conv_id, n_turns, n_equal, rendered of each maximal conversation."""
    return render(turns, maximal_conversations(turns), **style)
