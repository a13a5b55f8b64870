"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct ``WORDS``-word shingles. Its sketch has ``BINS`` coordinates and is
filled in rounds: in round i < BINS each element is thrown into a random bin with value i + u, in round BINS + b every
element goes to bin b, so that each coordinate is filled, and a bin keeps its smallest value. Usually the first one or two
rounds fill all bins, which costs a few hashes per element in place of one per coordinate, with the concentration of
independent MinHashes. The first coordinates form ``BANDS`` bands of ``ROWS``; two sets of similarity 0.75 share no band with
probability (1 - 0.75^4)^32 = 5e-6, more similar ones far less. A bit of every coordinate estimates a candidate's
similarity to its leader: pairs whose bits differ by over 4.5 standard deviations more than those
of similarity 0.75 are let go (3e-6 of such pairs), which spares texts that only share a common passage.

Equal sets are one class from the start, so that copies cost one row. In every bucket (classes that share a band) members
are verified against one leader, links are merged to components, and this repeats with other leaders for buckets that
still hold several components. What is left, members outside a bucket's largest component against all members of other
components, goes through an exact prefix join: the sets' shingles are ordered by their frequency among these classes, rarest first,
and two sets can only link if they share a shingle at places that leave enough shingles behind it in both. Texts that share
a common part but fall short of the limit thus meet in few candidates or none, since their rare shingles come first. So each
pair that shares a bucket is verified, ruled out exactly, or already connected: no cap, no pairs inside a component. Links are
confirmed on full sets: 100 * |A n B| >= 75 * |A u B|. Joins on buckets, leaders and shingles split frequent keys.

Null texts and texts without words have the empty set and are linked with nothing. Rows that share a doc_id are one
document, linked. Rows with a null doc_id are returned alone, with a null component, and are no one's link. An empty table
gives an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import WordHash, distinct_sorted, freed, map_slices, mix, signed, skew_join, windows, written
from inkgauge.llm.components import smallest_reachable

WORDS, BINS, BANDS, ROWS, BITS = 5, 1024, 32, 4, 1
#: A link needs NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 75, 100
#: Rounds of leaders before the prefix join of what is left.
LEADER_ROUNDS = 2
#: Ids up to which a list of classes is broadcast.
BROADCAST_IDS = 1_000_000
_WORDS64 = [f"s{i}" for i in range(BINS * BITS // 64)]
_LINK = NUMERATOR / DENOMINATOR
#: Mean and variance of differing bits at the similarity of a link: BITS / 2 of each coordinate that differs.
_MEAN = BINS * (1 - _LINK) * BITS / 2
MOST_DIFFERING = int(_MEAN + 4.5 * (BINS * _LINK * (1 - _LINK) * (BITS / 2) ** 2 + BINS * (1 - _LINK) * BITS / 4) ** 0.5)
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    n = len(hashes)
    return distinct_sorted(windows(hashes, min(n, WORDS)) ^ np.uint64(min(n, WORDS))) if n else np.empty(0, np.uint64)


def sketch(elements: np.ndarray) -> np.ndarray:
    """BINS coordinates: round number in the upper 11 bits, the hashed value below."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    if not len(elements):
        return out
    step = max(1, min(BINS, 4096 // len(elements)))
    for first in range(0, BINS, step):  # small sets run several rounds at once; later rounds never beat earlier ones
        rounds = np.arange(first, min(first + step, BINS))
        h = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        value = (h >> np.uint64(11)) | (rounds.astype(np.uint64) << np.uint64(53))[:, None]
        np.minimum.at(out, (h & np.uint64(BINS - 1)).astype(np.int64).ravel(), value.ravel())
        if out.max() < np.iinfo(np.uint64).max:
            return out
    left = np.flatnonzero(out == np.iinfo(np.uint64).max)
    smallest = np.full(len(left), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 256):
        smallest = np.minimum(smallest, mix(elements[None, at : at + 256] ^ _SEEDS[BINS + left][:, None]).min(axis=1))
    out[left] = (smallest >> np.uint64(11)) | ((BINS + left).astype(np.uint64) << np.uint64(53))
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """A hash for each band, the band's number mixed in."""
    rows = coordinates[: BANDS * ROWS].reshape(-1, ROWS)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mix(h ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
    return h


def bits(coordinates: np.ndarray) -> np.ndarray:
    """BITS bits of each coordinate, packed into 64-bit words."""
    b = (mix(coordinates)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(b.astype(np.uint8).ravel()).view(np.uint64)


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if empty), bands, bits."""

    def work():
        words = WordHash()

        def run(ids: list, texts: list) -> list:
            out = []
            for i, text in zip(ids, texts, strict=True):
                s = shingles(words.of(_words(text)))
                if len(s):
                    c = sketch(s)
                    out.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signed(bands(c)), signed(bits(c))))
                else:
                    out.append((i, 0, None, None, None))
            return [list(x) for x in zip(*out, strict=True)]

        return run

    return map_slices(docs, "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>", work, ["doc_id", "text"])


def sets_of(docs: DataFrame) -> DataFrame:
    """class, elements: the shingle set of each row's text."""

    def work():
        words = WordHash()

        def run(ids: list, texts: list) -> list:
            return [ids, [signed(shingles(words.of(_words(t)))) for t in texts]]

        return run

    return map_slices(docs, "class long, elements array<long>", work, ["class", "text"])


def _of(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """``rows`` whose ``on`` is in ``wanted`` (distinct): broadcast up to BROADCAST_IDS, about 16 bytes each, else a shuffled join."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, on, "left_semi")


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return written(rows.groupBy(key).agg(F.count("*").alias("n")))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those candidate pairs (a, n_a, b, n_b) that link by their full sets."""
    sizes = (F.least("n_a", "n_b") * DENOMINATOR) >= (F.greatest("n_a", "n_b") * NUMERATOR)
    pairs = written(pairs.where(sizes).select("a", "b").distinct())
    by_a, by_b = _counted(pairs, "a"), _counted(pairs, "b")
    side = lambda x, by: _of(sets.select(F.col("class").alias(x), F.col("elements").alias(f"set_{x}")), by.select(x), x)
    left = skew_join(pairs, side("a", by_a), "a", "b", index=by_a)
    both = skew_join(left, side("b", by_b), "b", "a", index=by_b)
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(common * DENOMINATOR >= union * NUMERATOR).select("a", "b").distinct()


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    with freed() as keep:
        return keep(_components(docs))


def _components(docs: DataFrame) -> DataFrame:
    with freed() as keep:  # bands and bits of all rows go as soon as the classes that share buckets have theirs
        sketched = written(sketches(docs))
        rows = keep(sketched.select("doc_id", "n_shingles", "set_key"))
        classes = written(
            sketched.where("set_key is not null and doc_id is not null").groupBy("set_key")
            .agg(F.min("doc_id").alias("class"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"))
        )
        owners = keep(classes.select("set_key", "class"))
        members = classes.select("class", F.explode("bands").alias("band"))
        buckets = keep(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")))
        members = written(skew_join(members, buckets, "band", "class"))
        # A class whose buckets are large is near the middle of its group: the text that others were made from.
        central = keep(members.groupBy("class").agg(F.sum("size").alias("weight")))
        members = keep(members.join(central, "class"))
        # Only classes that share a bucket are ever compared: their sets are made once more from the texts and kept.
        traits = keep(_of(classes.select("class", "n", *[F.get("bits", F.lit(i)).alias(w) for i, w in enumerate(_WORDS64)]), central.select("class"), "class"))
    sets = written(sets_of(_of(docs.select(F.col("doc_id").alias("class"), "text"), central.select("class"), "class")))
    links = written(_same_documents(rows))
    roots = _roots_of(links)
    for turn in range(LEADER_ROUNDS + 1):
        with freed() as keep:
            open_members = _open(members, buckets, roots)
            if open_members.isEmpty():
                break
            pairs = _leader_pairs(open_members, traits, turn) if turn < LEADER_ROUNDS else _remaining_pairs(open_members, traits, sets)
            links = keep(links.unionByName(verified(pairs, sets)))
        roots = _roots_of(links)
    out = rows.join(owners, "set_key", "left")
    return out.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "class", "doc_id")).alias("component_id"))


def _roots_of(links: DataFrame) -> DataFrame:
    with freed() as keep:
        return keep(smallest_reachable(links))


def _same_documents(rows: DataFrame) -> DataFrame:
    """(a, b) between classes that rows of one doc_id belong to."""
    keyed = rows.where("set_key is not null and doc_id is not null")
    least = keyed.groupBy("set_key").agg(F.min("doc_id").alias("class"))
    several = keyed.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    return written(keyed.join(several, "doc_id").join(least, "set_key").select(F.col("doc_id").alias("a"), F.col("class").alias("b")).where("a <> b").distinct())


def _open(members: DataFrame, buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component and the bucket's largest one, of buckets that hold several components."""
    now = written(members.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("band", "class", "size", "weight", F.coalesce("root", "class").alias("root")))
    counts = now.groupBy("band", "root").agg(F.count("*").alias("size"))
    mixed = counts.groupBy("band").agg(F.sum("size").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("root", F.struct("size", "root")).alias("largest"))
    return written(skew_join(now, written(mixed.where("lo < hi").select("band", "n", "largest")), "band", "class"))


def _leader_pairs(members: DataFrame, traits: DataFrame, turn: int) -> DataFrame:
    """A pair for each class: with the weightiest plausible leader of its buckets.

    First a bucket's leader is its weightiest member, then the weightiest of its largest component, for members outside it,
    then the weightiest outside it.
    """
    rank = F.struct("weight", F.negative("class").alias("order"))
    if turn == 0:
        from_ = members
    elif turn % 2:
        from_ = members.where("root = largest")
    else:
        from_ = members.where("root <> largest")
    lead = F.struct("weight", "class", "root")
    leaders = written(from_.groupBy("band").agg(F.max("size").alias("n"), F.max_by(lead, rank).alias("leader")))
    asked = skew_join(members, leaders, "band", "class").where("root <> leader.root")
    pairs = written(asked.select("class", F.col("leader.class").alias("lead"), "leader.weight").distinct())
    mine = pairs.join(traits, "class")
    theirs = traits.select(F.col("class").alias("lead"), F.col("n").alias("n_lead"), *[F.col(w).alias(f"l{w}") for w in _WORDS64])
    both = skew_join(mine, theirs, "lead", "class", index=_counted(pairs, "lead"))
    both = both.where(_plausible([F.col(w) for w in _WORDS64], [F.col(f"l{w}") for w in _WORDS64]))
    best = both.groupBy("class", "n").agg(F.max(F.struct("weight", "lead", "n_lead")).alias("best"))
    return best.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("best.lead").alias("b"), F.col("best.n_lead").alias("n_b"))


def _plausible(x: list[Column], y: list[Column]) -> Column:
    """Whether two sketches' bits may be those of a link."""
    return reduce(lambda a, b: a + b, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x, y, strict=True)]) <= MOST_DIFFERING


def _remaining_pairs(members: DataFrame, traits: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of open classes, in different components and not both in their buckets' largest, that may link by their rarest shingles.

    With p shingles before the first common one in a set of n, at most n - p are common: both sides must leave
    NUMERATOR / (NUMERATOR + DENOMINATOR) of the sizes' sum, which is what a link shares at least.
    """
    classes = members.groupBy("class").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("largest")).alias("odd"))
    classes = written(classes.join(traits.select("class", "n"), "class"))
    each = written(_of(sets, classes.select("class"), "class").select("class", F.explode("elements").alias("e")))
    shared = written(each.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").withColumn("f", F.col("n")))
    # Shingles of one class alone come first of all: only their number matters.
    found = skew_join(each, shared, "e", "class").join(classes, "class")
    mine = Window.partitionBy("class")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("f", "e")) - 1
    prefix = written(found.withColumn("p", place).where((F.col("n") - F.col("p")) * DENOMINATOR >= F.col("n") * NUMERATOR).select("class", "root", "odd", "n", "e", "p"))
    met = prefix.groupBy("e").agg(F.count("*").alias("n"), F.max("odd").alias("odd"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    met = written(met.where("odd and lo < hi").select("e", "n"))
    side = lambda x: prefix.select("e", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "root", "odd", "n", "p")])
    left = side("a").where("odd_a").join(met.select("e"), "e", "left_semi")
    both = skew_join(left, side("b"), "e", "class_a", index=met)
    total = (F.col("n_a") + F.col("n_b")) * NUMERATOR
    enough = (F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) * (NUMERATOR + DENOMINATOR)) >= total
    # Pairs of two odd classes would meet twice.
    once = (F.col("class_a") < F.col("class_b")) | ~F.col("odd_b")
    pairs = both.where((F.col("root_a") != F.col("root_b")) & once & enough)
    return pairs.select(F.col("class_a").alias("a"), "n_a", F.col("class_b").alias("b"), "n_b").distinct()


def keep_smallest(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, its smallest doc_id; all columns kept.

    Of rows that share this doc_id all stay. Rows with a null doc_id or an empty set stay.
    """
    dropped = link_components(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
