"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become tokens (runs of letters, marks and digits, lower-cased). Numbers (digits or number words), units after numbers, and
names (capitalised words inside a sentence) become typed placeholders; the replaced words are the slots' values.
Windows of ``WIDTH`` tokens are hashed in three forms: with names replaced, with names as words, so that a text in capital
letters still matches, and with every capitalised word replaced, as a name may start a text, line or sentence or follow a quote
or bracket. Document windows are hash-joined with the benchmark's; a window is a hit if both sides' placeholders
and words are equal, and either the replaced words are equal too, or at least half the tokens are words and the slots are
consistent, as in a question asked again with other numbers and names. Consistency is checked over the whole occurrence of an
item (all windows at one distance between document and item): a value of one side that stands against several of the
other is inconsistent, and windows that hold it are hits only if their words are equal. A document is contaminated by an item if at
least ``least_hits`` of the item's windows are hit: half of them, or ``RUN_HITS``, the windows of 13 tokens.

Documents are read once: a window that meets the benchmark's hashes goes on with its tokens.

Items of fewer than ``WIDTH`` tokens are one window; those of fewer than ``MIN_TOKENS`` are too short to be recognised and match
nothing. A number of several words is several numbers. Null texts have no tokens. Null doc_ids are judged as one document named null. Rows that share a doc_id or item_id pool
their windows. Empty tables give no hits. Other columns of ``docs`` are not read; of the benchmark, item_id and text are.

The benchmark's windows are broadcast only up to ``BROADCAST_WINDOWS`` (about 100 bytes each), contaminated ids up to ``BROADCAST_IDS``; beyond, both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import written

WIDTH, MIN_TOKENS, RUN_HITS = 8, 5, 6
BROADCAST_WINDOWS, BROADCAST_IDS = 200_000, 1_000_000
#: Words that are units when they follow a number.
UNITS = (
    "percent pct mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs min mins h hr hrs second seconds minute minutes hour hours day days "
    "week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros degree degrees "
    "celsius fahrenheit volt volts watt watts joule joules newton newtons mph kmh kph hz khz mhz ghz kb mb gb tb"
).split()
#: Words that are numbers.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
#: Marks a name's first character; no text keeps it.
_NAME = "\x01"
#: Marks the first character of other capitalised words, which may be names too.
_START = "\x02"


def marked(text: Column) -> Column:
    """The text with capitalised words marked, those inside a sentence as names."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(F.contains(t, F.lit(_NAME)) | F.contains(t, F.lit(_START)), F.translate(t, _NAME + _START, " \x03")).otherwise(t)
    t = F.regexp_replace(t, r"\p{Lu}(?<![\p{L}\p{M}\p{N}]\p{Lu})(?=\p{Ll})", f"{_START}$0")
    return F.regexp_replace(t, rf" {_START}(?<=[\p{{Ll}}\p{{N}},;] {_START})", f" {_NAME}")


def tokens(t: Column) -> Column:
    """Lower-cased tokens of a marked text; names start with _NAME, other capitalised words with _START."""
    numbered = t
    for _ in range(2):  # marks inside numbers
        numbered = F.regexp_replace(numbered, r"([0-9])[.,]([0-9])", "$1$2")
    t = F.when(t.rlike(r"[0-9][.,][0-9]"), numbered).otherwise(t)
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}{_NAME}{_START}]+"), lambda w: w != "")


def _is_number(w: Column) -> Column:
    return F.ascii(w).between(48, 57) | w.isin(NUMBERS)


def _bare(w: Column) -> Column:
    return F.ltrim(w, F.lit(_NAME + _START))


def forms(marked_words: Column, of=lambda c: c) -> tuple[Column, Column, Column]:
    """``of`` each token in the plain, named and open form, from tokens with their marks."""
    put = lambda kind: of(F.lit(kind))

    def plain(w: Column, i: Column) -> Column:
        word = F.ltrim(w, F.lit(_START))
        after_number = F.coalesce(_is_number(F.ltrim(F.get(marked_words, i - 1), F.lit(_START))), F.lit(False))
        return F.when(_is_number(word), put("<num>")).when(word.isin(UNITS) & after_number, put("<unit>")).otherwise(of(_bare(w)))

    first = F.transform(marked_words, plain)
    named = F.zip_with(marked_words, first, lambda w, f: F.when(F.ascii(w) == 1, put("<name>")).otherwise(f))
    return first, named, F.zip_with(marked_words, named, lambda w, f: F.when(F.ascii(w) == 2, put("<name>")).otherwise(f))


def _hash(at, width: int) -> Column:
    """Hash of a window from its tokens' hashes, at(0) to at(width - 1)."""
    return F.xxhash64(*[at(k) for k in range(width)])


def _token_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, all (tokens with marks) and the hashes of their three forms; a form is null where it is the one before."""
    t = docs.select("doc_id", marked(F.col("text")).alias("t"))
    rows = t.select("doc_id", tokens(F.col("t")).alias("all"), F.contains("t", F.lit(_NAME)).alias("names"), F.contains("t", F.lit(_START)).alias("starts"))
    plain, _, _ = forms(F.col("all"), F.xxhash64)
    rows = rows.select("*", plain.alias("plain"))
    name = F.xxhash64(F.lit("<name>"))
    with_names = lambda mark, before: F.zip_with("all", before, lambda w, h: F.when(F.ascii(w) == mark, name).otherwise(h))
    rows = rows.select("*", F.when(F.col("names"), with_names(1, F.col("plain"))).alias("named"))
    return rows.select("doc_id", "all", "plain", "named", F.when(F.col("starts"), with_names(2, F.coalesce("named", "plain"))).alias("open"))


def document_windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, width, hash, place (from 1), all of each window in its one to three forms.

    Windows are made one by one inside the generated code that looks them up, not as arrays.
    """
    rows = _token_hashes(docs).select("*", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width"))
    rows = rows.where(F.size("all") >= F.col("width")).select("*", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("width") + 1)).alias("place"))

    def window(form: str) -> Column:
        out = F.lit(None).cast("bigint")
        for w in widths:
            out = F.when(F.col("width") == w, _hash(lambda k: F.get(F.col(form), F.col("place") - 1 + k), w)).otherwise(out)
        return F.when(F.col(form).isNotNull(), out)

    rows = rows.select("doc_id", "all", "width", "place", window("plain").alias("h0"), window("named").alias("h1"), window("open").alias("h2"))
    each = F.array("h0", F.when(F.col("h1") != F.col("h0"), F.col("h1")), F.when(F.col("h2") != F.coalesce("h1", "h0"), F.col("h2")))
    return rows.select("doc_id", "all", "width", "place", F.explode(each).alias("hash")).where("hash is not null")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, width, hash, place, n_windows, words and the three forms of each window."""
    prepared = benchmark.select("item_id", tokens(marked(F.col("text"))).alias("all")).where(F.size("all") >= MIN_TOKENS)
    plain, named, opened = forms(F.col("all"))
    prepared = written(prepared.select("item_id", F.transform("all", _bare).alias("words"), plain.alias("plain"), named.alias("named"), opened.alias("open")))
    width = F.least(F.lit(WIDTH), F.size("words"))
    rows = prepared.select("*", width.alias("width"), F.explode(F.sequence(F.lit(1), F.size("words") - width + 1)).alias("place"))
    rows = rows.select("item_id", "width", "place", *[F.slice(c, "place", "width").alias(c) for c in ("words", "plain", "named", "open")])
    totals = rows.groupBy(F.col("item_id").alias("of_item")).agg(F.count("*").alias("n_windows"))
    token = lambda form: lambda k: F.xxhash64(F.get(form, F.lit(k)))
    hashes = F.lit(None).cast("array<bigint>")
    for w in range(MIN_TOKENS, WIDTH + 1):
        hashes = F.when(F.col("width") == w, F.array(*[_hash(token(form), w) for form in ("plain", "named", "open")])).otherwise(hashes)
    rows = rows.select("*", F.explode(F.array_distinct(hashes)).alias("hash"))
    return written(rows.join(totals, F.col("item_id").eqNullSafe(F.col("of_item"))).drop("of_item"))


def _slots(words: Column, form: Column) -> Column:
    """For each placeholder the place of its value's first occurrence among the slots: equal patterns are consistent in a window."""
    values = F.filter(F.transform(words, lambda w, i: F.when(F.get(form, i).isin("<num>", "<unit>", "<name>"), w)), lambda w: w.isNotNull())
    return F.transform(values, lambda v: F.array_position(values, v))


def _literal(form: Column) -> Column:
    return 2 * F.size(F.filter(form, lambda w: ~w.isin("<num>", "<unit>", "<name>"))) >= F.size(form)


def _matching(docs: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """doc_id, item_id, n_windows, d_place, place, same (words are equal), slots (kind, document's value, item's value) of windows that match by themselves."""
    widths = [r["width"] for r in items.select("width").distinct().collect()] or [WIDTH]  # at most WIDTH values
    keys = items.select("width", "hash").distinct()
    met = document_windows(docs, widths).join(F.broadcast(keys) if small else keys, ["width", "hash"], "left_semi")
    # The token before a window tells whether its first one is a unit.
    around = F.concat(F.array(F.coalesce(F.get("all", F.col("place") - 2), F.lit(""))), F.slice("all", F.col("place"), F.col("width")))
    met = written(met.select("doc_id", "width", "hash", F.col("place").alias("d_place"), around.alias("around")))
    inner = lambda c: F.slice(c, 2, F.col("width"))
    plain, named, opened = forms(F.col("around"))
    met = met.select("doc_id", "width", "hash", "d_place", inner(F.transform("around", _bare)).alias("d_words"), inner(plain).alias("d_plain"), inner(named).alias("d_named"), inner(opened).alias("d_open"))
    both = met.join(F.broadcast(items) if small else items, ["width", "hash"])
    same = F.col("d_words") == F.col("words")
    form = F.lit(None).cast("array<string>")
    for name in ("open", "named", "plain"):  # the first that matches, in reverse
        d, b = F.col(f"d_{name}"), F.col(name)
        form = F.when((d == b) & (same | (_literal(b) & (_slots(F.col("d_words"), d) == _slots(F.col("words"), b)))), b).otherwise(form)
    both = both.select("doc_id", "item_id", "n_windows", "d_place", "place", "d_words", "words", same.alias("same"), form.alias("form")).where("form is not null")
    slot = F.transform("form", lambda f, i: F.when(f.isin("<num>", "<unit>", "<name>"), F.struct(f.alias("kind"), F.get("d_words", i).alias("d"), F.get("words", i).alias("b"))))
    return both.select("doc_id", "item_id", "n_windows", "d_place", "place", "same", F.filter(slot, lambda x: x.isNotNull()).alias("slots")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_hits (distinct item windows hit), n_windows, before the least number is asked for."""
    items = benchmark_windows(benchmark)
    found = _matching(docs.select("doc_id", "text"), items, items.count() <= BROADCAST_WINDOWS)
    occurrence = ["doc_id", "item_id", "n_windows", "shift"]
    slots = found.select(*occurrence[:3], (F.col("d_place") - F.col("place")).alias("shift"), "place", "same", F.explode_outer("slots").alias("slot"))
    slots = slots.select(*occurrence, "place", "same", "slot.*")
    several = lambda value, of: F.min(value).over(Window.partitionBy(*occurrence, "kind", of)) < F.max(value).over(Window.partitionBy(*occurrence, "kind", of))
    judged = slots.withColumn("broken", F.coalesce(several("d", "b") | several("b", "d"), F.lit(False)))
    windows = judged.groupBy(*occurrence, "place", "same").agg(F.max("broken").alias("broken")).where("same or not broken")
    return windows.groupBy("doc_id", "item_id", "n_windows").agg(F.count_distinct("place").alias("n_hits")).select("doc_id", "item_id", "n_hits", "n_windows")


def least_hits(n_windows: Column) -> Column:
    return F.least(F.lit(RUN_HITS), F.ceil(n_windows / 2))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_hits, n_windows of each contaminated document and item."""
    return hits(docs, benchmark).where(F.col("n_hits") >= least_hits(F.col("n_windows")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; all columns kept."""
    bad = written(contaminated(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")
