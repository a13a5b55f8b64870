"""Text expressions: normal forms, edit distances, error rates and the text-derived confidence. Columns in, columns out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The 29 characters that count as white space, beyond what Java's \s holds.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: All but letters, digits, underscore and white space; combining marks are not word characters here.
NON_WORD = r"[^\p{L}\p{N}_]"

# Words that count as plausible.
VOCABULARY = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she "
    "or an will my one all would there their what so up out if about who get which go me when make can like time no "
    "just him know take people into year your good some could them see other than then now look only come its over "
    "think also back after use two how our work first well way even new want because any these give day most us is "
    "are was were been has had did does student answer question exam write writing story paragraph letter chart graph "
    "electricity artificial intelligence ai technology hardware software tasks human brain brains used widely sectors "
    "sector testing nursing training doctors doctor define problem problems precisely precise help students making "
    "notes note freelancer freelancers fast saves save both energy seen increasing rapidly number numbers ans true "
    "false point points science education knowledge information system systems device devices digital modern future "
    "world life communication process result results computer computers internet data machine"
).split()
# Characters that mark a token as noise, and endings that make a token plausible.
NOISE = r"[\^~`|{}\[\]<>\\]"
ENDINGS = "(ing|ed|ly|s|tion)$"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts that aren't ASCII reach Python: the others are passed on as null and stay in the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def split_words(text: Column) -> Column:
    """Tokens between white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda t: t != "")


def normalize_for_cer(text: Column, *, composed: bool = False) -> Column:
    """NFC, lower case, runs of white space to one blank, ends stripped; null to ''. composed=True: text is NFC already."""
    text = F.coalesce(text, F.lit(""))
    return strip(F.regexp_replace(F.lower(text if composed else nfc(text)), f"{WS}+", " "))


def normalize_for_wer(text: Column, *, composed: bool = False) -> Column:
    """Tokens after NFC, lower case, and without characters that are neither word characters nor white space."""
    text = F.coalesce(text, F.lit(""))
    kept = F.regexp_replace(F.lower(text if composed else nfc(text)), r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]", "")
    return split_words(kept)


def safe_normalize(text: Column, *, composed: bool = False) -> Column:
    """NFC, line ends to \\n, blanks and tabs of each line to one blank, lines and text stripped; case and marks stay."""
    text = F.coalesce(text, F.lit(""))
    unix = F.replace(F.replace(text if composed else nfc(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(unix, "\n", -1), lambda line: strip(F.regexp_replace(line, "[ \t]+", " ")))
    return strip(F.array_join(lines, "\n"))


def char_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


#: Code points of the planes above the first, which hold no surrogates.
_PLANES = 0x10000, 0x100000


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays: distinct tokens become single characters, then the built-in distance.

    Characters are taken from the 16 planes above the first: over a million distinct tokens in a pair, beyond which the distance,
    which takes the product of both lengths, could not be had anyway; such a pair raises an error rather than count wrongly.
    """
    first, most = _PLANES
    known = F.array_distinct(F.concat(a, b))
    place = lambda t, k: F.array_position(k, t) + F.lit(first - 1)
    code = lambda xs, k: F.array_join(F.transform(xs, lambda t: F.decode(F.unhex(F.lpad(F.hex(place(t, k)), 8, "0")), "UTF-32")), "")
    # As a lambda's variable the distinct tokens are made once a pair, not once a token.
    distance = F.get(F.transform(F.array(known), lambda k: F.levenshtein(code(a, k), code(b, k))), F.lit(0))
    return F.when(F.size(known) <= most, distance).otherwise(F.raise_error(F.lit(f"over {most} distinct tokens in one pair")).cast("int"))


def error_rate(distance: Column, size: Column, hyp_size: Column) -> Column:
    """distance / size of the reference; against an empty reference 0 if the hypothesis is empty too, else 1."""
    return F.when(size == 0, F.when(hyp_size == 0, 0.0).otherwise(1.0)).otherwise(distance / size)


def cer(hyp: Column, ref: Column, *, normalize: bool = False, composed: bool = False) -> Column:
    """Character error rate; may exceed 1. Null texts count as empty."""
    if normalize:
        hyp, ref = normalize_for_cer(hyp, composed=composed), normalize_for_cer(ref, composed=composed)
    hyp, ref = F.coalesce(hyp, F.lit("")), F.coalesce(ref, F.lit(""))
    return error_rate(char_distance(hyp, ref), F.char_length(ref), F.char_length(hyp))


def wer(hyp: Column, ref: Column, *, normalize: bool = False) -> Column:
    """Word error rate over tokens; may exceed 1. With normalize=True texts must be NFC already.

    Tokens are used inside lambda functions, where a Python UDF can't stand: apply ``nfc`` in a projection before.
    """
    tokens = (lambda t: normalize_for_wer(t, composed=True)) if normalize else split_words
    return wer_of_tokens(tokens(hyp), tokens(ref))


def wer_of_tokens(hyp: Column, ref: Column) -> Column:
    return error_rate(word_distance(hyp, ref), F.size(ref), F.size(hyp))


def largest_repeat(tokens: Column) -> Column:
    """Count of the most frequent token: the longest run of the sorted array, in one pass."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(acc["last"] == t, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(tokens), start, step, lambda acc: acc["best"])


def clean_words(text: Column) -> Column:
    """Lower-cased tokens without characters that are neither letters, digits, underscore nor white space."""
    return split_words(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]", "")))


def derived_confidence(text: Column, *, digits: int | None = 4, tokens: Column | None = None, clean: Column | None = None) -> Column:
    """Plausibility of a text as clean English prose, 0.05 to 0.99; null for blank texts. digits=None: unrounded.

    ``tokens`` and ``clean`` are split_words and clean_words of the text, if they are columns already: an expression is
    evaluated once per use.
    """
    tokens = split_words(text) if tokens is None else tokens
    clean = clean_words(text) if clean is None else clean
    n = F.size(tokens)
    plausible = F.size(F.filter(clean, lambda t: (F.char_length(t) <= 2) | t.isin(VOCABULARY) | t.rlike(ENDINGS)))
    # Few texts hold a noise character at all.
    noise = F.when(text.rlike(NOISE), F.size(F.filter(tokens, lambda t: t.rlike(NOISE)))).otherwise(0)
    # n > 0 below, as blank texts are null; the parts are those of the formula, in its order of operations.
    mean_length = F.char_length(F.array_join(tokens, "")) / n
    lexical = (1.0 - plausible / F.greatest(F.lit(1), F.size(clean))) * 0.10
    fragments = (1.0 - F.size(clean) / n) * 0.15
    odd_length = F.when((mean_length > 15) | (mean_length < 2), 0.2).otherwise(0.0)
    # No token can repeat more often than tokens are left over by the distinct others.
    most = (n - F.size(F.array_distinct(tokens)) + 1) / n
    repeated = F.when((n > 10) & (most > 0.35) & (largest_repeat(tokens) / n > 0.35), 0.3).otherwise(0.0)
    score = F.lit(0.99) - lexical - noise / n * 0.50 - fragments - odd_length - repeated
    score = F.greatest(F.lit(0.05), F.least(F.lit(0.99), score))
    return F.when(n > 0, score if digits is None else F.round(score, digits))


def with_derived_confidence(rows: DataFrame, text: str = "text", *, column: str = "confidence", digits: int | None = 4) -> DataFrame:
    """``rows`` with the derived confidence of a text column; its tokens are made once."""
    rows = rows.withColumn("__tokens", split_words(F.col(text))).withColumn("__clean", clean_words(F.col(text)))
    score = derived_confidence(F.col(text), digits=digits, tokens=F.col("__tokens"), clean=F.col("__clean"))
    return rows.withColumn(column, score).drop("__tokens", "__clean")


def bin_label(lo: float, hi: float) -> str:
    return f"{lo:.1f}-{hi:.1f}"


def alias(name: Column) -> Column:
    """Canonical form of a method or backend name."""
    return F.lower(strip(name))
