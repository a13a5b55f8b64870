import random
import zlib
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import __spark_entry__ as entry
from inkgauge.llm import chat_collapse, common, cuckoo_lines, harmonic_packing, mcd_quality, minhash_dedup, queries, rlz_substring, template_decontam, token_counts, url_rules, zstd_langid
from tests.conftest import SF
from tests.llm import brute

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def frame(spark, rows):
    """Documents of (doc_id, text), in two partitions."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(2)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    passage = " ".join(f"shared{i}" for i in range(70))
    base = [f"tok{i}" for i in range(120)]
    rng = random.Random(2)
    extra = [None, "", "   \n\t ", "one", "one two", "One TWO", LONG, LONG + " end", f"a b c {passage} d e", f"{passage}", f"x\n{passage}\ny {passage}", "same line of text here\nother", "SAME line of text here  \r\nmore", "same line of text here\nsame line of text here"]
    for k in range(12):  # near copies of each other
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        extra.append(" ".join(w))
    return rows + [(100_000 + i, t) for i, t in enumerate(extra)]


def test_near_duplicates(spark, corpus):
    got = minhash_dedup.link_components(frame(spark, corpus)).collect()
    want = brute.components(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(corpus)
    kept = minhash_dedup.keep_smallest(frame(spark, corpus))
    assert kept.columns == DOCS.names
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_near_duplicate_groups_without_a_centre(spark):
    # A chain: neighbours link, others don't; and a crowd of pairs just below the limit.
    words = [f"c{i}" for i in range(400)]
    chain = [(i, " ".join(words[10 * i : 10 * i + 100])) for i in range(20)]
    rng = random.Random(8)
    crowd = []
    for i in range(60):
        w = [f"b{k}" for k in range(150)]
        for _ in range(rng.randint(2, 8)):
            w[rng.randrange(150)] = f"r{rng.random()}"
        crowd.append((1000 + i, " ".join(w)))
    docs = chain + crowd
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.link_components(frame(spark, docs)).collect()}
    assert got == brute.components(docs)


def test_near_misses_make_no_pairs(spark, monkeypatch):
    # Texts that share 200 words of 280: similarity about 0.70, so no links, and no candidate for each pair either.
    made = []
    known = minhash_dedup._remaining_pairs

    def counted(*a):
        pairs = known(*a)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash_dedup, "_remaining_pairs", counted)
    rng = random.Random(4)
    docs = [(i, " ".join([f"c{k}" for k in range(200)] + [f"u{i}x{k}" for k in range(80 + rng.randint(-3, 3))])) for i in range(150)]
    # A late link between two of them must still be found.
    docs.append((500, docs[9][1] + " more words at the end"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.link_components(frame(spark, docs)).collect()}
    assert got == brute.components(docs) and got[500][1] == 9
    assert sum(made) < len(docs)


def test_frequent_keys_are_split_and_lose_nothing(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id") % 500).cast("long").alias("k"), F.col("id").alias("v"))
    index = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    got = common.skew_join(rows, index, "k", "v")
    assert sorted(map(tuple, got.select("k", "v", "low").collect())) == sorted(map(tuple, rows.join(index.drop("n"), "k").select("k", "v", "low").collect()))


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:500], rng.integers(0, 2**63, 100).astype(np.uint64)])
    x, y = minhash_dedup.sketch(a), minhash_dedup.sketch(b)
    assert (x < np.iinfo(np.uint64).max).all() and abs((x == y).mean() - 500 / 700) < 0.08
    for n in (1, 2, 7, 40):
        small = minhash_dedup.sketch(a[:n])
        assert (small < np.iinfo(np.uint64).max).all() and (small == minhash_dedup.sketch(a[:n][::-1])).all()


def test_substring_dedup(spark, corpus):
    got = rlz_substring.remove_repeats(frame(spark, corpus)).collect()
    want = brute.without_repeats(corpus)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.n_removed, (r.text or "").encode()) == want[r.doc_id], r.doc_id


def test_substring_dedup_boundaries(spark):
    # Passages of 49, 50 and 51 words, references in several smaller documents, overlaps of them, and repeats inside one document.
    p = [f"p{i}" for i in range(120)]
    docs = [(1, " ".join(["a"] + p[:60])), (2, " ".join(p[40:110] + ["b"])), (3, " ".join(p)), (4, " ".join(["q"] + p[:49] + ["r"])), (5, " ".join(["q2"] + p[:50] + ["r"])), (6, " ".join(p[5:56])), (7, " ".join(["z"] * 130)), (8, " ".join(["z"] * 60)), (9, " ".join(p[:60] + p[:60]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text.encode()) for r in rlz_substring.remove_repeats(frame(spark, docs)).collect()}
    assert got == brute.without_repeats(docs)


def test_rows_of_one_id_are_parsed_by_themselves(spark):
    passage = [f"p{i}" for i in range(80)]
    a, b, c = (" ".join([f"{x}{i}" for i in range(45)] + passage) for x in "abc")
    own = " ".join(f"own{i}" for i in range(90))
    # Row (3, c) would continue at the displacement of row (2, b) if both were one reference.
    rows = [(0, a), (1, b), (1, own), (2, own), (2, b), (3, c), (3, c), (4, " ".join(passage[:60]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in rlz_substring.remove_repeats(frame(spark, rows)).collect())
    want = []
    for i, t in rows:
        before = [(j, x) for j, x in rows if j < i]
        want.append((i, *brute.without_repeats([*((k, x) for k, (_, x) in enumerate(before)), (10**6, t)])[10**6]))
    assert got == sorted((i, n, gone, x.decode()) for i, n, gone, x in want)
    assert [x[2] for x in got if x[3] == own] == [0]
    lines = [(0, "a line that repeats\nown line of zero"), (1, "A LINE that repeats \nkept line of one"), (1, "kept line of one\nsome other line"), (2, "kept line of one")]
    found = sorted((r.doc_id, r.text) for r in cuckoo_lines.dedup_lines(frame(spark, lines)).collect())
    assert found == [(0, lines[0][1]), (1, "kept line of one"), (1, "kept line of one\nsome other line"), (2, "")]


def test_line_dedup_rests_on_the_filters(spark):
    docs = [(i, f"the same line of all\nonly in document {i}") for i in range(8)]
    first, second = frame(spark, docs[:1]), frame(spark, docs[1:2])
    index = cuckoo_lines.LineIndex.empty(spark).insert(first)
    lost = lambda x: sorted(r.doc_id for r in x.drops().collect())
    assert lost(index.insert(second)) == [1]
    # A filter that forgets makes known keys look new: they are then counted apart.
    lying = replace(index, filters=index.filters.limit(0))
    assert lost(lying.insert(second)) == []
    again = index.insert(first)
    assert state(again) == state(index) and again.postings.count() == index.postings.count()


def test_line_dedup(spark, corpus):
    got = cuckoo_lines.dedup_lines(frame(spark, corpus)).collect()
    want = brute.without_lines(corpus)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.text or "") == want[r.doc_id], r.doc_id


def state(index):
    return sorted(map(tuple, index.counts.select("key", "n_docs", "first_doc").collect()))


def test_line_index_is_incremental_and_reversible(spark, corpus):
    half = len(corpus) // 2
    first, second = frame(spark, corpus[:half]), frame(spark, corpus[half:])
    index = cuckoo_lines.LineIndex.empty(spark).insert(first)
    both = index.insert(second)
    whole = cuckoo_lines.LineIndex.empty(spark).insert(frame(spark, corpus))
    assert state(both) == state(whole)
    drops = lambda x: {r.doc_id: set(map(bytes, r["__drops"])) for r in x.drops().collect()}
    assert drops(both) == drops(whole)
    back = both.delete(second.select("doc_id"))
    assert state(back) == state(index) and drops(back) == drops(index)
    keys = both.counts.select("key")
    assert both.known(keys).where("not known").count() == 0
    assert back.known(back.counts.select("key")).where("not known").count() == 0
    gone = both.delete(frame(spark, corpus).select("doc_id"))
    assert state(gone) == [] and gone.known(keys).where("known").count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    f = cuckoo_lines.CuckooFilter.sized(len(h))
    assert f.insert(h).all() and f.contains(h).all()
    other = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    assert f.contains(other).mean() < 0.001
    f = cuckoo_lines.CuckooFilter.load(f.dump())
    f.delete(h[:10_000])
    assert f.contains(h[10_000:]).all() and f.contains(h[:10_000]).mean() < 0.001
    tiny = cuckoo_lines.CuckooFilter.sized(4)
    placed = tiny.insert(h[:64])
    assert not placed.all() and tiny.contains(h[:64][placed]).all()


def test_token_counts(spark, corpus):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    odd = ["".join(rng.choices(" \n\t▁abtheinon<>/s12é漢\xa0　\x00🙂", k=rng.choice([1, 3, 20, 80]))) for _ in range(300)] + ["a" * 5000, " " * 4000, "=" * 3000, "<s></s>", "x\n" * 500]
    rows = corpus + [(200_000 + i, t) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, rows), path).collect()}
    for i, t in rows:
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), t and t[:40]


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    marked = [f"{word}{mark}" for word in ("İ", "abİ", "क़", "İstanbulİ", "שׁ", "é", "Ünï", "ß", "ﬁ", "Ω", "ab") for mark in ".,"]
    rows = corpus + [(310_000 + i, f"x {w} y") for i, w in enumerate(marked)] + [(300_000, "<|endoftext|> a<|startoftext|>b İ Σ n't é…"), (300_001, "क़ ﬁ don't. U.S., a,b")]
    got = harmonic_packing.pack(frame(spark, rows), path).collect()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        ends = np.cumsum([n for _, n in sorted(pieces[i])])
        assert [s for s, _ in sorted(pieces[i])] == [0, *ends[:-1]] and ends[-1] == len(x)
    padding = total = 0
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 4096
        total += int(ends[-1])
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 4096 - int(ends[-1])
    assert padding < 0.03 * total


def test_words_of_every_kind_of_letter_before_marks():
    from tokenizers import Tokenizer
    from unicodedata import category

    path = queries.tokenizer_path("word_bpe_49k.json")
    encode = harmonic_packing.encoder(path, end_id=2)
    letters = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x20000, 7)] if not 0xD800 <= c < 0xE000 and category(chr(c))[0] in "LM"]
    texts = [t for c in letters for t in (f"{c}.", f"ab{c}, {c}", f"q{c}b.")]
    want = [np.array(e.ids + [2], "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    got = [x for at in range(0, len(texts), 1000) for x in encode(texts[at : at + 1000])]
    assert [t for t, x, y in zip(texts, got, want, strict=True) if x != y] == []


def test_cut_lengths_fill_bins():
    lengths = set(harmonic_packing.class_lengths(4096))
    for n in [*range(1, 300), 4095, 4096, 4097, 9999, 123_457]:
        parts = harmonic_packing.cut(n, 4096, sorted(lengths))
        assert sum(parts) == n and set(parts) <= lengths
    assert all(4096 - (4096 // n) * n < 64 for n in lengths)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = zstd_langid.classify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = frame(spark, [(i, t) for i, t in enumerate([None, "", "123 $$$", "?", None])])
    dictionaries = zstd_langid.learn(docs)
    assert {r.lang_pred for r in zstd_langid.identify(odd, dictionaries).collect()} == {"und"}
    assert {r.lang_pred for r in zstd_langid.identify(odd, {}).collect()} == {"und"}
    kept = zstd_langid.keep_identified(docs)
    assert kept.schema == docs.schema and kept.count() > 0.97 * docs.count()


def test_language_id_scores_long_texts_as_short_ones(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    classifier = zstd_langid.Classifier(zstd_langid.learn(docs.where(~zstd_langid.held_out_mask(F.col("doc_id")))))
    for lang in ("en", "fr"):
        texts = [r.text for r in docs.where(zstd_langid.held_out_mask(F.col("doc_id")) & (F.col("lang") == lang)).orderBy("doc_id").collect() if len(r.text) > 500]
        whole = "\n".join(texts)
        scores = [classifier.predict((whole * (n // len(whole) + 1))[:n]) for n in (100_000, 1_000_000, 4_000_000)]
        assert [x for x, _ in scores] == [lang] * 3
        assert min(s for _, s in scores) > 0.8 * scores[0][1] > 10 * zstd_langid.MARGIN


def test_rare_languages_do_not_cut_the_others_dictionaries(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    held = [r for r in docs.where(zstd_langid.held_out_mask(F.col("doc_id"))).collect() if r.text and any(c.isalpha() for c in r.text)]
    rest = docs.where(~zstd_langid.held_out_mask(F.col("doc_id")))

    def judged(labelled):
        dictionaries = zstd_langid.learn(labelled)
        classifier = zstd_langid.Classifier(dictionaries)
        return dictionaries, [(r.lang, *classifier.predict(r.text)) for r in held]

    whole, found = judged(rest)
    fifth, with_fifth = judged(rest.unionAll(spark.createDataFrame([(10**9, "the quick thing is one x", "xx")], rest.schema)))
    assert {k: len(v) for k, v in fifth.items()} == {k: len(v) for k, v in whole.items()} | {"xx": 24}
    refused = lambda rows: sum(s < zstd_langid.MARGIN for _, _, s in rows)
    assert refused(with_fifth) <= refused(found) + 1
    assert sum(a != b for (_, a, _), (_, b, _) in zip(found, with_fifth, strict=True)) <= 2
    few = rest.where("lang <> 'es'").unionAll(rest.where("lang = 'es' and length(text) > 1500").orderBy("doc_id").limit(4))
    rare, seen = judged(few)
    assert len(rare["es"]) < len(rare["en"]) / 2
    assert np.mean([p == "es" for lang, p, _ in seen if lang == "es"]) > 0.75


def test_many_languages_are_learned_and_the_smallest_size_wins(spark):
    import zstandard as z

    rng = random.Random(3)
    vocabulary = {f"l{k:02}": [f"{''.join(rng.choices('abcdefghijklmnop', k=7))}" for _ in range(60)] for k in range(70)}
    rows = [(k, " ".join(rng.choices(vocabulary[lang], k=80)), lang) for k, lang in enumerate(sorted(vocabulary) * 4)]
    rows += [(0, rows[0][1], "l00")] * 50  # a row that repeats takes no other language's place
    dictionaries = zstd_langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(dictionaries) == sorted(vocabulary)
    texts = [" ".join(rng.choices(vocabulary[lang], k=30)) for lang in sorted(vocabulary)]
    classifier = zstd_langid.Classifier(dictionaries)
    found = classifier.predict_all(texts)
    assert [x for x, _ in found] == sorted(vocabulary)
    size, _, langs = classifier.rounds[0]
    assert len(classifier.rounds) == 1 and langs == sorted(vocabulary)
    for text, (lang, score) in list(zip(texts, found, strict=True))[:5]:
        own = []
        for x in langs:
            d = z.ZstdCompressionDict(dictionaries[x][-size:], dict_type=z.DICT_TYPE_RAWCONTENT)
            own.append((len(z.ZstdCompressor(level=zstd_langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(text.encode())) - 9, x))
        own.sort()
        assert lang == own[0][1] and score == pytest.approx(1 - own[0][0] / own[1][0])


def test_rounds_of_dictionary_sizes():
    assert zstd_langid.rounds({}) == []
    assert zstd_langid.rounds({"a": 90, "b": 5}) == [(4096, {"a", "b"}, ["a", "b"])]
    assert zstd_langid.rounds({"a": 100_000, "b": 60_000, "c": 20_000, "d": 9, "e": 3000}) == [
        (60_000, {"a", "b"}, ["a", "b"]), (20_000, {"c"}, ["a", "b", "c"]), (4096, {"d", "e"}, ["a", "b", "c", "d", "e"])]
    assert zstd_langid.rounds({"a": 100_000, "b": 20_000, "c": 15_000}) == [(15_000, {"a", "b", "c"}, ["a", "b", "c"])]


def test_quality_counts_and_verdicts(spark, corpus):
    junk = [(400_000 + i, " ".join(f"w{i}{k}###" for k in range(40))) for i in range(6)]
    clean = [(500_000 + i, " ".join(f"plain{i}{k}" for k in range(30 + i))) for i in range(120)]
    rows = corpus + junk + clean + [(600_000, "z " * 40), (600_001, "a b c d e f g h i j\na b c d e f g h i j\nx y")]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("lang")))
    got = {r.doc_id: r for r in mcd_quality.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert tuple(got[i])[1:7] == brute.base_counts(t), i
        assert not (got[i].base_failed and got[i].kept)
    assert not any(got[i].kept for i, _ in junk)
    assert all(got[i].kept for i, _ in clean)


def test_quality_rejects_plain_outliers_and_keeps_labelled_clean_texts(spark):
    folder = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = mcd_quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n[0, False] > 0.7 * (n[0, False] + n[0, True])
    assert n.get((1, False), 0) <= 0.001 * n[1, True]


def estimated(x):
    """Rejected rows of a group's vectors: the module's method in NumPy."""
    scale, grant = mcd_quality.SCALE, np.array([g for _, g in mcd_quality.FEATURES])
    half_up = lambda v: np.floor(v / mcd_quality.WIDTH + 0.5)
    middle = lambda v: np.percentile(half_up(v), 50, axis=0) * mcd_quality.WIDTH
    m = middle(x)
    z = ((x - m) / np.maximum(1.4826 * middle(np.abs(x - m)), grant * scale)) ** 2
    bucket = lambda d: np.floor(np.log(d + 1e-6) * 32)

    def core(d):
        q = np.floor(np.percentile(bucket(d), 75))
        return x[bucket(d) <= q] / scale, q

    def fitted(near):
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(grant**2)
        return np.linalg.slogdet(cov)[1], mean, np.linalg.inv(cov)

    distance = lambda f: np.einsum("ij,jk,ik->i", x / scale - f[1], f[2], x / scale - f[1])
    fits = []
    for d in (z.sum(1), z.max(1), z[:, :2].sum(1), z[:, 2:].sum(1)):
        near, _ = core(d)
        for _ in range(2):
            near, _ = core(distance(fitted(near)))
        fits.append(fitted(near))
    best = min(fits, key=lambda f: round(f[0], 9))
    for _ in range(6):
        new = fitted(core(distance(best))[0])
        if new[0] >= best[0] - 1e-9:
            break
        best = new
    widen = max(1, np.exp((core(distance(best))[1] + 1) / 32) / mcd_quality.CHI2_CORE)
    return distance(best) > widen * mcd_quality.CUTOFF


def test_quality_verdicts_match_numpy_by_group(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = mcd_quality.judge(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").toPandas()
    rows = rows[~rows.base_failed].copy()
    n, chars = rows.n_words, rows.word_chars
    vectors = [np.log(1 + n), np.log((chars + 100) / (n + 20)), np.sqrt(rows.n_symbols / (chars + 100)), np.sqrt(rows.n_dup_lines / (n + 20)), np.sqrt(rows.n_repeat_words / (n + 20))]
    x = np.floor(np.stack(vectors, 1) * mcd_quality.SCALE + 0.5)
    rows["size"] = rows.groupby(["lang", "source"], dropna=False).doc_id.transform("count")
    rows["grp"] = np.where(rows["size"] >= mcd_quality.LEAST, rows.lang + "/" + rows.source, rows.lang)
    own = rows["size"] >= mcd_quality.LEAST
    assert own.any() and (rows.estimate[own] == "source").all() and (rows.estimate[~own] == "language").all()
    for _, at in rows.reset_index(drop=True).groupby("grp").groups.items():
        assert (rows.kept.to_numpy()[at] == ~estimated(x[at])).all()


def test_quality_estimate_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 5)) * [0.8, 0.2, 0.2, 0.2, 0.3] + 1) * mcd_quality.SCALE
    x[:40] += 3 * mcd_quality.SCALE
    rows = spark.createDataFrame([("g", *map(int, r), 1) for r in x], "grp string, x0 long, x1 long, x2 long, x3 long, x4 long, n long")
    model = mcd_quality.estimate(rows)
    d = {tuple(r)[1:6]: (r.d, r["cut"]) for r in mcd_quality._distances(rows, model.drop("cut")).crossJoin(model.select("cut")).collect()}
    m = model.first()
    factor = np.array([[m[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    mean = np.array([m[f"m{i}"] for i in range(5)])
    for key, (value, _) in list(d.items())[:50]:
        v = np.array(key) / mcd_quality.SCALE - mean
        assert value == pytest.approx(v @ np.linalg.inv(factor @ factor.T) @ v)
    clean = np.array([d[tuple(map(int, r))][0] for r in x[40:]])
    assert (clean < m["cut"]).all() and all(d[tuple(map(int, r))][0] > m["cut"] for r in x[:40])
    assert abs(mean - 1).max() < 0.15


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    return {r.page_id: r for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules), strips=3).collect()}


def test_url_rules(spark):
    rng = random.Random(11)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "xample.com", "example-x.com", "net", "x.net", "", "com.example", "a..com"]
    paths = ["/", "/en/", "/en/7", "/en/77", "/e", "", "/de/8"]
    rules = [(h, p, rng.choice(["block", "allow"])) for h in hosts[:7] for p in rng.sample(paths, 3)]
    urls = [f"{rng.choice(['http', 'x'])}://{rng.choice(hosts).upper() if rng.random() < 0.3 else rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '?x#y'])}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "a://b://com/en/", "http://com\n/en/", "http://COM/EN/"]
    got = judged(spark, urls, rules)
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, 0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, want[2], want[3]), u


def test_url_rules_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://example.com/en/"), (1, "http://example.com/en/"), (2, "x://" + "a." * 20_000 + "com/" + "p" * 50_000)], "page_id long, url string")
    got = url_rules.judge_urls(pages, url_rules.rules_frame(spark, [])).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * 3
    assert len(url_rules.judge_urls(pages, url_rules.rules_frame(spark, [("com", "/p", "block")])).where("verdict = 'block'").collect()) == 1
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_frame(spark, queries.URL_RULES)).collect() == []


def test_chat_collapse(spark):
    rows = []
    say = lambda c, *texts: rows.extend((c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts))
    say(1, "hi", "hello", "bye")
    say(2, "hi", "hello")
    say(3, "hi")
    say(4, "hi", "hello", "bye")
    say(5, "hi", "other")
    say(6, None)
    say(7, "")
    rows += [(None, 0, "user", "hi"), (8, 0, None, "x"), (8, 0, None, "x"), (9, None, "user", "first"), (9, 0, "user", "second")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_equal) for r in chat_collapse.collapse_and_render(turns).collect()}
    assert got == {1: (3, 2), 5: (2, 1), 6: (1, 2), 8: (2, 1), 9: (2, 1)}
    text = chat_collapse.collapse_and_render(turns, opening="[", closing="]").where("conv_id = 9").first().rendered
    assert text == "[user\nfirst][user\nsecond]"
    assert chat_collapse.collapse_and_render(turns.limit(0)).count() == 0
    clash = turns.withColumn("position", F.lit("x")).withColumn("n", F.lit("y")).withColumn("h1", F.lit("z")).unionByName(
        spark.createDataFrame([(20, 0, "user", LONG, "x", "y", "z")], "conv_id long, turn long, role string, text string, position string, n string, h1 string"))
    assert {r.conv_id: r.n_turns for r in chat_collapse.collapse_and_render(clash).collect()} == {k: n for k, (n, _) in got.items()} | {20: 1}


def test_decontamination(spark):
    items = [(1, "If Alice Smith buys 12 apples for 3 dollars and sells them for 5 dollars each, how much does Alice Smith earn?"), (2, "the quick brown fox jumps over the lazy dog near the old river bank today"), (3, "too short"), (4, None), (5, "only seven words are in this item")]
    docs = [
        (1, "Intro. if Bob Jones buys 40 apples for 9 dollars and sells them for 7 dollars each, how much does Bob Jones earn? Outro."),
        (2, "INTRO!! THE!! QUICK BROWN FOX JUMPS OVER THE LAZY DOG NEAR THE OLD RIVER BANK TODAY"),
        (3, "the quick brown fox sleeps"), (4, None), (5, ""), (6, "too short"), (7, "x Only seven, words are in this item y"),
        (8, "we said that Bob Jones buys 40 apples for 9 dollars and sells them for 7 dollars each, how much does Carol White earn?"),
        (9, "the quick brown fox jumps over the lazy " + LONG),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in template_decontam.contaminated(frame(spark, docs), benchmark).collect())
    assert (1, 1) in got and (2, 2) in got and (7, 5) in got and {d for d, _ in got} <= {1, 2, 7, 8}
    hits = {(r.doc_id, r.item_id): r.n_hits for r in template_decontam.hits(frame(spark, docs), benchmark).collect()}
    assert hits[8, 1] < hits[1, 1]  # windows that hold both names fail the slot check
    kept = template_decontam.keep_clean(frame(spark, docs), benchmark)
    assert kept.columns == DOCS.names and {3, 4, 5, 6, 9} <= {r.doc_id for r in kept.collect()}
    assert template_decontam.contaminated(frame(spark, docs), benchmark.limit(0)).count() == 0


def test_decontamination_finds_verbatim_copies_of_number_heavy_items(spark):
    items = [(1, "Compute 12 + 7 * 30 - 5 = ? Sum 41 + 88 + 19 + 6."), (2, "What is 12 + 7 * 3 - 5 + 9 + 2?")]
    docs = [(1, "Intro. " + items[0][1] + " Outro."), (2, "Intro. " + items[1][1]), (3, "Compute 13 + 7 * 30 - 5 = ? Sum 41 + 87 + 19 + 6."), (4, "What is 1 + 7 * 3 - 5 + 9 + 2?")]
    got = template_decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_hits, r.n_windows) for r in got) == [(1, 1, 3, 3), (2, 2, 1, 1)]


def test_decontamination_checks_slots_over_the_whole_occurrence_and_types_number_words(spark):
    filler = " ".join(f"word{i}" for i in range(20))
    items = [(1, f"when Alice Smith went out {filler} then Alice Smith came home"), (2, "the shop opens at three in summer and closes five hours later on most other days")]
    docs = [
        (1, f"when Bob Jones went out {filler} then Bob Jones came home"), (2, f"when Bob Jones went out {filler} then Carol White came home"),
        (3, "the shop opens at four in summer and closes six hours later on most other days"), (4, "the shop opens at 4 in summer and closes 6 hours later on most other days"),
        (5, "the shop opens at nice in summer and closes big hours later on most other days"),
    ]
    found = {(r.doc_id, r.item_id): (r.n_hits, r.n_windows) for r in template_decontam.hits(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found[1, 1][0] == found[1, 1][1] and found[2, 1][0] <= found[1, 1][0] - 7
    assert found[3, 2][0] == found[3, 2][1] == found[4, 2][0] and (5, 2) not in found


def test_decontamination_recall_of_planted_questions(spark):
    rng = random.Random(12)
    names, nouns = ["Tom", "Anna", "Peter", "Lucy", "Omar", "Ines"], ["apples", "books", "tickets", "stones", "lamps"]
    ask = lambda a, b, x, y, z, w: f"{a} has {x} {w} in a box. {b} gives {a} another {y} {w} and then {a} loses {z} of them on the way home. How many {w} does {a} have in the end?"
    items = [(k, ask("Tom", "Anna", 12, 7, 3, w)) for k, w in enumerate(nouns)]
    docs = []
    for k in range(60):
        a, b = rng.sample(names, 2)
        docs.append((k, "Some words before it. " + ask(a, b, *rng.sample(range(20, 90), 3), nouns[k % 5]) + " And after it."))
    docs += [(100 + k, f"{n} has a garden with old trees. {n} reads there and then walks home in the end.") for k, n in enumerate(names)]
    got = {(r.doc_id, r.item_id) for r in template_decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len({d for d, i in got if d < 60 and i == d % 5}) >= 0.9 * 60 and not {d for d, _ in got if d >= 100}


def test_decontamination_takes_names_at_sentence_starts_for_slots(spark):
    items = [(1, "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have?"), (2, "Tom\nsays to Mary \"Peter walks to the old mill by the river\" twice.")]
    docs = [
        (1, "Anna has 5 apples. Anna buys 9 more. How many apples does Anna have?"),
        (2, "Intro text, then: Anna has 5 apples. Anna buys 9 more. How many apples does Anna have? And so on."),
        (3, "Anna has 5 apples. Paul buys 9 more. How many apples does Mary have?"),
        (4, "Eve\nsays to Lucy \"Simon walks to the old mill by the river\" twice."),
        (5, "Anna eats 5 apples. Then she sleeps. How many hours does Anna sleep?"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = template_decontam.contaminated(frame(spark, docs), benchmark).collect()
    assert {(1, 1), (2, 1), (4, 2)} <= {(r.doc_id, r.item_id) for r in got} and {r.doc_id for r in got} <= {1, 2, 3, 4}
    hits = {(r.doc_id, r.item_id): r.n_hits for r in template_decontam.hits(frame(spark, docs), benchmark).collect()}
    assert hits[1, 1] == hits[2, 1] == 7 and hits.get((3, 1), 0) < 7


ODD = [(None, "null id text that is long enough to be a line"), (None, None), (1, "twice the same row, the same words in it"), (1, "twice the same row, the same words in it"), (1, "another text under the same id, some more words"), (2, None), (3, "")]
RUNS = {
    "op1": minhash_dedup.link_components, "op2": lambda d: template_decontam.contaminated(d, d.sparkSession.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")),
    "op3": lambda d: harmonic_packing.pack(d, queries.tokenizer_path("word_bpe_49k.json")), "op4": rlz_substring.remove_repeats, "op5": mcd_quality.judge, "op6": cuckoo_lines.dedup_lines,
    "op7": zstd_langid.classify_held_out, "op8": lambda d: token_counts.count_tokens(d, queries.tokenizer_path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", RUNS)
def test_nulls_repeated_rows_empty_tables_and_clashing_columns(spark, name):
    docs = frame(spark, ODD)
    for column in ("class", "key", "root", "words", "n_words", "n_lines", "n_dropped", "n_removed", "score", "band", "place", "hash", "grp", "draw"):
        docs = docs.withColumn(column, F.lit("clash"))
    out = RUNS[name](docs).collect()
    if name not in ("op2", "op3"):
        assert len(out) == len(ODD)
    assert RUNS[name](docs.limit(0)).collect() == []


def test_rows_without_an_id_and_of_one_id(spark):
    docs = frame(spark, ODD + [(9, ODD[0][1])])
    found = [(r.doc_id, r.component_id) for r in minhash_dedup.link_components(docs).collect()]
    assert sorted(found, key=str) == sorted([(None, None), (None, None), (1, 1), (1, 1), (1, 1), (2, 2), (3, 3), (9, 9)], key=str)
    lines = {r.doc_id: r.n_dropped for r in cuckoo_lines.dedup_lines(docs).where("doc_id is not null").collect()}
    assert lines == {1: 0, 2: 0, 3: 0, 9: 0}


def test_oracles_of_corpus_queries_are_registered():
    assert {"op2_decontamination", "op6_line_dedup", "op9_url_filters", "op10_chat_formatting"} <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")) == list(range(1, 11))


def test_word_windows_hash_equal_windows_equally():
    h = common.WordHash().of(b"a b c a b c d a b".split())
    w = common.windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 6 and len(common.windows(h, 10)) == 0
