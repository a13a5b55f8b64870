"""The registered queries opN_<name>: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import chat_collapse, cuckoo_lines, harmonic_packing, mcd_quality, minhash_dedup, rlz_substring, template_decontam, token_counts, url_rules, zstd_langid
from inkgauge.llm.common import table

URL_RULES: list[url_rules.Rule] = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine, the same on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.link_components(docs).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rlz_substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_quality.judge(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cuckoo_lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_langid.classify_held_out(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse_and_render(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_decontamination, op3_packing, op4_substring_dedup, op5_quality_rules, op6_line_dedup, op7_language_id, op8_token_counts, op9_url_filters, op10_chat_formatting)}


OP9_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
"""

OP10_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER w AS position,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said,
    length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || length(coalesce(text, ''))::VARCHAR || ':' || coalesce(text, '') AS exact
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
prefixes AS (
  SELECT conv_id, position, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(said, '') OVER w AS rendered, md5(string_agg(exact, '') OVER w) AS digest
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
whole AS (
  SELECT min(conv_id) AS conv_id, position AS n_turns, count(*) AS n_equal, digest, min(rendered) AS rendered
  FROM prefixes WHERE position = n GROUP BY position, digest)
SELECT conv_id, n_turns, n_equal, rendered FROM whole
WHERE (n_turns, digest) NOT IN (SELECT (position, digest) FROM prefixes WHERE position < n)
"""


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s FROM w),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b USING (e) WHERE a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links
  UNION SELECT r.x, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.y = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(r.low, s.doc_id)) AS component_id, s.doc_id <= coalesce(r.low, s.doc_id) AS kept
FROM sets s LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) r ON r.x = s.doc_id
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
keys AS (SELECT doc_id, list_transform(generate_series(1, len(words) - 49), lambda i: md5(array_to_string(words[i:i + 49], ' '))) AS k FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS s FROM keys),
firsts AS (SELECT k, min(doc_id) AS f FROM windows GROUP BY k),
covered AS (SELECT DISTINCT doc_id, s + o AS p FROM windows JOIN firsts USING (k), range(50) t(o) WHERE f < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (
  SELECT placed.doc_id, count(*) AS n, count(covered.p) AS gone, string_agg(word, ' ' ORDER BY placed.p) FILTER (WHERE covered.p IS NULL) AS t
  FROM placed LEFT JOIN covered ON covered.doc_id = placed.doc_id AND covered.p = placed.p GROUP BY placed.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP2_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
marked AS (SELECT side, id, regexp_replace(translate(coalesce(text, ''), chr(1), ' '), '([\p{Ll}\p{N},;]) (\p{Lu}\p{Ll}+)', '\1 ' || chr(1) || '\2', 'g') AS t FROM texts),
marked2 AS (SELECT side, id, regexp_replace(regexp_replace(t, '(\x01\p{Lu}\p{Ll}+) (\p{Lu}\p{Ll}+)', '\1 ' || chr(1) || '\2', 'g'), '(\x01\p{Lu}\p{Ll}+) (\p{Lu}\p{Ll}+)', '\1 ' || chr(1) || '\2', 'g') AS t FROM marked),
joined AS (SELECT side, id, regexp_replace(regexp_replace(t, '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g') AS t FROM marked2),
toks AS (SELECT side, id, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{M}\p{N}\x01]+'), lambda w: w <> '') AS words FROM joined),
formed AS (
  SELECT side, id, words, len(words) AS n,
    list_transform(words, lambda w, i: CASE WHEN regexp_matches(w, '^[0-9]') THEN '<num>'
      WHEN list_contains(UNITS, w) AND i > 1 AND regexp_matches(words[i - 1], '^[0-9]') THEN '<unit>' ELSE ltrim(w, chr(1)) END) AS plain,
    list_transform(words, lambda w, i: CASE WHEN regexp_matches(w, '^[0-9]') THEN '<num>'
      WHEN list_contains(UNITS, w) AND i > 1 AND regexp_matches(words[i - 1], '^[0-9]') THEN '<unit>' WHEN starts_with(w, chr(1)) THEN '<name>' ELSE w END) AS named
  FROM toks),
widths AS (SELECT DISTINCT least(8, n) AS width FROM formed WHERE side = 'b' AND n >= 5),
placed AS (
  SELECT side, id, width, unnest(generate_series(1, n - width + 1)) AS place, words, plain, named
  FROM formed JOIN widths ON n >= width AND (side = 'd' OR (n >= 5 AND width = least(8, n)))),
cut AS (
  SELECT side, id, width, place, words[place:place + width - 1] AS words, plain[place:place + width - 1] AS plain, named[place:place + width - 1] AS named FROM placed),
formwise AS (
  SELECT side, id, width, place, words, plain AS form, 'plain' AS kind FROM cut
  UNION ALL SELECT side, id, width, place, words, named, 'named' FROM cut),
keyed AS (
  SELECT side, id, width, place, form, kind,
    list_filter(list_transform(words, lambda w, i: CASE WHEN form[i] IN ('<num>', '<unit>', '<name>') THEN w END), lambda w: w IS NOT NULL) AS vals
  FROM formwise WHERE side = 'b' OR EXISTS (SELECT 1 FROM formwise b WHERE b.side = 'b' AND b.kind = formwise.kind AND b.form = formwise.form)),
slotted AS (SELECT *, list_transform(vals, lambda v: list_position(vals, v)) AS pattern FROM keyed),
totals AS (SELECT id AS item_id, count(*) AS n_windows FROM cut WHERE side = 'b' GROUP BY id),
hit AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(DISTINCT b.place) AS n_hits
  FROM slotted d JOIN slotted b ON d.kind = b.kind AND d.width = b.width AND d.form = b.form AND d.pattern = b.pattern
  WHERE d.side = 'd' AND b.side = 'b' AND 2 * len(list_filter(b.form, lambda w: w NOT IN ('<num>', '<unit>', '<name>'))) >= len(b.form)
  GROUP BY d.id, b.id)
SELECT doc_id, item_id, n_hits, n_windows FROM hit JOIN totals USING (item_id)
WHERE n_hits >= least(6, ceil(n_windows / 2))
""".replace("UNITS", "[" + ", ".join(f"'{u}'" for u in template_decontam.UNITS) + "]")

OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT doc_id, line, place,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first_doc < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE first_doc IS NULL OR first_doc = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_url_filters": OP9_SQL, "op10_chat_formatting": OP10_SQL,
    }
