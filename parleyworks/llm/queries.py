"""The operators as registered queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    exact_dedup,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    packing,
    phrase_mining,
    quality_rules,
    spelling_variants,
    suffix_dedup,
    token_counts,
    toxicity,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

SIZE = 2048
PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = license_scan.TEMPLATES | license_scan.TEXTS
    return license_scan.license_scan(table(spark, sf_dir, "documents"), templates=templates, runs=True, short=license_scan.SHORT).drop("matches")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.page_line_dedup(table(spark, sf_dir, "pages"))


def op10_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), SIZE)
    return packing.buckets(pieces.select(*PIECES))


def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_license_scan with opening sentences and short notices alone."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"), runs=True, short=license_scan.SHORT).drop("matches")


def op9_small_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_site_line_dedup with a floor of three pages, so that two copies of a page leave each other alone."""
    return line_dedup.page_line_dedup(table(spark, sf_dir, "pages"), min_pages=3)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.phrase_mining(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_poisson_mixing,
        op2_toxicity_nnpu,
        op3_language_mixture,
        op4_rule_cascade,
        op5_token_counts,
        op6_jaccard_join,
        op7_license_scan,
        op8_exact_dedup,
        op9_site_line_dedup,
        op10_power_of_two_packing,
        op7_license_notices,
        op9_small_site_line_dedup,
        op11_spelling_variants,
        op12_phrase_mining,
        op13_suffix_dedup,
    )
}

_OP1 = """
WITH per AS (SELECT source, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY source),
weighted AS (SELECT source, chars, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, 0.5) ELSE 0 END AS weight FROM per),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(chars) FROM weighted)::DOUBLE / chars ELSE 0 END AS rate
  FROM weighted),
terms AS (
  SELECT source, k, CASE WHEN rate > 0 THEN exp(-rate + k * ln(rate) - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS p
  FROM rates, range(0, 2000) r(k) WHERE k <= ceil(rate + 12 * sqrt(rate)) + 30),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
u AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*)::INTEGER AS copies
  FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copies, copy_no::INTEGER AS copy_no,
  md5('mix-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy_no FROM counted)
"""

_OP4 = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
places AS (
  SELECT r, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] || chr(10) || w[i+3] || chr(10) || w[i+4] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM places) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) x(k) GROUP BY r),
measured AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN repeated USING (r)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    (word_chars / greatest(n_words, 1) NOT BETWEEN 2 AND 15)
    OR n_symbols / greatest(n_words, 1) > 0.1
    OR n_dup_lines / greatest(n_lines, 1) > 0.3
    OR length(regexp_replace(t, '\P{L}', '', 'g')) / greatest(word_chars, 1) < 0.6
    OR length(regexp_replace(t, '\P{Lu}', '', 'g')) / greatest(word_chars, 1) > 0.5
    OR len(regexp_extract_all(t, '(?m)^[ \t]*[-*•]')) / greatest(n_lines, 1) > 0.9
    OR len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)[ \t]*$')) / greatest(n_lines, 1) > 0.3 AS rejected
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _op7(full: Mapping[str, str]) -> str:
    """Licenses by lines and by runs of words: ``full`` templates and the short ones."""
    values = [(k, v, by_line) for by_line, x in ((True, full), (False, license_scan.SHORT)) for k, v in x.items()]
    templates = ", ".join("('{}', '{}', {})".format(k, v.replace("'", "''"), b) for k, v, b in values)
    phrases = ", ".join(f"('{k}', '{v}')" for k, v in license_scan.PHRASES.items())
    return f"""
WITH templates AS (
  SELECT label, by_line, len(bw) AS l, list_distinct(bw) AS tw, greatest(1, ceil(0.8 * len(list_distinct(bw)) - 1e-9)) AS need
  FROM (SELECT label, by_line, {_WORDS % "body"} AS bw FROM (VALUES {templates}) v(label, body, by_line))),
phrases AS (SELECT string_split(body, ' ') AS pw, label FROM (VALUES {phrases}) v(body, label)),
base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS % "coalesce(text, '')"} AS w FROM documents),
starts AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM base),
places AS (SELECT r, i, label FROM starts JOIN phrases ON w[i+1] = pw[1] WHERE list_slice(w, i + 1, i + len(pw)) = pw),
found AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS labels FROM places GROUP BY r),
lines AS (SELECT r, {_WORDS % "line"} AS x FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM base)),
candidates AS (SELECT r, w, label, tw, l, need FROM base, templates WHERE len(list_intersect(tw, w)) >= need),
runs AS (SELECT r, label, tw, need, list_slice(w, i, i + l - 1) AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM candidates)),
near AS (
  SELECT r, label, len(list_intersect(tw, x)) / len(tw) AS c FROM lines, templates WHERE by_line AND len(list_intersect(tw, x)) >= need
  UNION ALL SELECT r, label, len(list_intersect(tw, x)) / len(tw) FROM runs WHERE len(list_intersect(tw, x)) >= need),
extra AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM near GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(found.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found.labels, []), coalesce(extra.labels, [])))), ','), '') AS labels,
  greatest(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END, coalesce(c, 0))::DOUBLE AS score
FROM base LEFT JOIN found USING (r) LEFT JOIN extra USING (r)
"""


_OP8 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

_OP9 = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'),
      '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|main|aside|form|blockquote|pre)(?:[ \t\r\n/][^>]*)?>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), chr(10)) AS lines
  FROM pages),
l AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM p),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
counts AS (SELECT host, bare, count(DISTINCT r) AS n FROM k WHERE bare <> '' GROUP BY host, bare),
bad AS (SELECT host, bare FROM counts JOIN totals USING (host) WHERE n >= 2 AND n > 0.3 * pages),
marked AS (SELECT k.*, bad.bare IS NOT NULL AS gone FROM k LEFT JOIN bad USING (host, bare))
SELECT page_id, p.host, sum(gone::INTEGER)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM p JOIN marked USING (r) GROUP BY r, page_id, p.host
"""

# crc32 byte by byte: the table entry of a byte is eight shifts with the reflected polynomial 3988292384
_OP11 = r"""
WITH RECURSIVE bits AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x)::BIGINT, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda a, byte: xor(a >> 8, t[(xor(a, byte) & 255) + 1])), 4294967295) AS h
  FROM coded, crc),
noisy AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM noisy GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
half AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS top FROM half GROUP BY word, n),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * words.n THEN other END AS form, CASE WHEN top >= 5 * words.n THEN top END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

_OP12 = r"""
WITH p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 6) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100 OR k = 1),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
cuts AS (SELECT *, array_to_string(w[:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len(w))) AS j FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, l.f AS l, r.f AS r, n.n, j, ((1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = first JOIN f r ON r.lang = cuts.lang AND r.phrase = rest JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM c, range(2, 5) t(k) WHERE k < len(w)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""

# two hexadecimal digits a byte; a span is a run of windows of which each starts at the end of the one before, or earlier
_OP13 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT r, doc_id, p, substr(x, 2 * p + 1, 100) AS w FROM (SELECT *, unnest(range(0, length(x) // 2 - 49)) AS p FROM d)),
gone AS (SELECT r, p FROM (SELECT r, doc_id, p, min(doc_id) OVER (PARTITION BY w) AS least FROM places) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
marked AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50, TRUE)::INTEGER AS opens FROM gone),
numbered AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS no FROM marked),
spans AS (SELECT r, no, min(p) AS a, max(p) + 50 AS z FROM numbered GROUP BY r, no),
kept AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS done FROM spans),
cut AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(x, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS head, max(z) AS z
  FROM kept JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN z IS NULL THEN x ELSE head || substr(x, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_poisson_mixing": _OP1,
    "op4_rule_cascade": _OP4,
    "op7_license_scan": _op7(license_scan.TEMPLATES | license_scan.TEXTS),
    "op8_exact_dedup": _OP8,
    "op9_site_line_dedup": _OP9,
    "op7_license_notices": _op7(license_scan.TEMPLATES),
    "op9_small_site_line_dedup": _OP9.replace("n >= 2", "n >= 3"),
    "op11_spelling_variants": _OP11,
    "op12_phrase_mining": _OP12,
    "op13_suffix_dedup": _OP13,
}
