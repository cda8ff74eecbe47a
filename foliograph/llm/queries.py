"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import html_text, licenses, media, mixing, packing, quality, simhash, substrings, toxicity, urls
from foliograph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ";")
    return done.select("doc_id", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), spans.alias("removed_spans"), "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.decide(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "component")


QUERIES: dict[str, Query] = {
    "op1_media": op1_media,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_html_text": op6_html_text,
    "op7_licenses": op7_licenses,
    "op8_substrings": op8_substrings,
    "op9_toxicity": op9_toxicity,
    "op10_urls": op10_urls,
}

_WORD = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {
    "op3_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][1 + rank % 3] AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][1 + rank % 3] AS tilt
  FROM per),
levels AS (
  SELECT *, 2 * source_size / weight AS r,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY 2 * source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
rest AS (SELECT arg_min(level, r) AS level FROM levels WHERE level <= r),
goal AS (
  SELECT l.source, l.source_size, l.tilt, least(2.0 * l.source_size, coalesce(rest.level * l.weight, 2.0 * l.source_size))::DOUBLE AS target
  FROM levels l CROSS JOIN rest),
demand AS (SELECT *, sum(target) OVER () AS d, sum(target * tilt) OVER () AS dt FROM goal),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.tilt, g.d, g.dt, CAST(floor(g.target) AS BIGINT) AS quota,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start0
  FROM sized s JOIN demand g ON s.source IS NOT DISTINCT FROM g.source),
took AS (
  SELECT *, greatest(0, least(size, quota - start0)) AS first, greatest(0, least(size, quota - start0 - source_size)) AS second,
         CASE WHEN tilt = 0 THEN start0 / target ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (start0 / target))) / (2 * tilt) END AS t
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(first + second AS BIGINT) AS taken,
       CASE WHEN first > 0 THEN CAST(floor(d * t + dt * (t * t - t)) AS BIGINT) END AS position
FROM took""",
    "op4_quality": rf"""
WITH split AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         row_number() OVER () AS id
  FROM documents),
win AS (
  SELECT id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
twice AS (SELECT id, unnest(range(i, i + 8)) AS p FROM win
          WHERE (id, g) IN (SELECT (id, g) FROM win GROUP BY id, g HAVING count(*) > 1)),
covered AS (SELECT id, count(DISTINCT p) AS n FROM twice GROUP BY id),
counts AS (
  SELECT s.doc_id, s.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (id)),
failed AS (
  SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, n_symbols > 4 * n_words AS f3, 100 * n_dup_lines > 50 * n_lines AS f4
  FROM counts),
hosts AS (
  SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS rule,
         unnest([count(*) FILTER (f1), count(*) FILTER (f2), count(*) FILTER (f3), count(*) FILTER (f4)]) AS f
  FROM failed GROUP BY source),
moments AS (SELECT rule, sum(f) / sum(n) AS m, var_pop(f / n) AS v FROM hosts GROUP BY rule),
prior AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM moments),
verdict AS (
  SELECT source, bool_or((f + m * k) / (n + k) > 0.5) AS host_failed FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, host_failed,
       NOT (f1 OR f2) AND NOT host_failed AS kept
FROM failed f JOIN verdict v ON f.source IS NOT DISTINCT FROM v.source""",
    "op10_urls": r"""
WITH parts AS (
  SELECT page_id, url, coalesce(html, '') AS h,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(h, '(?s)<!--.*?(?:-->|$)', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM parts WHERE regexp_matches(h, '(?i)canonical|http-equiv')),
named AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*(?:["''][^"'']*\bcanonical\b|canonical\b)') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                   WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS target
  FROM tags),
spelled AS (
  SELECT DISTINCT url AS u FROM parts WHERE url LIKE '%://%' UNION SELECT target FROM named WHERE target LIKE '%://%'),
cut AS (
  SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(u, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query
  FROM spelled),
ruled AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
              WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
              WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
              WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM cut),
node AS (
  SELECT u, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
         CASE WHEN regexp_replace(host, '^(www\.|m\.)+', '') <> '' THEN
           '//' || regexp_replace(host, '^(www\.|m\.)+', '') || regexp_replace(regexp_replace(path, '(\.html?|/)$', ''), '/+', '/', 'g') || query END AS n
  FROM ruled),
link AS (SELECT a.n AS a, b.n AS b FROM named JOIN node a ON a.u = named.url JOIN node b ON b.u = named.target WHERE a.n IS NOT NULL AND b.n IS NOT NULL),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  WITH RECURSIVE r(n, m) USING KEY (n, m) AS (
    SELECT n, n FROM (SELECT DISTINCT n FROM node WHERE n IS NOT NULL)
    UNION
    SELECT r.n, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.m)
  SELECT n, min(m) AS component FROM r GROUP BY n),
own AS (
  SELECT p.page_id, p.host, p.path, node.rule, node.said, reach.component
  FROM parts p LEFT JOIN node ON node.u = p.url LEFT JOIN reach ON reach.n = node.n),
told AS (SELECT component, bool_or(said = 'allow') AS allowed FROM node JOIN reach ON reach.n = node.n WHERE said IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN NOT allowed THEN 'block' END, 'allow') AS verdict, own.component
FROM own LEFT JOIN told ON told.component = own.component""",
}
