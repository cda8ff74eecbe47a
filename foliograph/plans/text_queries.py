"""Queries over texts, translations and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as t
from foliograph.functions import values as v
from foliograph.operators import containment, external, grouping, quality, translation
from foliograph.plans import bind
from foliograph.plans.bind import query, table
from foliograph.sources import scans

POLICY = "p1"
#: Words that this corpus' English documents repeat: a stand-in for a trade's dictionary.
GENERIC = ["the", "of", "and", "in", "that"]
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("SELECT doc_id, pos, trim(source_text) AS source_text, doc_id * 100000 + pos = min(doc_id * 100000 + pos) OVER (PARTITION BY trim(source_text)) AS first FROM lines QUALIFY first", "lines")
def first_seen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.lines(spark, sf_dir).select("doc_id", "pos", F.trim("source_text").alias("source_text"))
    return grouping.first_seen(rows, F.col("source_text"), ["doc_id", "pos"]).withColumn("first", F.lit(True))


_MEMORY = """, memory AS (SELECT source_text, 'T:' || source_text AS target_text, CASE WHEN count(*) % 2 = 0 THEN 'p1' ELSE 'p2' END AS policy FROM (SELECT trim(source_text) AS source_text FROM lines) GROUP BY source_text HAVING count(*) >= 2)"""


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur twice or more, learned under one of two policies."""
    rows = bind.lines(spark, sf_dir).groupBy(F.trim("source_text").alias("source_text")).agg(F.count("*").alias("occurrences")).where("occurrences >= 2")
    policy = F.when(F.col("occurrences") % 2 == 0, "p1").otherwise("p2")
    return rows.select(
        v.memory_key(F.lit("en"), F.lit("zh-CN"), policy, F.col("source_text")).alias("source_hash"), "source_text", F.concat(F.lit("T:"), "source_text").alias("target_text"), F.lit("en").alias("source_language"),
        F.lit("zh-CN").alias("target_language"), policy.alias("policy_fingerprint"), F.lit("m0").alias("model"), F.lit("job0").alias("last_job_id"), "occurrences",
    )


@query(_MEMORY + " SELECT l.doc_id, l.pos, m.target_text FROM lines l JOIN memory m ON m.source_text = trim(l.source_text) AND m.policy = 'p1'", "lines")
def memory_lookup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = translation.memory_lookup(bind.lines(spark, sf_dir), _memory(spark, sf_dir), "en", "zh-CN", POLICY)
    return found.where("memory_target is not null").select("doc_id", "pos", F.col("memory_target").alias("target_text"))


@query(_MEMORY + " SELECT doc_id, pos FROM lines WHERE trim(source_text) NOT IN (SELECT source_text FROM memory WHERE policy = 'p1')", "lines")
def memory_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.memory_misses(translation.memory_lookup(bind.lines(spark, sf_dir), _memory(spark, sf_dir), "en", "zh-CN", POLICY)).select("doc_id", "pos")


_COUNTED = ", counted AS (SELECT source_text, target_text, count(*) AS occurrences, min(ord) AS ord FROM pairs WHERE source_text <> target_text AND trim(target_text) <> '' GROUP BY ALL), settled AS (SELECT source_text, arg_max(target_text, ord) AS target_text, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM counted GROUP BY source_text)"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.pair_occurrences(bind.pairs(spark, sf_dir))


@query(_COUNTED + " SELECT source_text, target_text, occurrences FROM counted", "pairs")
def pair_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("source_text", "target_text", "occurrences")


@query(_COUNTED + r""", c AS (SELECT *, trim(regexp_replace(source_text, '\s+', ' ', 'g')) AS t FROM settled)
SELECT source_text, target_text, occurrences, CASE WHEN occurrences >= 2 THEN 0.92::DOUBLE ELSE 0.82 END AS confidence, 'pending' AS status FROM c
WHERE length(t) BETWEEN 2 AND 60 AND NOT regexp_matches(t, '[。！？]|\. |! |\? ') AND (occurrences >= 2 OR regexp_matches(t, '\p{Lu}') OR regexp_matches(t, '\p{Nd}'))""", "pairs")
def learned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.glossary_candidates(translation.settled_pairs(_counted(spark, sf_dir))).select("source_text", "target_text", "occurrences", "confidence", "status")


@query(_COUNTED + """, memory AS (SELECT sha256('en' || chr(0) || 'zh-CN' || chr(0) || CASE WHEN count(*) % 2 = 0 THEN 'p1' ELSE 'p2' END || chr(0) || source_text) AS h, source_text, 'T:' || source_text AS target_text, 'm0' AS model, 'job0' AS last_job_id, count(*) AS occurrences FROM (SELECT trim(source_text) AS source_text FROM lines) GROUP BY source_text HAVING count(*) >= 2),
new AS (SELECT sha256('en' || chr(0) || 'zh-CN' || chr(0) || 'p1' || chr(0) || source_text) AS h, source_text, target_text, occurrences FROM settled)
SELECT coalesce(n.h, m.h) AS source_hash, coalesce(n.source_text, m.source_text) AS source_text, coalesce(n.target_text, m.target_text) AS target_text, CASE WHEN n.h IS NULL THEN m.model ELSE 'm1' END AS model, CASE WHEN n.h IS NULL THEN m.last_job_id ELSE 'job1' END AS last_job_id, coalesce(m.occurrences, 0) + coalesce(n.occurrences, 0) AS occurrences
FROM memory m FULL JOIN new n ON n.h = m.h""", "pairs")
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = translation.settled_pairs(_counted(spark, sf_dir))
    return translation.memory_upsert(_memory(spark, sf_dir), new, "en", "zh-CN", POLICY, "m1", F.lit("job1")).select("source_hash", "source_text", "target_text", "model", "last_job_id", "occurrences")


@query("SELECT doc_id % 7 AS job_id, source_text, 'new' AS origin, count(*) AS occurrences FROM lines WHERE doc_id % 2 = 0 GROUP BY ALL UNION ALL SELECT o.* FROM (SELECT doc_id % 7 AS job_id, source_text, 'old', count(*) FROM lines WHERE doc_id % 2 = 1 GROUP BY ALL) o WHERE (o.job_id, o.source_text) NOT IN (SELECT (doc_id % 7, source_text) FROM lines WHERE doc_id % 2 = 0)", "lines")
def candidate_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda even, origin: bind.lines(spark, sf_dir).where(F.col("doc_id") % 2 == even).groupBy((F.col("doc_id") % 7).alias("job_id"), "source_text").agg(F.lit(origin).alias("origin"), F.count("*").alias("occurrences"))
    return translation.candidate_upsert(rows(1, "old"), rows(0, "new"))


def _glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("source_text"), F.col("r_name").alias("target_text"), F.lit("place").alias("category"))


_GLOSSARY = "SELECT n_nationkey AS id, n_name AS source_text, r_name AS target_text, 'place' AS category FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f", g AS ({_GLOSSARY}) SELECT o_orderkey AS job_id, source_text, target_text, category, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY length(source_text) DESC, source_text) AS INT) AS rank FROM orders CROSS JOIN g")
def glossary_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.glossary_snapshot(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")), _glossary(spark, sf_dir))


@query(f""", g AS ({_GLOSSARY}), inc AS (SELECT n_nationkey + 100 AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name || ' X' END AS source_text, 'T' || n_nationkey AS target_text, CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE 'c' || (n_nationkey % 3) END AS category, n_nationkey AS ord, n_nationkey AS updated_at FROM nation)
SELECT coalesce(g.id, i.id) AS id, coalesce(g.source_text, i.source_text) AS source_text, coalesce(i.target_text, g.target_text) AS target_text, coalesce(CASE WHEN trim(i.category) = '' THEN 'general' ELSE i.category END, g.category) AS category, CAST(coalesce(i.updated_at, 0) AS INT) AS updated_at, CAST(CASE WHEN g.id IS NULL THEN i.updated_at ELSE 0 END AS INT) AS created_at
FROM g FULL JOIN inc i ON lower(g.source_text) = lower(i.source_text)""")
def glossary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    old = _glossary(spark, sf_dir).withColumns({"updated_at": F.lit(0), "created_at": F.lit(0)})
    new = table(spark, sf_dir, "nation").select((n + 100).alias("id"), F.when(n % 2 == 0, F.lower("n_name")).otherwise(F.concat("n_name", F.lit(" X"))).alias("source_text"), F.concat(F.lit("T"), n.cast("string")).alias("target_text"), F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("c"), (n % 3).cast("string"))).alias("category"), n.alias("ord"), n.alias("updated_at"))
    return translation.glossary_upsert(old, new)


@query(f", g AS ({_GLOSSARY}) SELECT *, false AS unknown FROM g WHERE id % 5 <> 0 UNION ALL SELECT o_custkey, NULL, NULL, NULL, true FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT id FROM g))")
def glossary_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _glossary(spark, sf_dir)
    left = translation.glossary_delete(g, g.where("id % 5 = 0").select("id")).withColumn("unknown", F.lit(False))
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return left.unionByName(translation.unknown_ids(g, asked).withColumn("unknown", F.lit(True)), allowMissingColumns=True)


_NUMBERS = "list_sort(list_transform(regexp_extract_all({0}, '[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda x: replace(x, ',', '')))"


@query(f"SELECT doc_id, pos, array_to_string({_NUMBERS.format('source_text')}, ' ') AS numbers, {_NUMBERS.format('source_text')} <> {_NUMBERS.format('target_text')} AS mismatch FROM pairs", "pairs")
def number_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = t.number_tokens(F.col("source_text")), t.number_tokens(F.col("target_text"))
    return bind.pairs(spark, sf_dir).select("doc_id", "pos", F.array_join(a, " ").alias("numbers"), (a != b).alias("mismatch"))


_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z]+'), lambda x: lower(x))"


@query(f"SELECT doc_id, pos, array_to_string(list_sort(list_distinct(list_filter({_TOKENS.format('source_text')}, lambda x: list_contains({GENERIC}, x) AND list_contains({_TOKENS.format('target_text')}, x)))), ',') AS english FROM pairs", "pairs")
def generic_word_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.translation_problems(bind.pairs(spark, sf_dir), GENERIC, preserve_models=False)
    return found.select("doc_id", "pos", "english")


@query(f"""
, p AS (SELECT doc_id, pos, regexp_matches(target_text, '[\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') AS r, {_NUMBERS.format('source_text')} <> {_NUMBERS.format('target_text')} AS n,
  list_filter(regexp_split_to_array(source_text, '[^A-Za-z0-9_/-]+'), lambda x: NOT regexp_full_match(x, '(?:[A-Za-z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)+|[A-Z]{{2,}}[A-Z0-9]*)')) AS s,
  list_filter(regexp_split_to_array(target_text, '[^A-Za-z0-9_/-]+'), lambda x: NOT regexp_full_match(x, '(?:[A-Za-z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)+|[A-Z]{{2,}}[A-Z0-9]*)')) AS g FROM pairs),
w AS (SELECT doc_id, pos, r, n, {_TOKENS.format("array_to_string(s, ' ')")} AS s, {_TOKENS.format("array_to_string(g, ' ')")} AS g FROM p),
e AS (SELECT doc_id, pos, r, n, len(list_intersect(list_intersect(s, g), {GENERIC})) > 0 AS e FROM w)
SELECT doc_id, pos, code, 'error' AS severity FROM (SELECT doc_id, pos, unnest(list_filter([CASE WHEN r THEN 'script_residue' END, CASE WHEN e THEN 'generic_english' END, CASE WHEN n THEN 'number_mismatch' END], lambda x: x IS NOT NULL)) AS code FROM e)""", "pairs")
def translation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.translation_problems(bind.pairs(spark, sf_dir), GENERIC)
    return quality.translation_issues(found, ["doc_id", "pos"])


@query(r"SELECT doc_id, pos, array_to_string(list_filter(list_transform(string_split(replace(source_text, '. ', '.' || chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS source FROM lines", "lines")
def normalize_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.lines(spark, sf_dir).select("doc_id", "pos", t.normalize_source(F.replace(F.col("source_text"), F.lit(". "), F.lit(".\n"))).alias("source"))


#: The named references that the pages hold, and some by number that each page gets here.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&#8211;", "–"), ("&#x41;", "A"), ("&apos;", "''"), ("&#39;", "''"), ("&amp;", "&")]
_MORE = "<p>caf&eacute; &#8211; &#x41;<>&lt;b&gt;&amp;lt;"
_MARKUP = f"regexp_replace(html || '{_MORE}&#' || (page_id % 60 + 48) || ';', '<[^>]+>', chr(10), 'g')"
_MARKUP = f"replace({_MARKUP}, '&#' || (page_id % 60 + 48) || ';', chr(CAST(page_id % 60 + 48 AS INT)))"
for _name, _char in _ENTITIES:
    _MARKUP = f"replace({_MARKUP}, '{_name}', '{_char}')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_MARKUP}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM pages")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = F.concat("html", F.lit(_MORE + "&#"), (F.col("page_id") % 60 + 48).cast("string"), F.lit(";"))
    return table(spark, sf_dir, "pages").select("page_id", t.strip_markup(numbered).alias("text"))


def decoded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.decode_all_references("html").alias("text"))


bind.QUERIES["decoded_references"] = decoded_references


@query("""
, s AS (SELECT doc_id, list(trim(regexp_replace(source_text, '[ \\t]+', ' ', 'g')) ORDER BY pos) AS l FROM lines GROUP BY doc_id),
j AS (SELECT doc_id, l, 1 AS i, l[1] AS text FROM s UNION ALL
  SELECT doc_id, l, i + 1, text || CASE WHEN regexp_matches(left(l[i + 1], 1), '^[•・–-]$') THEN chr(10) WHEN regexp_matches(right(text, 1), '[.!?。！？:;]') AND regexp_matches(left(l[i + 1], 1), '\\p{Lu}') THEN chr(10)
     WHEN ascii(right(text, 1)) < 128 AND ascii(left(l[i + 1], 1)) < 128 THEN ' ' ELSE '' END || l[i + 1] FROM j WHERE i < len(l))
SELECT doc_id, text FROM j WHERE i = len(l)""", "lines")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.lines(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_text"))), lambda x: x["source_text"]).alias("l"))
    return rows.select("doc_id", t.join_lines(F.col("l")).alias("text"))


@query(rf"""
, c AS (SELECT conv_id, turn, text || ' FR-4/AB x_1 a-b C3PO abc-' AS text FROM conversations),
w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+(?:[-/][A-Za-z0-9_]+)*')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+(?:[-/][A-Za-z0-9_]+)*'), 1) AS i FROM c),
k AS (SELECT *, regexp_full_match(word, '[A-Za-z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)+') OR regexp_full_match(word, '[A-Z]{{2,}}[A-Z0-9]*') AS model FROM w)
SELECT conv_id, turn, CAST(count(*) FILTER (model) AS BIGINT) AS models, CAST(coalesce(sum(len(regexp_extract_all(word, '[A-Za-z]+'))) FILTER (NOT model), 0) AS BIGINT) AS words FROM k GROUP BY ALL""")
def model_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens are taken for models, compounds among them, and how many Latin words are left."""
    text = F.concat("text", F.lit(" FR-4/AB x_1 a-b C3PO abc-"))
    left = t.remove_model_tokens(F.regexp_replace(text, "\u00a4", ""))
    marked = F.regexp_replace(text, t.MODEL_TOKEN, "\u00a4")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count(marked, F.lit("\u00a4")).cast("long").alias("models"), F.size(t.latin_words(left)).cast("long").alias("words"))


#: Own examples of residual texts, each with what should become of it.
RESIDUALS = [("R&D", True), ("Low Dk", True), ("FR-4", True), ("ABC", True), ("Type-C PD", True), ("ISO 9001", True), ("Tg C", True), ("Cu", True), ("12 mm", True), ("5 mil", True), ("Volume", False), ("Cover layer", False), ("カバー", False), ("Total 12", False), ("x", False), ("Df value", False), ("12%", False)]


@query("SELECT text, keep, n_nationkey FROM nation CROSS JOIN (VALUES " + ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', {str(k).lower()})" for a, k in RESIDUALS) + ") v(text, keep)")
def model_or_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*(F.lit(a) for a, _ in RESIDUALS))).alias("text"))
    return rows.select("text", F.coalesce(t.model_or_standard(F.col("text")), F.lit(False)).alias("keep"), "n_nationkey")


LABELS, PHRASES = ["total", "volume"], ["market size"]


@query(r"""
, r AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_name || ' Co. Ltd' WHEN 6 THEN 'some company incorporated' WHEN 7 THEN 'some corp' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_mktsegment WHEN 3 THEN ' Total.' WHEN 4 THEN 'Market Size of ' || c_name ELSE '漢字 ' || c_name END AS text FROM customer),
n AS (SELECT c_custkey, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM r)
SELECT c_custkey, regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') AND trim(lower(t), ' .,:;()[]') NOT IN ('total', 'volume') AND NOT contains(lower(t), 'market size')
  AND (len(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9_]+'), lambda w: w IN ('co', 'corp', 'corporation', 'inc', 'ltd', 'limited', 'llc', 'plc', 'gmbh'))) > 0 OR regexp_matches(t, '[A-Z]{3,}|(?:^|[\s(])[A-Z][a-zA-Z-]{2,}')) AS proper FROM n""")
def chart_proper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 8 == 0, F.concat("c_name", F.lit(" Co. Ltd"))).when(k % 8 == 6, "some company incorporated").when(k % 8 == 7, "some corp").when(k % 8 == 1, F.lower("c_mktsegment")).when(k % 8 == 2, F.col("c_mktsegment")).when(k % 8 == 3, " Total.").when(k % 8 == 4, F.concat(F.lit("Market Size of "), "c_name")).otherwise(F.concat(F.lit("漢字 "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.chart_proper_name(text, LABELS, PHRASES).alias("proper"))


def residual_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Residual texts (lines of documents among made ones), protected terms and source texts."""
    p = F.col("pos")
    rows = bind.lines(spark, sf_dir)
    text = F.when(p % 5 == 0, F.trim("source_text")).when(p % 5 == 1, "FR-4").when(p % 5 == 2, " fuzzy spot ").when(p % 5 == 3, "Keep me").otherwise("Acme")
    docs = rows.select("doc_id").distinct()
    terms = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("always keep me here").alias("term"))
    contexts = docs.select("doc_id", F.lit("made by Acme Ltd").alias("source_text"))
    return rows.select("doc_id", p.alias("ord"), text.alias("text")), terms, contexts


def kept_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every residual that is still to be translated. Company names and models need more than SQL's patterns, so the tests
    hold this to plain Python."""
    return quality.kept_residuals(*residual_rows(spark, sf_dir), GENERIC, ["fuzzy"]).select("doc_id", "ord", "text")


def surviving_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows whose text was kept, repeated ones too."""
    rows, terms, contexts = residual_rows(spark, sf_dir)
    return quality.surviving(rows, quality.kept_residuals(rows, terms, contexts, GENERIC, ["fuzzy"])).select("doc_id", "ord", "text")


bind.QUERIES |= {"kept_residuals": kept_residuals, "surviving_residuals": surviving_residuals}


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""
, p AS (SELECT page_id, regexp_replace(url, '^.*/', '') || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN ' _cn' ELSE '' END AS name, ['zh-CN', 'en', 'xx'][1 + page_id % 3] AS lang, url FROM pages),
s AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(trim(name), '`''"'), '(?i)\.pdf$', '')), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), ' .') AS stem FROM p),
e AS (SELECT *, CASE lang WHEN 'zh-CN' THEN 'cn' WHEN 'en' THEN 'en' ELSE 'localized' END AS suffix FROM s),
c AS (SELECT *, trim(regexp_replace(stem, CASE lang WHEN 'zh-CN' THEN '(?i)[\s_-]*(?:cn|中文版|中文)$' WHEN 'en' THEN '(?i)[\s_-]*(?:en|中文版|中文)$' ELSE '(?i)[\s_-]*(?:localized|中文版|中文)$' END, ''), ' ._-') AS cut FROM e)
SELECT page_id, stem, CASE WHEN cut <> '' THEN cut || '_' || suffix || '.pdf' END AS file_name,
       array_to_string(list_filter(regexp_extract_all(url, '[0-9]+(?:[._-][0-9]+)*|[A-Za-z]+(?:[A-Za-z0-9._-]*[A-Za-z0-9])?'), lambda x: (regexp_matches(x, '[0-9]') OR regexp_matches(x, '[-_.]') OR regexp_matches(x, '^[A-Z]{2,}$')) AND NOT contains(lower('Doc 12'), lower(x))), ' ') AS missing FROM c""")
def filename_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    name = F.concat(F.regexp_replace("url", "^.*/", ""), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, " _cn").otherwise(""))
    lang = bind.pick(["zh-CN", "en", "xx"], k % 3)
    kept = t.kept_name_tokens(F.col("url"), F.lit("Doc 12"))
    return table(spark, sf_dir, "pages").select("page_id", t.clean_stem(name).alias("stem"), t.result_file_name(name, lang).alias("file_name"), F.substring(kept, 8, 10_000).alias("missing"))


@query(r"""
SELECT n_nationkey, lang, CASE lang WHEN 'zh-CN' THEN regexp_matches(stem, '[\x{3400}-\x{9fff}]') AND NOT regexp_matches(stem, '[\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]') AND NOT regexp_matches(stem, '[A-Za-z]{2,}') AND regexp_matches(stem, '[说明书]')
   WHEN 'ja' THEN regexp_matches(stem, '[\x{3040}-\x{30ff}]') WHEN 'ko' THEN regexp_matches(stem, '[\x{ac00}-\x{d7af}]') WHEN 'en' THEN regexp_matches(stem, '[A-Za-z]{2,}') AND NOT regexp_matches(stem, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') ELSE false END AS same,
   CASE WHEN lang = 'zh-CN' AND regexp_matches(stem, '[\x{3400}-\x{9fff}]') THEN stem ELSE 'Final' END AS safe
FROM (SELECT n_nationkey, unnest(['zh-CN', 'ja', 'ko', 'en', 'fr']) AS lang, ['说明书', 'カタログ', '카탈로그', n_name, '图 A'][1 + n_nationkey % 5] AS stem FROM nation)""")
def filename_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    stem = F.when(k % 5 == 0, "说明书").when(k % 5 == 1, "カタログ").when(k % 5 == 2, "카탈로그").when(k % 5 == 3, F.col("n_name")).otherwise("图 A")
    rows = n.select("n_nationkey", stem.alias("stem"), F.explode(F.array(*map(F.lit, ["zh-CN", "ja", "ko", "en", "fr"]))).alias("lang"))
    return rows.select("n_nationkey", "lang", t.name_in_language(F.col("stem"), F.col("lang"), "说明书").alias("same"), t.name_or_original(F.col("stem"), F.lit("Final"), F.col("lang")).alias("safe"))


def nfkc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate("n_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    return table(spark, sf_dir, "nation").select("n_nationkey", t.nfkc(wide).alias("name"), t.utf8_cut(7)(wide).alias("cut"))


bind.QUERIES["nfkc_names"] = nfkc_names
bind.SQL["nfkc_names"] = "SELECT n_nationkey, n_name AS name, translate(left(n_name, 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ') AS cut FROM nation"


@query("SELECT doc_id, page_index, sha256('translate' || chr(0) || doc_id || chr(0) || page_index || chr(0) || string_agg(id || '=' || source_text, chr(0) ORDER BY reading_order)) AS batch_key FROM blocks GROUP BY doc_id, page_index", "blocks")
def batch_key_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", F.concat("id", F.lit("="), "source_text").alias("x")))), lambda r: r["x"]), "\0")
    g = bind.blocks(spark, sf_dir).groupBy("doc_id", "page_index").agg(rows.alias("x"))
    return g.select("doc_id", "page_index", v.sha256_key(F.lit("translate"), F.col("doc_id").cast("string"), F.col("page_index").cast("string"), F.col("x")).alias("batch_key"))


@query("SELECT doc_id, page_index, CAST(to_json(list({'id': id, 'text': source_text} ORDER BY reading_order)) AS VARCHAR) AS payload FROM blocks GROUP BY ALL", "blocks")
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.payload(bind.blocks(spark, sf_dir), ["doc_id", "page_index"])


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's reply, by document: as asked, with ids rewritten, the first missing, the first twice, all under one unknown
    id, or as asked with an unknown id twice."""
    b = bind.blocks(spark, sf_dir)
    d = F.col("doc_id") % 6
    item = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "id"))), lambda r: F.struct(F.when(d == 1, F.concat(F.lit("x"), r["id"])).when(d == 4, "same").otherwise(r["id"]).alias("id"), F.when(r["reading_order"] % 3 == 0, "").otherwise(F.concat(F.lit("T"), r["id"])).alias("text")))
    rows = b.groupBy("doc_id", "page_index").agg(item.alias("i"))
    strange = F.array_repeat(F.struct(F.lit("?").alias("id"), F.lit("x").alias("text")), 2)
    items = F.when(d == 2, F.slice("i", 2, F.greatest(F.lit(1), F.size("i")))).when(d == 3, F.concat("i", F.slice("i", 1, 1))).when(d == 5, F.concat("i", strange)).otherwise(F.col("i"))
    return rows.select("doc_id", "page_index", F.concat(F.lit("```json\n"), F.to_json(F.struct(items.alias("translations"))), F.lit("\n```")).alias("reply"))


@query("""
, p AS (SELECT *, ['ok', 'positional', 'missing', 'duplicate', 'positional', 'unknown'][1 + doc_id % 6] AS status FROM blocks)
SELECT doc_id, page_index, id, status, CASE WHEN status IN ('ok', 'positional') THEN CASE WHEN reading_order % 3 = 0 THEN source_text ELSE 'T' || id END END AS target_text FROM p""", "blocks")
def reply_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    page = ["doc_id", "page_index"]
    asked = bind.blocks(spark, sf_dir).select(*page, "id", "source_text", (F.row_number().over(Window.partitionBy(*page).orderBy("reading_order")) - 1).alias("position"))
    reply = translation.parse_reply(_replies(spark, sf_dir), "reply", page)
    return translation.resolve_reply(asked, reply, page).select(*page, "id", "status", "target_text")


@query("SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS BIGINT) AS input_tokens, CAST(event_id % 50 AS BIGINT) AS output_tokens, CAST(coalesce(json_extract_string(props, '$.k')::BIGINT, 0) + event_id % 50 AS BIGINT) AS total_tokens, true AS token_usage_available FROM events")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("null"))
    payload = F.concat(F.lit('{"usage":{"prompt_tokens":'), k, F.lit(',"output_tokens":'), (F.col("event_id") % 50).cast("string"), F.lit("}}"))
    return e.select("event_id", external.usage(payload).alias("u")).select("event_id", "u.*")


@query(r"""SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE nullif(regexp_replace(CASE turn % 4 WHEN 1 THEN text || ' and more' ELSE text END, '^\s+|\s+$', '', 'g'), '') END AS text FROM conversations""")
def message_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings, arrays with parts of both text kinds and of others, and arrays that say nothing."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    plain = F.expr("substring(j, 6, length(j) - 6)")
    both = F.to_json(F.array(part("text", F.col("text")), part("image", F.lit("never")), part(None, F.lit("nor this")), part("output_text", F.lit(" and more"))))
    none = F.to_json(F.array(part("image", F.col("text")), part("output_text", F.lit("  "))))
    rows = table(spark, sf_dir, "conversations").withColumn("j", F.to_json(F.struct(F.col("text").alias("v"))))
    k = F.col("turn") % 4
    return rows.select("conv_id", "turn", external.content(F.when(k == 1, both).when(k == 3, none).otherwise(plain)).alias("text"))


@query("""
, r AS (SELECT doc_id, pos, trim(source_text) AS source_text, CASE WHEN pos % 2 = 0 THEN translate(trim(source_text), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE 'other' END AS target_text, pos % 3 <> 0 AS flagged FROM lines),
d AS (SELECT DISTINCT lower(trim(source_text)) AS key FROM lines WHERE length(trim(source_text)) <= 12)
SELECT r.doc_id, r.pos, CASE WHEN flagged AND lower(target_text) = lower(source_text) AND d.key IS NOT NULL THEN CASE WHEN length(d.key) % 2 = 0 THEN 'P' ELSE 'W' END || d.key ELSE target_text END AS target_text FROM r LEFT JOIN d ON d.key = lower(r.source_text)""", "lines")
def dictionary_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.lines(spark, sf_dir).select("doc_id", "pos", F.trim("source_text").alias("source_text"), F.when(F.col("pos") % 2 == 0, F.translate(F.trim("source_text"), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise("other").alias("target_text"))
    keys = bind.lines(spark, sf_dir).where(F.length(F.trim("source_text")) <= 12).select(F.lower(F.trim("source_text")).alias("key")).distinct()
    phrases = keys.where(F.length("key") % 2 == 0).select("key", F.concat(F.lit("P"), "key").alias("value"))
    every = keys.select("key", F.concat(F.lit("W"), "key").alias("value"))
    return translation.dictionary_repair(rows, phrases, every, F.col("pos") % 3 != 0).select("doc_id", "pos", "target_text")


@query(f""", g AS ({_GLOSSARY}) SELECT c_custkey, r.source_text, CASE WHEN e.id IS NOT NULL OR l.id IS NOT NULL THEN coalesce(e.target_text, l.target_text) ELSE 'x' END AS target_text, e.id IS NOT NULL OR l.id IS NOT NULL AS repaired
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE n_name || '?' END AS source_text FROM customer JOIN nation ON c_nationkey = n_nationkey) r LEFT JOIN g e ON e.source_text = r.source_text LEFT JOIN g l ON lower(l.source_text) = lower(r.source_text)""")
def table_term_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.lower("n_name")).otherwise(F.concat("n_name", F.lit("?"))).alias("source_text"), F.lit("x").alias("target_text"))
    return translation.table_term_repair(rows, _glossary(spark, sf_dir).select(F.col("source_text").alias("key"), F.col("target_text").alias("value")))


@query("SELECT doc_id * 100000 + pos AS id, CASE WHEN doc_id % 2 = 0 THEN 'b' || pos ELSE 'a' || pos END AS target_text FROM lines", "lines")
def map_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.lines(spark, sf_dir).select("doc_id", (F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.col("pos").cast("string").alias("pos"))
    first = rows.where("doc_id % 3 <> 2 or doc_id % 2 = 1").select("id", F.concat(F.lit("a"), "pos").alias("target_text"))
    second = rows.where("doc_id % 2 = 0").select("id", F.concat(F.lit("b"), "pos").alias("target_text"))
    return translation.override(first, second, "id", "target_text")


@query("SELECT doc_id, id FROM blocks WHERE preserve_reason IS NULL AND fragment_confidence >= 0.55 AND pos % 4 IN (1, 2)", "blocks")
def missing_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bind.blocks(spark, sf_dir)
    said = b.where("pos % 4 <> 1").select("doc_id", "id", F.when(F.col("pos") % 4 == 2, " ").otherwise("x").alias("target_text"))
    return translation.missing_translations(b, said).select("doc_id", "id")


_TERMS = "list_filter(list_transform(regexp_split_to_array(o_orderpriority || ' , ' || o_orderstatus || chr(10) || '，x', '[,，\n]'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""SELECT o_orderkey, array_to_string({_TERMS}, '|') AS terms, left(CASE WHEN o_orderkey % 3 = 0 THEN 'TimeoutError' ELSE trim('  ' || o_orderpriority) END, 500) AS error,
  (o_orderkey % 2 = 0)::INT || ' -> zh' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'keep names' ELSE '' END || chr(10) || 'keep: ' || array_to_string({_TERMS}, ', ')
  || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || o_orderstatus || ' => ' || o_orderpriority ELSE chr(10) || o_orderstatus || ' => ' || o_orderpriority || chr(10) || 'a => b' END AS head FROM orders""")
def terms_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    terms = t.protected_terms(F.concat("o_orderpriority", F.lit(" , "), "o_orderstatus", F.lit("\n，x")))
    error = t.safe_error(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("  "), "o_orderpriority")), F.lit("TimeoutError"))
    policy = F.struct((k % 2 == 0).cast("int").cast("string").alias("source_language"), F.lit("zh").alias("target_language"), (k % 2 == 0).alias("names"), terms.alias("protected_terms"))
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    pairs = F.slice(F.array(pair(F.col("o_orderstatus"), F.col("o_orderpriority")), pair(F.lit("a"), F.lit("b"))), 1, (k % 3).cast("int"))
    head = t.instruction(policy, pairs, {"names": "keep names"})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(terms, "|").alias("terms"), error.alias("error"), head.alias("head"))


@query("SELECT doc_id, pos, sha256(lang || chr(0) || trim(source_text)) AS key, trim(replace(trim(source_text), 'the ', '')) AS without FROM lines", "lines")
def keys_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.lines(spark, sf_dir).select("doc_id", "pos", v.sha256_key(F.col("lang"), F.trim("source_text")).alias("key"), F.trim(t.remove_terms(F.trim("source_text"), F.array(F.lit("the "), F.lit("")))).alias("without"))


@query("""
, i AS (SELECT doc_id, page_index, id AS region_id, k, CASE WHEN k % 9 = 8 THEN 'bad' ELSE 'ok' END AS state FROM (SELECT *, unnest(range(0, 20 + doc_id % 10)) AS k FROM regions))
SELECT i.doc_id, i.region_id || '-v' || printf('%04d', k + 1) AS id, round_even(r.x0 + (10.0::DOUBLE * k) / 1000 * (r.x1 - r.x0), 6) AS x0, round_even(r.top + 100.0::DOUBLE / 1000 * (r.bottom - r.top), 6) AS top,
       round_even(r.x0 + least(1000.0::DOUBLE, 10.0::DOUBLE * k + 300) / 1000 * (r.x1 - r.x0), 6) AS x1, round_even(r.top + 200.0::DOUBLE / 1000 * (r.bottom - r.top), 6) AS bottom
FROM i JOIN regions r ON r.doc_id = i.doc_id AND r.id = i.region_id WHERE state = 'ok' AND 20 + i.doc_id % 10 <= 24""", "regions")
def vision_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bind.regions(spark, sf_dir)
    k = F.col("position")
    rows = r.select("doc_id", F.col("id").alias("region_id"), F.explode(F.sequence(F.lit(0), (19 + F.col("doc_id") % 10).cast("int"))).alias("position"))
    box = F.when(k % 9 == 8, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.5), F.lit(9.0))).otherwise(F.array(10.0 * k, F.lit(100.0), 10.0 * k + 300, F.lit(200.0)))
    items = rows.select("*", F.lit("s").alias("source_text"), F.lit("t").alias("target_text"), box.alias("bbox"))
    return external.seen_blocks(items, r).select("doc_id", "id", *(F.bround(c, 6).alias(c) for c in ("x0", "top", "x1", "bottom")))


@query("""
, j AS (SELECT doc_id, o, source_text, kind FROM (SELECT doc_id, ord AS o, source_text, kind FROM parsed))
SELECT doc_id, printf('p%04d-m%04d', o // 8 + 1, o + 1) AS id, array_to_string(list_filter(list_transform(string_split(source_text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS source_text,
       round_even(100.0::DOUBLE / 1000 * 612, 6) AS x0, round_even((50.0::DOUBLE + 100 * (o % 8)) / 1000 * 792, 6) AS top,
       CASE WHEN contains(kind, 'table') THEN 'table' WHEN kind = 'image' THEN 'chart' WHEN kind = 'title' THEN 'heading' ELSE 'body' END AS region_type
FROM (SELECT doc_id, o, kind, replace(replace(replace(replace(regexp_replace(source_text, '<[^>]+>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS source_text FROM j)
WHERE trim(source_text, chr(10) || chr(9) || ' ') <> ''""", "parsed")
def layout_from_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bind.parsed(spark, sf_dir)
    o = F.col("ord")
    item = F.struct("ord", F.col("kind").alias("type"), F.col("source_text").alias("text"), F.array(F.lit(100.0), 50.0 + 100 * (o % 8), F.lit(900.0), 140.0 + 100 * (o % 8)).alias("bbox"), F.floor(o / 8).cast("int").alias("page_idx"))
    docs = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("i")).select("doc_id", F.to_json("i").alias("items"), "i")
    pages = p.select("doc_id", "page_index", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()
    got = scans.layout_from_items(docs, pages)
    ords = docs.select("doc_id", F.posexplode("i.ord").alias("ord", "o"))
    rows = got.join(ords, ["doc_id", "ord"])
    return rows.select("doc_id", F.format_string("p%04d-m%04d", F.col("page_index") + 1, F.col("o") + 1).alias("id"), "source_text", F.bround("x0", 6).alias("x0"), F.bround("top", 6).alias("top"), "region_type")
