"""Queries over what services and repairs bring: replies, residuals, names, uploads, pixels of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import geometry
from foliograph.functions import text as t
from foliograph.functions.geometry import Box
from foliograph.operators import blocks as b
from foliograph.operators import external, grouping, pixels, quality, spatial
from foliograph.plans import bind
from foliograph.plans.bind import query, table
from foliograph.plans import layout_queries  # noqa: F401 - its SQL is used here
from foliograph.sources import scans, sinks

PAGE = ("doc_id", "page_index")


# ------------------------------------------------------------------------------------------- grouping


@query("""
, c AS (SELECT *, (pos // 3) % 4 AS c FROM blocks),
g AS (SELECT doc_id, page_index, c, string_agg(id, ',' ORDER BY top, x0, id) AS ids, min(top) AS t FROM c GROUP BY ALL)
SELECT doc_id, page_index, ids, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY t, c) AS INT) AS number FROM g""", "blocks")
def table_cell_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (F.floor(F.col("pos") / 3) % 4).cast("double")
    cell = F.struct((60 + 100 * c).alias("x0"), F.lit(60.0).alias("top"), (160 + 100 * c).alias("x1"), F.lit(700.0).alias("bottom"))
    found = grouping.cell_groups(bind.blocks(spark, sf_dir).withColumn("cell", cell))
    return found.select(*PAGE, F.array_join(F.transform("members", lambda m: m["id"]), ",").alias("ids"), "number")


@query("""
, l AS (SELECT doc_id, page_index, pos AS line, pos % 3 AS k, lag(pos) OVER (PARTITION BY doc_id, page_index ORDER BY pos) AS before FROM blocks)
SELECT doc_id, page_index, line, CASE WHEN k = 1 AND before = line - 1 THEN before ELSE line END AS "into" FROM l""", "blocks")
def orphan_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lone characters under lines that end in kana, and under others."""
    p = F.col("pos")
    text = F.when(p % 3 == 0, "abcカ").when(p % 3 == 1, "カ").otherwise("abc")
    rows = bind.blocks(spark, sf_dir).select(*PAGE, p.alias("line"), text.alias("text"), F.lit(1).alias("boxes"), "x0", "top", F.lit(84.0).alias("x1"), "bottom")
    return grouping.merge_orphans(rows)


@query("""
, c AS (SELECT l_suppkey AS supplier, l_partkey AS position, CAST(max(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY ALL),
n AS (SELECT *, CASE WHEN position - lag(position) OVER w <= 2 THEN 0 ELSE 1 END AS n FROM c WINDOW w AS (PARTITION BY supplier ORDER BY position)),
r AS (SELECT *, sum(n) OVER (PARTITION BY supplier ORDER BY position ROWS UNBOUNDED PRECEDING) AS r FROM n)
SELECT supplier, arg_max(position, (score, -position)) AS position, max(score) AS score FROM r GROUP BY supplier, r""")
def strongest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("position")).agg(F.max("l_quantity").cast("double").alias("score"))
    return grouping.strongest_of_neighbours(c, ["supplier"])


@query("""
, p AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 256) / 255.0::DOUBLE AS r, (l_suppkey * 13 % 256) / 255.0::DOUBLE AS g, (l_linenumber * 31 % 256) / 255.0::DOUBLE AS b FROM lineitem)
SELECT l_orderkey, round_even(median(r), 9) AS r, round_even(median(g), 9) AS g, round_even(median(b), 9) AS b FROM p GROUP BY l_orderkey""")
def median_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, k, name: (F.col(c) * k % 256 / F.lit(255.0)).alias(name)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(part("l_partkey", 7, "r"), part("l_suppkey", 13, "g"), part("l_linenumber", 31, "b")).alias("rgb"))
    return grouping.median_color(rows, ["l_orderkey"]).select("l_orderkey", *(F.bround(c, 9).alias(c) for c in "rgb"))


def fused_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of relabelled native blocks and unseen parsed ones."""
    parsed = bind.parsed(spark, sf_dir)
    return spatial.fuse(bind.blocks(spark, sf_dir), parsed).select("doc_id", "page_index", "id", "region_type")


bind.QUERIES["fused_layout"] = fused_layout
bind.SQL["fused_layout"] = f"""SELECT doc_id, CAST(substr(id, 2, 4) AS INT) - 1 AS page_index, id, region_type FROM ({bind.SQL['fusion_relabel']})
UNION ALL SELECT doc_id, page_index, id, CASE (CAST(substr(id, 2) AS INT) - 1) % 5 WHEN 4 THEN 'table' WHEN 3 THEN 'chart' ELSE 'caption' END FROM ({bind.SQL['fusion_append']})"""


# ------------------------------------------------------------------------------------------- texts


@query(r"""SELECT doc_id, pos, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(source_text, '. ', '.' || chr(13) || chr(10) || chr(9)), '\r\n|\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS cell FROM lines""", "lines")
def normalized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.lines(spark, sf_dir).select("doc_id", "pos", t.normalize_cell(F.replace("source_text", F.lit(". "), F.lit(".\r\n\t"))).alias("cell"))


@query(r"""SELECT doc_id, pos, regexp_matches(x, '[A-Za-z\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') AS natural FROM (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN source_text WHEN 1 THEN '12 - 7 %' WHEN 2 THEN '漢' ELSE 'é' END AS x FROM lines)""", "lines")
def natural_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("pos") % 4 == 0, F.col("source_text")).when(F.col("pos") % 4 == 1, "12 - 7 %").when(F.col("pos") % 4 == 2, "漢").otherwise("é")
    return bind.lines(spark, sf_dir).select("doc_id", "pos", t.natural_language(text).alias("natural"))


@query("SELECT n_name AS source_text, CAST(row_number() OVER (ORDER BY n_regionkey DESC, lower(n_name)) AS INT) AS place FROM nation")
def glossary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms as the glossary shows them: last changed first, then by source up to ASCII case. Places are given within an
    hour of change and offset by the later ones' counts."""
    terms = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_text"), F.col("n_regionkey").alias("updated_at"))
    return scans.glossary_places(terms).select("source_text", "place")


_NAMES = "['説明書', '说明书', 'Annual_Report-2019 AB', 'Katalog', '图 A']"


@query(f"""
, j AS (SELECT o_orderkey AS job_id, {_NAMES}[1 + o_orderkey % 5] AS stem, CASE WHEN o_orderkey % 2 = 0 THEN 'zh-CN' ELSE 'en' END AS lang FROM orders)
SELECT job_id, CASE WHEN stem = 'Katalog' AND lang = 'zh-CN' THEN '目录' WHEN lang = 'zh-CN' AND stem = '说明书' THEN stem WHEN lang = 'en' AND stem IN ('Annual_Report-2019 AB', 'Katalog') THEN stem
  WHEN stem = 'Annual_Report-2019 AB' THEN '报告 Annual_Report-2019 AB AB' WHEN lang = 'zh-CN' AND stem = '図 A' THEN stem WHEN lang = 'zh-CN' THEN '报告' ELSE 'Report' END AS stem FROM j""")
def translated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names through dictionary, language test and a translator that says the same of every name."""
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(k.alias("job_id"), bind.pick(["説明書", "说明书", "Annual_Report-2019 AB", "Katalog", "图 A"], k % 5).alias("stem"), F.when(k % 2 == 0, "zh-CN").otherwise("en").alias("target_language"), F.array(F.lit("AB")).alias("protected_terms"))
    dictionary = spark.createDataFrame([("zh-CN", "Katalog", "目录"), ("ja", "图 A", "no")], "target_language string, key string, value string")
    say = lambda items: ({i["id"]: " 报告 " if int(i["id"]) % 2 == 0 else "Report" for i in items}, {})
    return external.translate_names(jobs, dictionary, say, "说书")


# ------------------------------------------------------------------------------------------- calls


def _halvings(n: int, most: int) -> int:
    """Calls for a batch of n blocks where only batches of at most so many succeed."""
    return 1 if n <= most else 1 + _halvings(n // 2, most) + _halvings(n - n // 2, most)


MOST_AT_ONCE = 3
_CALLS = str([_halvings(n, MOST_AT_ONCE) for n in range(1, bind.LINES + 1)])


@query(f"""
, k AS (SELECT *, pos % 7 = 3 AS done FROM blocks), n AS (SELECT doc_id, page_index, count(*) AS n FROM k WHERE NOT done GROUP BY ALL)
SELECT k.doc_id, k.page_index, id, CASE WHEN done THEN 'kept' WHEN pos % 5 = 4 THEN source_text ELSE 'T' || length(source_text) END AS target_text, CASE WHEN done THEN 0 ELSE {_CALLS}[n.n] END AS calls
FROM k LEFT JOIN n ON n.doc_id = k.doc_id AND n.page_index = k.page_index""", "blocks")
def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which some blocks were translated before, through a translator that refuses more than a few at once, drops
    its first connection for some batches and leaves every fifth text empty."""

    def translate(items: list[dict]) -> tuple[dict, dict]:
        if len(items) > MOST_AT_ONCE:
            raise ValueError("too many at once")
        blank = lambda i: int(i["id"].split("-b")[1]) % 5 == 0
        return {i["id"]: "  " if blank(i) else f"T{len(i['text'])}" for i in items}, {}

    rows = bind.blocks(spark, sf_dir)
    done = rows.where("pos % 7 = 3").select(*PAGE, "id", F.lit("kept").alias("target_text"))
    return external.translate_batches(rows, list(PAGE), _flaky(translate), done).select(*PAGE, "id", "target_text", "calls")


def _flaky(translate):
    """A translator that is busy at its first call."""
    state = {"calls": 0}

    def call(items: list[dict]) -> tuple[dict, dict]:
        state["calls"] += 1
        if state["calls"] == 1:
            raise external.Busy(503)
        return translate(items)

    return call


@query("SELECT doc_id, page_index, id, 'R' || length(source_text) AS target_text FROM blocks WHERE pos % 6 = 0", "blocks")
def retranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only flagged blocks, some of them flagged twice."""
    rows = bind.blocks(spark, sf_dir)
    flagged = rows.where("pos % 6 = 0").select("doc_id", "id")
    say = lambda items: ({i["id"]: f"R{len(i['text'])}" for i in items}, {})
    return external.retranslate(rows, flagged.unionByName(flagged), say).select(*PAGE, "id", "target_text")


@query("""
, f AS (SELECT *, CASE WHEN region_type = 'table' THEN 6.5::DOUBLE WHEN region_type = 'chart' THEN 6.0 ELSE 7.0 END AS f FROM blocks),
c AS (SELECT *, CAST(greatest(4, greatest(1, floor(greatest(1.0::DOUBLE, x1 - x0) / f)) * greatest(1, floor(greatest(1.0::DOUBLE, bottom - top) / (f * 1.12::DOUBLE)))) AS BIGINT) AS most FROM f)
SELECT doc_id, page_index, id, CASE WHEN pos % 4 = 0 THEN source_text || '+' ELSE trim(left(source_text || '+', most)) END AS target_text FROM c""", "blocks")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translator that cuts to what the box holds, and says nothing of some blocks."""

    def cut(items: list[dict]) -> tuple[dict, dict]:
        import json

        asked = {i["id"]: json.loads(i["text"]) for i in items}
        return {k: "" if (int(k.split("-b")[1]) - 1) % 4 == 0 else a["current"][: a["most_characters"]] for k, a in asked.items()}, {}

    rows = bind.blocks(spark, sf_dir).withColumn("target_text", F.concat("source_text", F.lit("+")))
    return external.shorten(rows, cut).select(*PAGE, "id", "target_text")


@query("""
, i AS (SELECT doc_id, id AS region_id, unnest(range(0, 1 + doc_id % 30)) AS k FROM regions)
SELECT doc_id, region_id, count(*) AS items FROM i GROUP BY ALL HAVING count(*) <= 24 AND count(*) FILTER (doc_id % 4 <> 0 AND k % 3 = 2) = 0""", "regions")
def unreadable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("position")
    rows = bind.regions(spark, sf_dir).select("doc_id", F.col("id").alias("region_id"), F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 30).cast("int"))).alias("position"))
    good = (F.col("doc_id") % 4 != 0) & (k % 3 == 2)
    box = F.when(k % 3 == 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(10.0), F.lit(100.0), F.lit(300.0), F.lit(200.0)))
    items = rows.select("*", F.lit("s").alias("source_text"), F.when(good, "t").otherwise(" ").alias("target_text"), box.alias("bbox"))
    return external.unreadable_regions(items)


@query("""
SELECT doc_id, id || '-q02-v0003' AS id, round_even(x0 + 0.1::DOUBLE * (x1 - x0), 6) AS x0, round_even(bottom, 6) AS bottom, round_even(greatest(5.0::DOUBLE, least(18.0::DOUBLE, 0.9::DOUBLE * (bottom - top) / 2 * 0.78::DOUBLE)), 6) AS font_size FROM regions""", "regions")
def residual_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair blocks of the second attempt, of two lines each, from boxes that reach beyond their region."""
    r = bind.regions(spark, sf_dir)
    box = F.array(F.lit(100.0), F.lit(100.0), F.lit(900.0), F.lit(1200.0))
    items = r.select("doc_id", F.col("id").alias("region_id"), F.lit(2).alias("position"), F.lit("two\nlines").alias("source_text"), F.lit("t").alias("target_text"), box.alias("bbox"))
    found = external.residual_blocks(items, r, 2)
    return found.select("doc_id", "id", *(F.bround(c, 6).alias(c) for c in ("x0", "bottom", "font_size")))


# ------------------------------------------------------------------------------------------- issues


@query("""
, r AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN source_text || ' the' ELSE 'ok' END AS t FROM lines WHERE pos % 2 = 0)
SELECT doc_id, stage, code, message, block_id FROM (
  SELECT doc_id, 'validation' AS stage, 'page_render_failed' AS code, 'no page ' || doc_id % 7 AS message, NULL AS block_id FROM documents WHERE doc_id % 7 = 3
  UNION ALL SELECT doc_id, 'translation-quality', 'translation_quality_failed', printf('p%04d-b%04d', pos // 40 + 1, pos + 1) || ' generic_english', printf('p%04d-b%04d', pos // 40 + 1, pos + 1) FROM r WHERE t <> 'ok'
  UNION ALL SELECT doc_id, 'visual-quality', 'untranslated_visual_text', count(*) || ': ' || array_to_string(list(trim(source_text) ORDER BY pos)[1:10], ', '), NULL FROM lines WHERE pos % 5 = 0 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'visual-quality', 'quality_evaluation_failed', 'no answer', NULL FROM documents WHERE doc_id % 9 = 4)""", "lines")
def late_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validation adds after drawing: pages not drawn, texts and visible words left over, reviews that broke off."""
    docs, rows = table(spark, sf_dir, "documents").select("doc_id"), bind.blocks(spark, sf_dir)
    d = F.col("doc_id")
    undrawn = docs.where(d % 7 == 3).withColumn("error", F.concat(F.lit("no page "), (d % 7).cast("string")))
    left = rows.where("pos % 6 = 0").select("doc_id", "id", F.lit("generic_english").alias("code"))
    seen = rows.where("pos % 5 = 0").select("doc_id", F.col("pos").alias("ord"), F.trim("source_text").alias("text"))
    broken = docs.select("doc_id", (d % 9 != 5).alias("has_file"), F.when((d % 9).isin(4, 5), "no answer").alias("error"))
    every = quality.union_issues(quality.render_failures(undrawn), quality.text_failures(left), quality.visual_failures(seen), quality.evaluation_failures(broken))
    return every.select("doc_id", "stage", "code", "message", "block_id")


@query("""
SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'again' WHEN 2 THEN 'by hand' ELSE trim(source_text) END AS target_text, CASE pos % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS repairs FROM lines""", "lines")
def repair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that mends some texts at once and some at its second try, and a fixed rule for those that it never does."""
    rows = bind.lines(spark, sf_dir).select("doc_id", "pos", F.trim("source_text").alias("target_text"), F.lit(0).alias("repairs"), (F.col("pos") % 4 != 3).alias("bad"))
    find = lambda df: df.where("bad").select("doc_id", "pos")

    def mend(df: DataFrame, problems: DataFrame, fixed: bool) -> DataFrame:
        hit = df.join(problems.withColumn("_hit", F.lit(True)), ["doc_id", "pos"], "left")
        k, n = F.col("pos") % 4, F.col("repairs")
        good = F.col("_hit") & (F.lit(fixed) | (k == 0) | ((k == 1) & (n == 1)))
        text = F.when(good, F.when(F.lit(fixed), "by hand").when(k == 0, "fixed").otherwise("again")).otherwise(F.col("target_text"))
        return hit.select("doc_id", "pos", text.alias("target_text"), (n + F.coalesce("_hit", F.lit(False)).cast("int")).alias("repairs"), (F.col("bad") & ~F.coalesce(good, F.lit(False))).alias("bad"))

    model, rule = (lambda df, p: mend(df, p, False)), (lambda df, p: mend(df, p, True))
    return quality.repair_rounds(rows, find, [model, rule, rule]).select("doc_id", "pos", "target_text", "repairs")


# ------------------------------------------------------------------------------------------- files and places


@query("""
SELECT doc_id, id, round_even(greatest(0, x0 - 80), 6) AS x0, greatest(0, top) AS top, least(612, x1) AS x1, least(400, bottom) AS bottom FROM blocks WHERE source_type = 'native' AND least(400, bottom) > greatest(0, top)""", "blocks")
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.blocks(spark, sf_dir).withColumns({"outcome": F.when(F.col("source_type") == "native", "redact").otherwise("mask"), "x0": F.col("x0") - 80})
    pages = rows.select(*PAGE, F.lit(612.0).alias("width"), F.lit(400.0).alias("height")).distinct()
    return sinks.redactions(rows, pages).select("doc_id", "id", *(F.col(f"box.{c}").alias(c) for c in Box._fields))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 5 = 1 THEN 'too_large' WHEN doc_id % 5 = 2 THEN 'not_pdf' END AS reject FROM documents""")
def checked_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 5
    body = F.when(d == 0, F.lit("")).when(d == 2, F.concat(F.lit("GIF89"), "text")).otherwise(F.concat(F.lit("%PDF-1.7 "), "text"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode(body, "utf-8").alias("content")).withColumn("length", F.when(d == 1, scans.MOST_BYTES + 1).otherwise(F.length("content")))
    return scans.uploads(files).select("doc_id", "reject")


@query("""SELECT item_id, text AS markdown, item_id % 4 AS items FROM benchmark WHERE trim(text) <> '' OR item_id % 4 > 0""")
def service_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and placed content of a service's JSON, at any depth; items without a place do not count."""
    item = lambda boxed: F.struct(F.when(F.lit(boxed), F.array(*map(F.lit, (1, 2, 3, 4)))).alias("bbox"), F.lit(0).alias("page_idx"), F.lit("x").alias("text"))
    found = F.concat(F.array_repeat(item(True), (F.col("item_id") % 4).cast("int")), F.array(item(False)))
    deep = F.struct(F.struct(F.array(F.struct(F.lit("").alias("md_content"), F.col("text").alias("full_md"))).alias("files")).alias("data"), F.struct(found.alias("content_list")).alias("result"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.encode(F.to_json(deep), "utf-8").alias("reply"))
    got = scans.result_items(rows)
    return got.select(F.col("path").cast("long").alias("item_id"), "markdown", F.size(F.from_json("items", "array<struct<page_idx:int>>")).cast("long").alias("items"))


@query("""SELECT doc_id, id, page_index, source_type, length(source_text) AS n FROM (SELECT doc_id, 'l' || i AS id, 0 AS page_index, 'native' AS source_type, t AS source_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id % 3 > 0)
UNION ALL SELECT doc_id, NULL, p, 'page', NULL FROM (SELECT doc_id, unnest([0, 1]) AS p FROM documents WHERE doc_id % 3 = 0))""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser that takes lines for blocks and fails on every third file, of which only the pages are left."""

    def parse(data: bytes) -> list[dict]:
        if data.startswith(b"!"):
            raise ValueError("damaged")
        return [{"id": f"l{i}", "page_index": 0, "source_text": line, "source_type": "native"} for i, line in enumerate(data.decode().split("\n"), 1)]

    size = lambda data: [{"page_index": p, "x1": 612.0, "bottom": 792.0} for p in (0, 1)]
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("!"), "text")).otherwise(F.col("text"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(body, "utf-8").alias("content"))
    return scans.native_blocks(files, parse, size).select(F.col("path").cast("long").alias("doc_id"), "id", "page_index", "source_type", F.length("source_text").cast("long").alias("n"))


@query("""SELECT doc_id, id, CAST(page_index AS INT) AS page_index, sha256('144 ' || id || ' ' || doc_id) AS crop FROM regions""", "regions")
def region_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of every region by a renderer that names what it was asked for."""
    regions = bind.regions(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    files = regions.select("path", F.encode("path", "utf-8").alias("content")).distinct()
    draw = lambda data, asked, dpi: [f"{dpi} {a['id']} {data.decode()}".encode() for a in asked]
    return scans.rendered_regions(files, regions, draw).select(F.col("path").cast("long").alias("doc_id"), "id", "page_index", F.sha2("image_png", 256).alias("crop"))


# ------------------------------------------------------------------------------------------- colours and pixels


@query("""
, c AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS n, l_quantity::DOUBLE / 40 - 0.1 AS v, l_suppkey % 10 / 10.0::DOUBLE AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 OR n >= 3 THEN round_even(greatest(0.0, least(1.0, v)), 9) END AS r, CASE WHEN n = 1 THEN round_even(greatest(0.0, least(1.0, v)), 9) WHEN n >= 3 THEN w END AS g FROM c""")
def unit_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v, w = F.col("l_linenumber") % 5, F.col("l_quantity").cast("double") / 40 - 0.1, F.col("l_suppkey") % 10 / 10.0
    color = F.slice(F.array(v, w, w, w), 1, n.cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.unit_rgb(color).alias("c")).select("l_orderkey", "l_linenumber", F.bround("c.r", 9).alias("r"), F.col("c.g").alias("_g"), "c").select("l_orderkey", "l_linenumber", "r", F.bround("c.g", 9).alias("g"))


@query("""
SELECT doc_id, id, round_even(greatest(4.5::DOUBLE, least(CASE WHEN ord < 10 THEN 11.0::DOUBLE ELSE 8.0 END, (bottom - top - 2 * greatest(0.5::DOUBLE, least(1.2::DOUBLE, 0.08::DOUBLE * (bottom - top)))) / greatest(1, ord % 9) * 0.66::DOUBLE)), 6) AS font_size FROM cells""", "cells")
def cell_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = geometry.cell_font_size(geometry.cell_text_box(Box.flat()), F.col("ord") % 9, F.col("ord") < 10)
    return bind.cells(spark, sf_dir).select("doc_id", "id", F.bround(size, 6).alias("font_size"))


@query("""
, p AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(round_even((l_partkey % 3 * 100) / 8.0::DOUBLE, 0) AS INT) AS r, CAST(round_even((l_quantity::INT % 2 * 50) / 8.0::DOUBLE, 0) AS INT) AS g FROM lineitem),
c AS (SELECT l_suppkey, r, g, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM p GROUP BY ALL)
SELECT l_suppkey, arg_max(least(255, 8 * r) / 255.0::DOUBLE, (n, -first)) AS r, arg_max(least(255, 8 * g) / 255.0::DOUBLE, (n, -first)) AS g FROM c GROUP BY l_suppkey""")
def dominant_grounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent colour of each supplier's pixels, in steps of eight, the first met on ties."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3 * 100).cast("int").alias("r"), (F.col("l_quantity").cast("int") % 2 * 50).cast("int").alias("g")).alias("p"))
    images = rows.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("p")).alias("p")).select("l_suppkey", F.flatten(F.transform("p", lambda p: F.array(p["r"], p["g"], F.lit(7)))).alias("rgb"))

    def measure(r) -> dict:
        import numpy as np

        red, green, _ = pixels.dominant_color(np.asarray(r.rgb).reshape(-1, 3))
        return {"l_suppkey": r.l_suppkey, "r": red, "g": green}

    return pixels.per_image(images, measure, f"l_suppkey {images.schema['l_suppkey'].dataType.simpleString()}, r double, g double")


def _drawn_table(columns: int, rows: int, dots: int):
    """A white page of 500 by 400 with a grid of 60 by 30 from (40, 50) on, grey header cells, and dots that are no lines."""
    import numpy as np

    image = np.full((400, 500, 3), 255, np.uint8)
    x1, y1 = 40 + 60 * columns, 50 + 30 * rows
    image[50:80, 40:x1] = 200
    image[50 : y1 + 1 : 30, 40 : x1 + 1] = 0
    image[50 : y1 + 1, 40 : x1 + 1 : 60] = 0
    rng = np.random.default_rng(dots)
    image[rng.integers(0, 400, dots), rng.integers(0, 500, dots)] = 90
    return image, (40.0, 50.0, float(x1 + 1), float(y1 + 1))


@query("""
, g AS (SELECT n_nationkey, 2 + n_nationkey % 4 AS c, 2 + n_nationkey % 3 AS r FROM nation),
k AS (SELECT *, unnest(range(0, r)) AS y FROM g), x AS (SELECT *, unnest(range(0, c)) AS x FROM k),
t AS (SELECT *, CASE WHEN (x + y) % 3 = 2 THEN '12' ELSE 'cell ' || x || '-' || y END AS source_text FROM x)
SELECT n_nationkey, 't-c' || lpad(CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY y, x) AS VARCHAR), 4, '0') AS id, source_text, 40 + 60 * x AS "left", 50 + 30 * y AS top, CASE WHEN y = 0 THEN 11.0::DOUBLE ELSE 8.0 END AS font_size, y = 0 AS grey, NULL AS failure FROM t WHERE source_text <> '12' AND n_nationkey % 6 < 5
UNION ALL SELECT n_nationkey, NULL, NULL, NULL, NULL, NULL, NULL, 'the table lies outside its image' FROM nation WHERE n_nationkey % 6 = 5""")
def recovered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell blocks of drawn tables between dots that are no lines: ids, texts, where their cells start to the next whole
    point, sizes and grounds; for some tables the image is of another place."""
    import pandas as pd

    def read(parts):
        for part in parts:
            out = []
            for k in part["n_nationkey"]:
                columns, rows = 2 + k % 4, 2 + k % 3
                image, place = _drawn_table(columns, rows, 60)
                cells = [{"row": y, "column": x, "row_span": 1, "column_span": 1, "source_text": "12" if (x + y) % 3 == 2 else f"cell {x}-{y}", "is_header": y == 0} for y in range(rows) for x in range(columns)]
                region = (0.0, 0.0, 500.0, 400.0) if k % 6 < 5 else (0.0, 300.0, 500.0, 700.0)
                found, why = pixels.recover_table("t", 0, place, cells, rows, columns, image, region)
                out += [(int(k), c["id"], c["source_text"], round(c["x0"] / 10) * 10, round(c["top"] / 10) * 10, c["font_size"], bool(c["ground"][0] < 0.9), None) for c in found]
                out += [(int(k), None, None, None, None, None, None, why)] if why else []
            yield pd.DataFrame(out, columns=["n_nationkey", "id", "source_text", "left", "top", "font_size", "grey", "failure"]).astype({"left": "Int64", "top": "Int64", "grey": "boolean"})

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(read, "n_nationkey bigint, id string, source_text string, left bigint, top bigint, font_size double, grey boolean, failure string")


def wrapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents wrapped to 40 characters of half an em; held to plain Python in the tests."""
    wrap = b.wrapper()
    rows = bind.lines(spark, sf_dir).select("doc_id", "pos", wrap("source_text", F.lit(200.0), F.lit(10.0)).alias("l"))
    return rows.select("doc_id", "pos", F.size("l").cast("long").alias("lines"), F.array_join("l", "\n").alias("text"))


bind.QUERIES["wrapped_texts"] = wrapped_texts

