"""Entities from plain tables: blocks from the lines of documents, jobs from orders, logs from events.

No PDFs are at hand, so places on pages follow from line numbers: 40 lines of 14 points to a page of 612 by 792.
Each entity has a DataFrame here and the same as a common table expression in ``CTE``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PAGE_WIDTH, PAGE_HEIGHT, LINES = 612.0, 792.0, 40


def query(sql: str | None = None, *ctes: str):
    """Registers a query under its name, with its SQL: the named expressions in front."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ",\n".join(f"{c} AS ({CTE[c].strip()})" for c in _needed(ctes))
            body = sql.strip()
            SQL[f.__name__] = (f"WITH RECURSIVE {head}\n" if head else "WITH RECURSIVE " if body.startswith(",") else "") + (body if head else body.removeprefix(",").strip())
        return f

    return add


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_needed(USES.get(n, ())), n]:
            if m not in out:
                out.append(m)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


KINDS = ["native", "native", "native", "native-recovered", "vision", "image-table", "native"]
FONTS = ["Serif", "Serif-Bold", "Sans-Black", "Mono"]
TYPES = ["text", "title", "table_caption", "image", "table"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pos, source_text: the lines of documents that say something."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "source_text"))
    return rows.withColumn("pos", F.col("pos").cast("long")).where(F.col("source_text").rlike(r"\S"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = F.col("pos"), F.col("doc_id")
    top = 72.0 + 14.0 * (p % LINES)
    return lines(spark, sf_dir).select(
        "doc_id", "lang", "source", "pos", F.floor(p / LINES).cast("int").alias("page_index"),
        F.format_string("p%04d-b%04d", F.floor(p / LINES).cast("int") + 1, p + 1).alias("id"), "source_text",
        F.lit(72.0).alias("x0"), top.alias("top"), (72.0 + 6.0 * F.least(F.length("source_text"), F.lit(70))).alias("x1"), (top + 12.0).alias("bottom"),
        (8 + (p * 3 + d) % 9).cast("double").alias("font_size"), pick(FONTS, (d + p) % 4).alias("font_name"), pick(KINDS, (d + 2 * p) % 7).alias("source_type"),
        F.when((d + p) % 11 == 0, "held back").alias("preserve_reason"), F.when((d + p) % 13 == 0, 0.5).otherwise(1.0).alias("fragment_confidence"),
        (0.3 + 0.1 * ((d + p) % 8)).alias("geometry_fill_ratio"), p.alias("reading_order"), p.alias("ord"),
        F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"),
        F.when(p % 5 == 0, "table").when(p % 5 == 1, "chart").otherwise("body").alias("region_type"),
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parser blocks: five lines of a page each, moved by a little that depends on the document."""
    g = F.floor(F.col("pos") / 5).cast("int")
    rows = lines(spark, sf_dir).groupBy("doc_id", g.alias("ord")).agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_text"))), lambda x: x["source_text"]), "\n").alias("source_text"), F.max(F.length("source_text")).alias("_n"))
    shift = (F.col("doc_id") % 7).cast("double")
    top = 72.0 + 70.0 * (F.col("ord") % 8) + shift * 9
    return rows.select(
        "doc_id", "ord", F.floor(F.col("ord") / 8).cast("int").alias("page_index"), F.format_string("m%04d", F.col("ord") + 1).alias("id"), "source_text",
        (72.0 + shift * 30).alias("x0"), top.alias("top"), (72.0 + shift * 30 + 6.0 * F.least("_n", F.lit(70))).alias("x1"), (top + 60.0).alias("bottom"),
        F.lit("mineru").alias("source_type"), pick(TYPES, F.col("ord") % 5).alias("kind"),
        F.when(F.col("ord") % 5 == 4, "table").when(F.col("ord") % 5 == 3, "chart").otherwise("caption").alias("region_type"), F.lit(None).cast("string").alias("preserve_reason"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image regions: two on each page that has blocks, of a size that depends on the document."""
    pages = blocks(spark, sf_dir).select("doc_id", "page_index").distinct()
    rows = pages.select("doc_id", "page_index", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    d = (F.col("doc_id") % 5).cast("double")
    return rows.select("doc_id", "page_index", "ord", F.format_string("p%04d-i%04d", F.col("page_index") + 1, F.col("ord") + 1).alias("id"), (60.0 + 10 * d).alias("x0"), (60.0 + 280.0 * F.col("ord")).alias("top"), (300.0 + 50 * d).alias("x1"), (60.0 + 280.0 * F.col("ord") + 120.0 + 30 * d).alias("bottom"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rules on every page: as many rows and columns as the document's number says, some of them drawn short."""
    pages = blocks(spark, sf_dir).select("doc_id", "page_index").distinct()
    r, c, d = F.col("r").cast("double"), F.col("c").cast("double"), F.col("doc_id")
    rows = pages.select("doc_id", "page_index", F.explode(F.sequence(F.lit(0), (1 + d % 5).cast("int"))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), (1 + d % 4).cast("int"))).alias("c"))
    short = F.when((F.col("r") + F.col("c") + d) % 6 == 5, 0.4).otherwise(1.0)
    flat = rows.select("doc_id", "page_index", (60.0 + 120 * c).alias("x0"), (66.0 + 84 * r).alias("top"), (60.0 + 120 * c + 120 * short).alias("x1"), (66.5 + 84 * r).alias("bottom"), F.lit("h").alias("drawn"), ((F.col("r") + F.col("c")) % 3).cast("int").alias("paint"))
    tall = rows.select("doc_id", "page_index", (60.0 + 120 * c).alias("x0"), (66.0 + 84 * r).alias("top"), (60.5 + 120 * c).alias("x1"), (66.0 + 84 * r + 84 * short).alias("bottom"), F.lit("v").alias("drawn"), ((F.col("r") + F.col("c")) % 3).cast("int").alias("paint"))
    return flat.unionByName(tall)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = blocks(spark, sf_dir).select("doc_id", "page_index").distinct()
    d = F.col("doc_id")
    rows = pages.select("doc_id", "page_index", F.explode(F.sequence(F.lit(0), (1 + d % 5).cast("int"))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), (1 + d % 4).cast("int"))).alias("c"))
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    return rows.select("doc_id", "page_index", (F.col("r") * 10 + F.col("c")).cast("int").alias("ord"), F.format_string("c%d-%d", F.col("r"), F.col("c")).alias("id"), (60.25 + 120 * c).alias("x0"), (66.25 + 84 * r).alias("top"), (180.25 + 120 * c).alias("x1"), (150.25 + 84 * r).alias("bottom"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each word of each line, spaced by its number; every fifth hangs, every seventh is tall."""
    b = blocks(spark, sf_dir).select("doc_id", "page_index", "pos", "id", "top", "source_text")
    rows = b.select("doc_id", "page_index", "pos", F.col("id").alias("block_id"), F.col("top").alias("_t"), F.posexplode(F.expr("regexp_extract_all(source_text, '[^ ]+', 0)")).alias("k", "word"))
    rows = rows.withColumn("k", F.col("k").cast("long"))
    k = F.col("k")
    top = F.col("_t") + F.when(k % 5 == 4, 6.0).otherwise(0.0)
    return rows.select("doc_id", "page_index", "pos", "block_id", "k", "word", F.format_string("%s-w%06d", F.col("block_id"), k).alias("id"), (72.0 + 42.0 * k).alias("x0"), top.alias("top"), (102.0 + 42.0 * k + F.length("word") % 12).alias("x1"), (top + 10.0 + F.when(k % 7 == 6, 5.0).otherwise(0.0)).alias("bottom"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and their would-be translations: 7 becomes 8, and the first letter e goes in every third document."""
    t = F.trim("source_text")
    other = F.translate(t, "7", "8")
    target = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(other, "the ", "the  ")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("~"), other)).otherwise(other)
    return lines(spark, sf_dir).select("doc_id", "pos", t.alias("source_text"), target.alias("target_text"), (F.col("doc_id") * 100000 + F.col("pos")).alias("ord"))


STATUSES = ["completed", "needs_review", "failed", "queued", "translating", "cancelled"]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("File "), F.col("o_orderpriority"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.when(F.col("o_orderstatus") == "F", F.when(k % 4 == 0, "needs_review").otherwise("completed")).when(F.col("o_orderstatus") == "O", F.when(k % 3 == 0, "failed").when(k % 3 == 1, "queued").otherwise("translating")).otherwise("cancelled").alias("status"),
        (k % 130).cast("int").alias("progress"), pick(["v3", "v2", "legacy"], k % 3).alias("pipeline_version"), F.col("o_orderdate").alias("created_at"),
        F.when(k % 5 == 0, "old failure").when(k % 5 == 1, "no answer").alias("error_message"), F.concat(F.lit("in/"), (k % 1000).cast("string")).alias("source_path"), (k % 10 != 3).alias("has_file"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("stage"), F.col("value"), "props")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of labelled documents' lines: toxic ones are errors, of poor quality warnings."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    b = blocks(spark, sf_dir).select("doc_id", "source", "page_index", "id", "pos")
    rows = b.join(l.where("toxic = 1 or quality = 0"), "doc_id")
    return rows.select("doc_id", (F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.when(F.col("toxic") == 1, "error").otherwise("warning").alias("severity"), F.concat(F.lit("c-"), F.substring("source", 4, 1)).alias("code"), F.concat(F.lit("found in "), F.col("source")).alias("message"), "page_index", F.col("id").alias("block_id"))


_FONTS, _KINDS, _TYPES = (str(x) for x in (FONTS, KINDS, TYPES))
USES = {"blocks": ("lines",), "parsed": ("lines",), "pages_": ("blocks",), "regions": ("pages_",), "edges": ("pages_",), "cells": ("pages_",), "words": ("blocks",), "pairs": ("lines",), "issues": ("blocks",)}
CTE = {
    "lines": """
  SELECT doc_id, lang, source, i - 1 AS pos, t AS source_text
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(t, '\\S')""",
    "blocks": f"""
  SELECT doc_id, lang, source, pos, CAST(pos // 40 AS INT) AS page_index, printf('p%04d-b%04d', pos // 40 + 1, pos + 1) AS id, source_text,
         72.0::DOUBLE AS x0, 72.0::DOUBLE + 14 * (pos % 40) AS top, 72.0::DOUBLE + 6 * least(length(source_text), 70) AS x1, 84.0::DOUBLE + 14 * (pos % 40) AS bottom,
         CAST(8 + (pos * 3 + doc_id) % 9 AS DOUBLE) AS font_size, {_FONTS}[1 + (doc_id + pos) % 4] AS font_name, {_KINDS}[1 + (doc_id + 2 * pos) % 7] AS source_type,
         CASE WHEN (doc_id + pos) % 11 = 0 THEN 'held back' END AS preserve_reason, CASE WHEN (doc_id + pos) % 13 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS fragment_confidence,
         0.3::DOUBLE + 0.1::DOUBLE * ((doc_id + pos) % 8) AS geometry_fill_ratio, pos AS reading_order, pos AS ord, 612.0::DOUBLE AS page_width, 792.0::DOUBLE AS page_height,
         CASE WHEN pos % 5 = 0 THEN 'table' WHEN pos % 5 = 1 THEN 'chart' ELSE 'body' END AS region_type
  FROM lines""",
    "parsed": f"""
  SELECT doc_id, o AS ord, CAST(o // 8 AS INT) AS page_index, printf('m%04d', o + 1) AS id, source_text, 72.0::DOUBLE + 30 * (doc_id % 7) AS x0,
         72.0::DOUBLE + 70 * (o % 8) + 9 * (doc_id % 7) AS top, 72.0::DOUBLE + 30 * (doc_id % 7) + 6 * least(n, 70) AS x1, 132.0::DOUBLE + 70 * (o % 8) + 9 * (doc_id % 7) AS bottom,
         'mineru' AS source_type, {_TYPES}[1 + o % 5] AS kind, CASE WHEN o % 5 = 4 THEN 'table' WHEN o % 5 = 3 THEN 'chart' ELSE 'caption' END AS region_type, NULL::VARCHAR AS preserve_reason
  FROM (SELECT doc_id, pos // 5 AS o, string_agg(source_text, chr(10) ORDER BY pos) AS source_text, max(length(source_text)) AS n FROM lines GROUP BY ALL)""",
    "pages_": "SELECT DISTINCT doc_id, page_index FROM blocks",
    "regions": """
  SELECT doc_id, page_index, ord, printf('p%04d-i%04d', page_index + 1, ord + 1) AS id, 60.0::DOUBLE + 10 * (doc_id % 5) AS x0, 60.0::DOUBLE + 280 * ord AS top,
         300.0::DOUBLE + 50 * (doc_id % 5) AS x1, 180.0::DOUBLE + 280 * ord + 30 * (doc_id % 5) AS bottom
  FROM (SELECT *, unnest([0, 1]) AS ord FROM pages_)""",
    "edges": """
  SELECT doc_id, page_index, 60.0::DOUBLE + 120 * c AS x0, 66.0::DOUBLE + 84 * r AS top,
         CASE WHEN k = 0 THEN 60.0::DOUBLE + 120 * c + 120 * s ELSE 60.5::DOUBLE + 120 * c END AS x1, CASE WHEN k = 0 THEN 66.5::DOUBLE + 84 * r ELSE 66.0::DOUBLE + 84 * r + 84 * s END AS bottom,
         CASE WHEN k = 0 THEN 'h' ELSE 'v' END AS drawn, CAST((r + c) % 3 AS INT) AS paint
  FROM (SELECT *, unnest([0, 1]) AS k, CASE WHEN (r + c + doc_id) % 6 = 5 THEN 0.4::DOUBLE ELSE 1.0 END AS s
        FROM (SELECT *, unnest(range(0, 2 + doc_id % 4)) AS c FROM (SELECT *, unnest(range(0, 2 + doc_id % 5)) AS r FROM pages_)))""",
    "cells": """
  SELECT doc_id, page_index, CAST(r * 10 + c AS INT) AS ord, printf('c%d-%d', r, c) AS id, 60.25::DOUBLE + 120 * c AS x0, 66.25::DOUBLE + 84 * r AS top, 180.25::DOUBLE + 120 * c AS x1, 150.25::DOUBLE + 84 * r AS bottom
  FROM (SELECT *, unnest(range(0, 2 + doc_id % 4)) AS c FROM (SELECT *, unnest(range(0, 2 + doc_id % 5)) AS r FROM pages_))""",
    "words": """
  SELECT doc_id, page_index, pos, block_id, k, word, printf('%s-w%06d', block_id, k) AS id, 72.0::DOUBLE + 42 * k AS x0, t + CASE WHEN k % 5 = 4 THEN 6.0::DOUBLE ELSE 0.0 END AS top,
         102.0::DOUBLE + 42 * k + length(word) % 12 AS x1, t + CASE WHEN k % 5 = 4 THEN 6.0::DOUBLE ELSE 0.0 END + 10.0::DOUBLE + CASE WHEN k % 7 = 6 THEN 5.0::DOUBLE ELSE 0.0 END AS bottom
  FROM (SELECT doc_id, page_index, pos, id AS block_id, top AS t, unnest(regexp_extract_all(source_text, '[^ ]+')) AS word, generate_subscripts(regexp_extract_all(source_text, '[^ ]+'), 1) - 1 AS k FROM blocks)""",
    "pairs": """
  SELECT doc_id, pos, t AS source_text, CASE doc_id % 3 WHEN 0 THEN replace(o, 'the ', 'the  ') WHEN 1 THEN '~' || o ELSE o END AS target_text, doc_id * 100000 + pos AS ord
  FROM (SELECT *, trim(source_text) AS t, translate(trim(source_text), '7', '8') AS o FROM lines)""",
    "jobs": """
  SELECT o_orderkey AS job_id, 'File ' || o_orderpriority || ' ' || o_custkey || '.pdf' AS file_name,
         CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'needs_review' ELSE 'completed' END
              WHEN 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' ELSE 'translating' END ELSE 'cancelled' END AS status,
         CAST(o_orderkey % 130 AS INT) AS progress, ['v3', 'v2', 'legacy'][1 + o_orderkey % 3] AS pipeline_version, o_orderdate AS created_at,
         CASE o_orderkey % 5 WHEN 0 THEN 'old failure' WHEN 1 THEN 'no answer' END AS error_message, 'in/' || (o_orderkey % 1000) AS source_path, o_orderkey % 10 <> 3 AS has_file
  FROM orders""",
    "logs": "SELECT user_id AS job_id, event_id AS id, ts AS created_at, event_type AS stage, value, props FROM events",
    "issues": """
  SELECT doc_id, doc_id * 100000 + pos AS id, CASE WHEN toxic = 1 THEN 'error' ELSE 'warning' END AS severity, 'c-' || substr(source, 4, 1) AS code, 'found in ' || source AS message, page_index, blocks.id AS block_id
  FROM blocks JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0""",
}

#: SQL for the shared area of two boxes over the smaller, each under a prefix.
def overlap_sql(a: str, b: str) -> str:
    area = lambda p: f"greatest(0.1::DOUBLE, greatest(0.0::DOUBLE, {p}.x1 - {p}.x0) * greatest(0.0::DOUBLE, {p}.bottom - {p}.top))"
    return f"(greatest(0.0::DOUBLE, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0::DOUBLE, least({a}.bottom, {b}.bottom) - greatest({a}.top, {b}.top)) / least({area(a)}, {area(b)}))"
