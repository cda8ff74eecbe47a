"""Queries over blocks and their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import geometry as g
from foliograph.functions.geometry import Box
from foliograph.functions.text import compact, scripts
from foliograph.operators import blocks as b
from foliograph.operators import documents, grouping, quality, spatial
from foliograph.plans import bind
from foliograph.plans.bind import overlap_sql, query, table

W, H = 612.0, 792.0


@query("SELECT doc_id, id, page_index, reading_order, source_text, x0, top, x1, bottom FROM blocks", "blocks")
def blocks_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.blocks(spark, sf_dir).select("doc_id", "id", "page_index", "reading_order", "source_text", "x0", "top", "x1", "bottom")


@query("""
, ordered AS (SELECT doc_id, page_index, id, length(source_text) AS n, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY reading_order, top, x0, id) AS r FROM blocks),
fold AS (
  SELECT doc_id, page_index, id, r, n AS chars, 1 AS cnt, 0 AS batch FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.doc_id, o.page_index, o.id, o.r,
         CASE WHEN f.chars + o.n > 2400 OR f.cnt >= 24 THEN o.n ELSE f.chars + o.n END, CASE WHEN f.chars + o.n > 2400 OR f.cnt >= 24 THEN 1 ELSE f.cnt + 1 END,
         f.batch + CASE WHEN f.chars + o.n > 2400 OR f.cnt >= 24 THEN 1 ELSE 0 END
  FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.page_index = f.page_index AND o.r = f.r + 1)
SELECT doc_id, page_index, id, batch FROM fold""", "blocks")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.greedy_batches(bind.blocks(spark, sf_dir))


@query("""
SELECT doc_id, id, preserve_reason IS NULL AND fragment_confidence >= 0.55 AS translatable,
       CASE WHEN pos % 9 = 0 THEN 'table' WHEN top <= 792 * 0.06::DOUBLE THEN 'header' WHEN bottom >= 792 * 0.94::DOUBLE THEN 'footer' WHEN source_type = 'native-recovered' THEN 'chart'
            WHEN font_size >= 14 OR (length(source_text) <= 80 AND abs((x0 + x1) / 2 - 306) <= 612 * 0.08::DOUBLE) THEN 'heading' ELSE 'body' END AS region,
       CASE WHEN bottom - top > 2.5::DOUBLE * (x1 - x0) AND length(regexp_replace(source_text, '\\s+', '', 'g')) >= 2 THEN 90 ELSE 0 END AS turn,
       CASE WHEN (font_size >= 14 OR length(source_text) <= 40) AND abs((x0 + x1) / 2 - 306) <= 0.08::DOUBLE * 612 THEN 'center' ELSE 'left' END AS align,
       CASE WHEN regexp_matches(font_name, '(?i)bold|black|heavy') THEN 700 ELSE 400 END AS weight
FROM blocks""", "blocks")
def block_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, box, t = bind.blocks(spark, sf_dir), Box.flat(), F.col("source_text")
    page = Box(F.lit(0.0), F.lit(0.0), F.lit(W), F.lit(H))
    return df.select(
        "doc_id", "id", b.translatable(F.col("preserve_reason"), F.col("fragment_confidence")).alias("translatable"),
        b.region_type(box, t, F.col("font_size"), F.lit(W), F.lit(H), F.col("pos") % 9 == 0, F.col("source_type")).alias("region"),
        b.rotation(box, t).alias("turn"), b.alignment(box, page, t, F.col("font_size")).alias("align"), b.font_weight(F.col("font_name")).alias("weight"),
    )


@query("""
SELECT id, doc_id, CASE WHEN contains(lower(kind), 'table') THEN 'table' WHEN regexp_matches(lower(kind), 'image|figure|chart') THEN 'chart' WHEN contains(lower(kind), 'caption') THEN 'caption'
       WHEN regexp_matches(lower(kind), 'title|header') THEN 'heading' WHEN contains(lower(kind), 'footer') THEN 'footer' ELSE 'body' END AS region FROM parsed""", "parsed")
def parsed_region_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.parsed(spark, sf_dir).select("id", "doc_id", b.parsed_region_type(F.col("kind")).alias("region"))


@query("""
, f AS (
  SELECT doc_id, id, regexp_replace(word, '\\s+', '', 'g') AS t, greatest(0.1::DOUBLE, x1 - x0) AS w, greatest(0.1::DOUBLE, bottom - top) AS h, 8.0::DOUBLE + k % 9 AS size, CASE WHEN k % 7 = 0 THEN 90 ELSE 0 END AS turn,
         len(list_filter(regexp_split_to_array(word, '[^\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Za-z]$'))) AS single
  FROM words)
SELECT doc_id, id, CASE WHEN turn <> 0 AND h > size * 1.7::DOUBLE AND w < size * 3.5::DOUBLE THEN 0.3::DOUBLE WHEN single >= 4 THEN 0.4 WHEN length(t) = 1 AND regexp_matches(t, '^\\p{L}+$') THEN 0.45
       WHEN regexp_matches(t, '^[A-Za-z]{1,2}$') AND w <= size * 1.6::DOUBLE THEN 0.5 ELSE 1.0 END AS confidence FROM f""", "words")
def fragment_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    turn = F.when(k % 7 == 0, 90).otherwise(0)
    return bind.words(spark, sf_dir).select("doc_id", "id", b.stability(Box.flat(), F.col("word"), 8.0 + k % 9, turn, F.lit(1))["confidence"].alias("confidence"))


@query("""
SELECT doc_id, id, CASE WHEN source_type = 'image-table' THEN 4.5::DOUBLE WHEN region_type = 'table' THEN 6.5 WHEN region_type = 'chart' THEN 6.0 ELSE 7.0 END AS least,
       CAST(greatest(4, greatest(1, floor(greatest(1.0::DOUBLE, x1 - x0) / f)) * greatest(1, floor(greatest(1.0::DOUBLE, bottom - top) / (f * 1.12::DOUBLE)))) AS BIGINT) AS capacity
FROM (SELECT *, CASE WHEN region_type = 'table' THEN 6.5::DOUBLE WHEN region_type = 'chart' THEN 6.0 ELSE 7.0 END AS f FROM blocks)""", "blocks")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bind.blocks(spark, sf_dir)
    return df.select("doc_id", "id", b.least_font(F.col("source_type"), F.col("region_type")).alias("least"), b.capacity(Box.flat(), F.col("region_type")).alias("capacity"))


@query("""
, r AS (SELECT doc_id, id, x0 - 1 AS a0, greatest(top - 6, top - 0.5::DOUBLE) AS a1, x1 + 5 AS a2, bottom + 4 AS a3, x0, top, x1, bottom, pos % 3 = 0 AS c FROM blocks),
w AS (SELECT doc_id, id, CASE WHEN c THEN a0 ELSE x0 END AS x0, CASE WHEN c THEN a1 ELSE top END AS top, CASE WHEN c THEN a2 ELSE x1 END AS x1, CASE WHEN c THEN a3 ELSE bottom END AS bottom, CASE WHEN c THEN 0.25::DOUBLE ELSE 0.0 END AS dy FROM r)
SELECT doc_id, id, CASE WHEN x1 - x0 > 3 THEN x0 + 1.5::DOUBLE ELSE x0 END AS r_x0, CASE WHEN bottom - top > 2 * dy THEN top + dy ELSE top END AS r_top,
       CASE WHEN x1 - x0 > 3 THEN x1 - 1.5::DOUBLE ELSE x1 END AS r_x1, CASE WHEN bottom - top > 2 * dy THEN bottom - dy ELSE bottom END AS r_bottom FROM w""", "blocks")
def render_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = Box(F.col("x0") - 1, F.col("top") - 6, F.col("x1") + 5, F.col("bottom") + 4)
    return bind.blocks(spark, sf_dir).select("doc_id", "id", *b.render_box(Box.flat(), cell, F.col("pos") % 3 == 0).named("r_"))


@query("""
, step AS (SELECT doc_id, page_index, id, top, x0, x1, bottom, lag(top) OVER w AS pt, lag(x1) OVER w AS px, lag(bottom) OVER w AS pb FROM words WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY top, x0, id)),
new AS (SELECT *, CASE WHEN greatest(bottom - top, pb - pt) / greatest(0.1::DOUBLE, least(bottom - top, pb - pt)) <= 1.35::DOUBLE AND abs(top - pt) <= 0.4::DOUBLE * least(bottom - top, pb - pt)
          AND x0 - px >= -1 AND x0 - px <= greatest(4.0::DOUBLE, 1.5::DOUBLE * least(bottom - top, pb - pt)) AND pt IS NOT NULL THEN 0 ELSE 1 END AS n FROM step)
SELECT doc_id, page_index, id, CAST(sum(n) OVER (PARTITION BY doc_id, page_index ORDER BY top, x0, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM new""", "words")
def visual_line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.visual_lines(bind.words(spark, sf_dir)).select("doc_id", "page_index", "id", "line")


@query("""
, u AS (SELECT doc_id, page_index, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, sum(greatest(0, x1 - x0) * greatest(0, bottom - top)) AS area, count(*) AS boxes, median(font_size) AS size FROM blocks GROUP BY ALL),
c AS (SELECT doc_id, page_index, font_name, count(*) AS n, min(ord) AS o FROM blocks GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n DESC, o) AS r FROM c),
ct AS (SELECT doc_id, page_index, (doc_id + pos) % 4 // 3 * 90 AS rotation, count(*) AS n, min(ord) AS o FROM blocks GROUP BY ALL), mt AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n DESC, o) AS r FROM ct)
SELECT u.doc_id, u.page_index, x0, top, x1, bottom, boxes, round_even(least(1.0::DOUBLE, area / greatest(0.1::DOUBLE, (x1 - x0) * (bottom - top))), 6) AS fill, greatest(5.0::DOUBLE, least(36.0::DOUBLE, size)) AS font_size, font_name, CAST(rotation AS INT) AS rotation
FROM u JOIN m ON m.doc_id = u.doc_id AND m.page_index = u.page_index AND m.r = 1 JOIN mt ON mt.doc_id = u.doc_id AND mt.page_index = u.page_index AND mt.r = 1""", "blocks")
def grouped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = bind.blocks(spark, sf_dir).withColumn("rotation", F.when((F.col("doc_id") + F.col("pos")) % 4 == 3, 90).otherwise(0))
    return grouping.group_boxes(turned, ["doc_id", "page_index"]).select("doc_id", "page_index", "x0", "top", "x1", "bottom", "boxes", F.bround("geometry_fill_ratio", 6).alias("fill"), "font_size", "font_name", "rotation")


@query(f"""
, o AS (SELECT b.doc_id, b.id, p.region_type, row_number() OVER (PARTITION BY b.doc_id, b.id ORDER BY {overlap_sql('b', 'p')} DESC, p.ord) AS r
  FROM blocks b JOIN parsed p ON p.doc_id = b.doc_id AND p.page_index = b.page_index AND {overlap_sql('b', 'p')} >= 0.25)
SELECT b.doc_id, b.id, coalesce(o.region_type, b.region_type) AS region_type FROM blocks b LEFT JOIN o ON o.doc_id = b.doc_id AND o.id = b.id AND o.r = 1""", "blocks", "parsed")
def fusion_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.relabel(bind.blocks(spark, sf_dir), bind.parsed(spark, sf_dir)).select("doc_id", "id", "region_type")


@query(f"""
, trusted AS (SELECT doc_id, page_index FROM blocks WHERE source_type LIKE 'native%' GROUP BY ALL HAVING count(*) >= 3 AND sum(length(regexp_replace(source_text, '\\s+', '', 'g'))) >= 12)
SELECT p.doc_id, p.page_index, p.id FROM parsed p
WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = p.doc_id AND b.page_index = p.page_index AND {overlap_sql('b', 'p')} >= 0.4) AND (p.doc_id, p.page_index) NOT IN (SELECT (doc_id, page_index) FROM trusted)""", "blocks", "parsed")
def fusion_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.append_unseen(bind.blocks(spark, sf_dir), bind.parsed(spark, sf_dir)).select("doc_id", "page_index", "id")


@query("SELECT doc_id, page_index, count(*) AS native_blocks, CAST(sum(length(regexp_replace(source_text, '\\s+', '', 'g'))) AS BIGINT) AS native_characters FROM blocks WHERE source_type LIKE 'native%' GROUP BY ALL HAVING count(*) >= 3 AND sum(length(regexp_replace(source_text, '\\s+', '', 'g'))) >= 12", "blocks")
def authoritative_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.authoritative_pages(bind.blocks(spark, sf_dir))


_COARSE = f"""b.source_type = 'mineru' AND b.region_type = 'table' AND (length(regexp_replace(b.source_text, '\\s+', '', 'g')) >= 80 OR length(b.source_text) - length(replace(b.source_text, chr(10), '')) >= 3)
  AND {overlap_sql('b', 'r')} >= 0.8 AND (b.x1 - b.x0) * (b.bottom - b.top) / greatest(0.1::DOUBLE, (r.x1 - r.x0) * (r.bottom - r.top)) >= 0.18"""


@query(f"""
SELECT b.doc_id, b.id, CASE WHEN EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = b.doc_id AND r.page_index = b.page_index AND {_COARSE}) THEN 'the table could not be taken apart' END AS preserve_reason FROM parsed b""", "regions", "parsed")
def coarse_image_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mark_coarse_tables(bind.parsed(spark, sf_dir), bind.regions(spark, sf_dir)).select("doc_id", "id", "preserve_reason")


@query(f"""
SELECT r.doc_id, r.page_index, r.id, CASE WHEN EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = r.doc_id AND b.page_index = r.page_index AND b.source_type = 'image-table' AND {overlap_sql('b', 'r')} >= 0.8) THEN 'dropped'
   WHEN EXISTS (SELECT 1 FROM parsed b WHERE b.doc_id = r.doc_id AND b.page_index = r.page_index AND b.ord % 2 = 0 AND {_COARSE}) THEN 'preserved' ELSE 'safe' END AS route FROM regions r""", "regions", "parsed")
def region_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = bind.parsed(spark, sf_dir).withColumn("preserve_reason", F.when(F.col("ord") % 2 == 0, "coarse"))
    every = bind.blocks(spark, sf_dir).where("source_type = 'image-table'").unionByName(held, allowMissingColumns=True)
    return spatial.route_regions(bind.regions(spark, sf_dir), every).select("doc_id", "page_index", "id", "route")


@query(f"""
, o AS (SELECT p.doc_id, p.id, r.id AS region_id, row_number() OVER (PARTITION BY p.doc_id, p.id ORDER BY (r.x1 - r.x0) * (r.bottom - r.top), r.ord) AS n FROM parsed p JOIN regions r ON r.doc_id = p.doc_id AND r.page_index = p.page_index AND {overlap_sql('p', 'r')} >= 0.8)
SELECT p.doc_id, p.id, o.region_id FROM parsed p LEFT JOIN o ON o.doc_id = p.doc_id AND o.id = p.id AND n = 1""", "regions", "parsed")
def matching_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bind.regions(spark, sf_dir).withColumn("region_id", F.col("id"))
    return spatial.smallest_overlapping(bind.parsed(spark, sf_dir), r, 0.8, ["region_id"]).select("doc_id", "id", F.col("found.region_id").alias("region_id"))


@query("""
, o AS (SELECT b.doc_id, b.id, c.id AS cell_id, row_number() OVER (PARTITION BY b.doc_id, b.id ORDER BY (c.x1 - c.x0) * (c.bottom - c.top), c.ord) AS n FROM blocks b JOIN cells c ON c.doc_id = b.doc_id AND c.page_index = b.page_index
   AND (b.x0 + b.x1) / 2 BETWEEN c.x0 AND c.x1 AND (b.top + b.bottom) / 2 BETWEEN c.top AND c.bottom)
SELECT b.doc_id, b.id, o.cell_id FROM blocks b LEFT JOIN o ON o.doc_id = b.doc_id AND o.id = b.id AND n = 1""", "blocks", "cells")
def containing_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bind.cells(spark, sf_dir).withColumn("cell_id", F.col("id"))
    return spatial.containing(bind.blocks(spark, sf_dir), c, ["cell_id"]).select("doc_id", "id", F.col("found.cell_id").alias("cell_id"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each word and its first letter, as characters."""
    w = bind.words(spark, sf_dir)
    return w.select("doc_id", "page_index", "id", "k", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"), F.substring("word", 1, 1).alias("char"))


_POINTS = "points AS (SELECT doc_id, page_index, id, k, (x0 + x1) / 2 AS x, (top + bottom) / 2 AS y, substr(word, 1, 1) AS char FROM words)"
_HELD = "r.doc_id = p.doc_id AND r.page_index = p.page_index AND p.x BETWEEN r.x0 AND r.x1 AND p.y BETWEEN r.top AND r.bottom"


@query(f", {_POINTS} SELECT r.doc_id, r.page_index, r.id AS region_id, count(*) AS characters FROM points p JOIN regions r ON {_HELD.replace('r.x0', 'r.x0 - 0.5').replace('r.x1', 'r.x1 + 0.5').replace('r.top', 'r.top - 0.5').replace('r.bottom', 'r.bottom + 0.5')} GROUP BY ALL", "words", "regions")
def characters_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = spatial.points_inside(_points(spark, sf_dir).select("doc_id", "page_index", "x", "y"), bind.regions(spark, sf_dir), slack=0.5)
    return hit.groupBy("doc_id", "page_index", F.col("r_id").alias("region_id")).agg(F.count("*").alias("characters"))


@query(f"""
, {_POINTS}, letters AS (SELECT * FROM points WHERE regexp_matches(char, '\\p{{L}}'))
SELECT doc_id, count(*) AS total, count(*) FILTER (hit) AS covered, round_even(least(1.0::DOUBLE, count(*) FILTER (hit)::DOUBLE / count(*)), 6) AS coverage
FROM (SELECT p.doc_id, EXISTS (SELECT 1 FROM regions r WHERE {_HELD}) AS hit FROM letters p) GROUP BY doc_id""", "words", "regions")
def native_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = bind.regions(spark, sf_dir).select("doc_id", "page_index", *Box._fields)
    return documents.native_coverage(_points(spark, sf_dir), boxes).select("doc_id", "total", "covered", F.bround("coverage", 6).alias("coverage"))


@query(f"""
, {_POINTS}, free AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM regions r WHERE {_HELD}) AS open FROM points p)
SELECT doc_id, page_index, k % 50 AS word, count(*) AS characters, count(*) FILTER (open) AS uncovered FROM free GROUP BY ALL
HAVING count(*) FILTER (open) >= 0.5 * count(*) AND count(*) FILTER (open) > 0 AND bool_or(regexp_matches(char, '\\p{{L}}'))""", "words", "regions")
def uncovered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mostly_uncovered(_points(spark, sf_dir).withColumn("word", F.col("k") % 50), bind.regions(spark, sf_dir), ["word"])


@query("""
, e AS (SELECT *, abs(x1 - x0) AS w, abs(bottom - top) AS h, (x0 + x1) / 2 AS cx, (top + bottom) / 2 AS cy FROM edges),
k AS (SELECT *, CASE WHEN h >= greatest(5.0::DOUBLE, 3 * w) THEN 'v' WHEN w >= greatest(5.0::DOUBLE, 3 * h) THEN 'h' END AS kind FROM e),
s AS (SELECT t.doc_id, t.page_index, t.id, t.x0, t.top, t.x1, t.bottom,
    max(cx) FILTER (kind = 'v' AND (t.top + t.bottom) / 2 BETWEEN k.top - 2 AND k.bottom + 2 AND cx <= t.x0 + 2) AS a0, max(cy) FILTER (kind = 'h' AND (t.x0 + t.x1) / 2 BETWEEN k.x0 - 2 AND k.x1 + 2 AND cy <= t.top + 2) AS a1,
    min(cx) FILTER (kind = 'v' AND (t.top + t.bottom) / 2 BETWEEN k.top - 2 AND k.bottom + 2 AND cx >= t.x1 - 2) AS a2, min(cy) FILTER (kind = 'h' AND (t.x0 + t.x1) / 2 BETWEEN k.x0 - 2 AND k.x1 + 2 AND cy >= t.bottom - 2) AS a3
  FROM blocks t JOIN k ON k.doc_id = t.doc_id AND k.page_index = t.page_index GROUP BY ALL)
SELECT doc_id, page_index, id, CASE WHEN ok THEN a0 END AS c_x0, CASE WHEN ok THEN a1 END AS c_top, CASE WHEN ok THEN a2 END AS c_x1, CASE WHEN ok THEN a3 END AS c_bottom
FROM (SELECT *, a2 - a0 >= greatest(3.0::DOUBLE, x1 - x0 - 4) AND a3 - a1 >= greatest(3.0::DOUBLE, bottom - top - 4) AS ok FROM s)""", "blocks", "edges")
def inferred_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.infer_cells(bind.blocks(spark, sf_dir), bind.edges(spark, sf_dir))
    return found.select("doc_id", "page_index", "id", *Box.of("cell").named("c_"))


@query("""
, e AS (SELECT *, abs(x1 - x0) AS w, abs(bottom - top) AS h FROM edges), k AS (SELECT *, CASE WHEN w >= greatest(3.0::DOUBLE, 3 * h) THEN 'h' WHEN h >= greatest(3.0::DOUBLE, 3 * w) THEN 'v' END AS kind FROM e),
s AS (SELECT c.doc_id, c.page_index, c.id,
    bool_or(kind = 'h' AND abs((k.top + k.bottom) / 2 - c.top) <= 1.2::DOUBLE AND least(c.x1, k.x1) - greatest(c.x0, k.x0) >= greatest(1.0::DOUBLE, c.x1 - c.x0) * 0.65::DOUBLE) AS t, bool_or(kind = 'h' AND abs((k.top + k.bottom) / 2 - c.bottom) <= 1.2::DOUBLE AND least(c.x1, k.x1) - greatest(c.x0, k.x0) >= greatest(1.0::DOUBLE, c.x1 - c.x0) * 0.65::DOUBLE) AS b,
    bool_or(kind = 'v' AND abs((k.x0 + k.x1) / 2 - c.x0) <= 1.2::DOUBLE AND least(c.bottom, k.bottom) - greatest(c.top, k.top) >= greatest(1.0::DOUBLE, c.bottom - c.top) * 0.65::DOUBLE) AS l, bool_or(kind = 'v' AND abs((k.x0 + k.x1) / 2 - c.x1) <= 1.2::DOUBLE AND least(c.bottom, k.bottom) - greatest(c.top, k.top) >= greatest(1.0::DOUBLE, c.bottom - c.top) * 0.65::DOUBLE) AS r
  FROM cells c JOIN k ON k.doc_id = c.doc_id AND k.page_index = c.page_index GROUP BY ALL)
SELECT doc_id, page_index, id, coalesce(t AND b AND l AND r, false) AS supported FROM s""", "cells", "edges")
def supported_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.supported_cells(bind.cells(spark, sf_dir), bind.edges(spark, sf_dir)).select("doc_id", "page_index", "id", "supported")


@query("""
, k AS (SELECT doc_id, page_index, CASE WHEN abs(bottom - top) >= greatest(5.0::DOUBLE, 3 * abs(x1 - x0)) THEN 'v' WHEN abs(x1 - x0) >= greatest(5.0::DOUBLE, 3 * abs(bottom - top)) THEN 'h' END AS kind, x0, x1, top, bottom FROM edges),
n AS (SELECT doc_id, page_index, kind, round_even(CASE WHEN kind = 'v' THEN (x0 + x1) / 2 ELSE (top + bottom) / 2 END, 0) AS at_, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL)
SELECT doc_id, page_index, count(*) FILTER (kind = 'v' AND n >= 3) AS vertical, count(*) FILTER (kind = 'h' AND n >= 3) AS horizontal, count(*) FILTER (kind = 'v' AND n >= 3) >= 3 AND count(*) FILTER (kind = 'h' AND n >= 3) >= 3 AS credible FROM n GROUP BY ALL""", "edges")
def grid_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.credible_grids(bind.edges(spark, sf_dir))


@query("""
SELECT doc_id, page_index, count(*) AS cells, (SELECT count(DISTINCT round_even(v, 1)) FROM (SELECT unnest(list(x0) || list(x1)) AS v)) AS xs, (SELECT count(DISTINCT round_even(v, 1)) FROM (SELECT unnest(list(top) || list(bottom)) AS v)) AS ys,
       count(*) >= 4 AND (SELECT count(DISTINCT round_even(v, 1)) FROM (SELECT unnest(list(x0) || list(x1)) AS v)) >= 3 AND (SELECT count(DISTINCT round_even(v, 1)) FROM (SELECT unnest(list(top) || list(bottom)) AS v)) >= 3 AS credible
FROM cells GROUP BY doc_id, page_index""", "cells")
def table_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.credible_tables(bind.cells(spark, sf_dir), ["doc_id", "page_index"])


@query("SELECT doc_id, page_index, round_even(x0, 3) AS x0, round_even(top, 3) AS top, round_even(x1, 3) AS x1, round_even(bottom, 3) AS bottom, min(ord) AS ord FROM (SELECT * FROM cells UNION ALL SELECT doc_id, page_index, ord + 1000, id, x0 + 0.0001::DOUBLE, top, x1, bottom FROM cells) GROUP BY ALL", "cells")
def distinct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bind.cells(spark, sf_dir)
    near = c.withColumns({"ord": F.col("ord") + 1000, "x0": F.col("x0") + 0.0001})
    return spatial.distinct_cells(c.unionByName(near))


@query("SELECT doc_id, page_index, count(*) FILTER (abs(x1 - x0) >= 3 * abs(bottom - top)) AS horizontal, count(*) FILTER (abs(bottom - top) >= 3 * abs(x1 - x0)) AS vertical, count(*) FILTER (abs(x1 - x0) >= 3 * abs(bottom - top)) >= 2 AND count(*) FILTER (abs(bottom - top) >= 3 * abs(x1 - x0)) >= 2 AS enough FROM edges GROUP BY ALL", "edges")
def edge_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.orientation_counts(bind.edges(spark, sf_dir))


@query("""
SELECT doc_id, page_index, drawn, paint, count(*) AS edges_, count(*) FILTER (CASE paint WHEN 0 THEN (doc_id % 20) / 19.0::DOUBLE < 0.95::DOUBLE WHEN 1 THEN greatest(0.1::DOUBLE, (doc_id % 9) / 10.0::DOUBLE) <= 0.3::DOUBLE ELSE true END) AS visible FROM edges GROUP BY ALL""", "edges")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    line, fill = F.array((d % 20) / 19.0), F.array(F.lit(0.1), (d % 9) / 10.0, F.lit(0.0))
    seen = g.visible_edge(F.col("paint") == 0, F.col("paint") == 1, line, fill)
    return bind.edges(spark, sf_dir).groupBy("doc_id", "page_index", "drawn", "paint").agg(F.count("*").alias("edges_"), F.count_if(seen).alias("visible"))


@query(f"SELECT doc_id, id FROM blocks b WHERE source_type = 'vision' AND EXISTS (SELECT 1 FROM (SELECT doc_id, page_index, x0, top - 4 AS top, x1, bottom + 4 AS bottom FROM blocks WHERE source_type <> 'vision') r WHERE r.doc_id = b.doc_id AND r.page_index = b.page_index AND {overlap_sql('b', 'r')} >= 0.15)", "blocks")
def duplicate_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bind.blocks(spark, sf_dir)
    own = wide.withColumns({"top": F.when(F.col("source_type") == "vision", F.col("top")).otherwise(F.col("top") - 4), "bottom": F.when(F.col("source_type") == "vision", F.col("bottom")).otherwise(F.col("bottom") + 4)})
    return quality.duplicate_overlays(own).select("doc_id", F.col("block_id").alias("id"))


@query(f"""
, o AS (SELECT r.doc_id, r.page_index, r.id, b.id AS block_id, row_number() OVER (PARTITION BY r.doc_id, r.page_index, r.id ORDER BY {overlap_sql('r', 'b')} DESC, b.ord) AS n FROM regions r JOIN blocks b ON b.doc_id = r.doc_id AND b.page_index = r.page_index AND {overlap_sql('r', 'b')} >= 0.15)
SELECT r.doc_id, r.page_index, r.id, o.block_id FROM regions r LEFT JOIN o ON o.doc_id = r.doc_id AND o.page_index = r.page_index AND o.id = r.id AND n = 1""", "blocks", "regions")
def residual_best_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.residual_targets(bind.regions(spark, sf_dir), bind.blocks(spark, sf_dir)).select("doc_id", "page_index", "id", "block_id")


@query("""
, s AS (SELECT doc_id, CAST(sum(length(regexp_replace(source_text, '\\s+', '', 'g'))) AS BIGINT) AS characters, count(*) AS blocks, count(*) FILTER (preserve_reason IS NOT NULL OR fragment_confidence < 0.55) AS unsafe_blocks, count(*) FILTER (region_type = 'table') AS table_blocks, count(*) FILTER (source_type = 'image-table') AS image_table_blocks FROM blocks GROUP BY doc_id)
SELECT *, characters >= 8 AND doc_id % 3 <> 0 AS usable, NOT (characters >= 8 AND doc_id % 3 <> 0) OR unsafe_blocks > 0 OR table_blocks >= 4 OR doc_id % 5 = 0 AS needed,
       CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN NOT (characters >= 8 AND doc_id % 3 <> 0) ELSE NOT (characters >= 8 AND doc_id % 3 <> 0) OR unsafe_blocks > 0 OR table_blocks >= 4 OR doc_id % 5 = 0 END AS parse FROM s""", "blocks")
def document_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents.document_stats(bind.blocks(spark, sf_dir)).drop("native_blocks")
    usable = documents.usable_native(F.lit("native"), F.col("characters"), F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(1.0))
    s = s.withColumn("usable", usable).withColumn("needed", documents.structural_analysis_needed(F.col("usable"), F.col("unsafe_blocks"), F.col("table_blocks"), F.col("doc_id") % 5 == 0))
    strategy = bind.pick(["structure-first", "native-first", "smart", "smart"], F.col("doc_id") % 4)
    return s.withColumn("parse", documents.parser_route(strategy, F.col("usable"), F.col("needed")))


@query("""
, n AS (SELECT doc_id, length(regexp_replace(source_text, '\\s+', '', 'g')) AS n, length(source_text) - length(replace(source_text, chr(10), '')) AS nl, (x1 - x0) * (bottom - top) / (612.0::DOUBLE * 792) AS share, ((doc_id + ord) % 8) / 10.0::DOUBLE AS fill, max(page_index) OVER (PARTITION BY doc_id) + 1 AS pages FROM parsed),
s AS (SELECT doc_id, count(*) AS blocks, avg(n) AS average, count(*) FILTER (n > 260) AS oversized, count(*) FILTER (nl >= 2 AND n > 160) AS multiline, count(*) FILTER (share >= 0.05 AND fill < 0.35) AS unsafe, max(pages) AS pages FROM n GROUP BY doc_id)
SELECT doc_id, blocks, round_even(average, 6) AS average, oversized, multiline, unsafe, CASE WHEN doc_id % 9 = 0 THEN 0.5 ELSE 0.9 END < 0.8 OR NOT ((average > 220 AND blocks < 20 * pages) OR oversized / blocks >= 0.2 OR multiline / blocks >= 0.1 OR unsafe > 0) AS passed FROM s""", "parsed")
def granularity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = bind.parsed(spark, sf_dir).withColumns({
        "fragment_confidence": F.lit(1.0), "geometry_fill_ratio": ((F.col("doc_id") + F.col("ord")) % 8) / 10.0, "page_width": F.lit(W), "page_height": F.lit(H),
        "pages": F.max("page_index").over(Window.partitionBy("doc_id")) + 1, "coverage": F.when(F.col("doc_id") % 9 == 0, 0.5).otherwise(0.9),
    })
    return documents.granularity(p).select("doc_id", "blocks", F.bround("average", 6).alias("average"), "oversized", "multiline", "unsafe", "passed")


@query("SELECT doc_id, 'native' AS origin, count(*) AS blocks FROM blocks WHERE doc_id % 3 <> 0 GROUP BY doc_id UNION ALL SELECT doc_id, 'parsed', count(*) FROM parsed WHERE doc_id % 3 = 0 GROUP BY doc_id", "blocks", "parsed")
def layout_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    native, parsed = bind.blocks(spark, sf_dir).withColumn("origin", F.lit("native")), bind.parsed(spark, sf_dir).withColumn("origin", F.lit("parsed"))
    flags = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 != 0).alias("usable"))
    return documents.select_layout(native, parsed, flags).groupBy("doc_id", "origin").agg(F.count("*").alias("blocks"))


@query("""
SELECT doc_id, id, regexp_matches(source_text, '[\\x{3040}-\\x{30ff}]') AS kana, regexp_matches(source_text, '[\\x{ac00}-\\x{d7af}]') AS hangul, regexp_matches(source_text, '[\\x{3400}-\\x{9fff}]') AS han, regexp_matches(source_text, '[A-Za-z]') AS latin,
       length(regexp_replace(source_text, '\\s+', '', 'g')) AS n FROM blocks""", "blocks")
def script_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.blocks(spark, sf_dir).select("doc_id", "id", "source_text", scripts(F.col("source_text")).alias("s")).select("doc_id", "id", "s.*", F.length(compact(F.col("source_text"))).cast("long").alias("n"))


FIT_CTES = """
, sized AS (SELECT doc_id, id, page_index, source_text AS t, x0, top, x1, bottom, f AS least, greatest(f, font_size) AS start FROM (SELECT *, CASE WHEN source_type = 'image-table' THEN 4.5::DOUBLE WHEN region_type = 'table' THEN 6.5 WHEN region_type = 'chart' THEN 6.0 ELSE 7.0 END AS f FROM blocks)),
tried AS (SELECT *, unnest(list_transform(range(0, CAST(floor((start - least) * 2) AS BIGINT) + 1), lambda i: start - i * 0.5::DOUBLE)) AS s FROM sized),
fits AS (SELECT doc_id, id, max(s) AS s FROM tried WHERE greatest(1, ceil(length(t) * 0.5::DOUBLE * s / greatest(1.0::DOUBLE, x1 - x0))) * 1.12::DOUBLE * s <= bottom - top + 0.35::DOUBLE * s GROUP BY doc_id, id),
fitted AS (SELECT z.*, coalesce(f.s, z.least) AS font_size, f.s IS NULL AS overflow FROM sized z LEFT JOIN fits f ON f.doc_id = z.doc_id AND f.id = z.id)"""
_FIT = FIT_CTES + " SELECT doc_id, id, font_size, CAST(greatest(1, ceil(length(t) * 0.5::DOUBLE * font_size / greatest(1.0::DOUBLE, x1 - x0))) AS BIGINT) AS lines, overflow, font_size <= least + 0.01 AS at_least FROM fitted"


@query(_FIT, "blocks")
def fit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = b.least_font(F.col("source_type"), F.col("region_type"))
    return bind.blocks(spark, sf_dir).select("doc_id", "id", b.fit(F.col("source_text"), Box.flat(), F.col("font_size"), least).alias("f")).select("doc_id", "id", "f.*")


@query("""
, p AS (SELECT *, CASE WHEN source_type = 'vision' THEN 20.0::DOUBLE WHEN source_type = 'image-table' THEN 0.0 WHEN region_type = 'table' THEN 0.45 ELSE 0.8 END AS ax, CASE WHEN source_type = 'vision' THEN 20.0::DOUBLE WHEN source_type = 'image-table' THEN 0.0 WHEN region_type = 'table' THEN 0.2 ELSE 0.45 END AS ay, source_type = 'vision' AND pos % 2 = 0 AS c FROM blocks),
w AS (SELECT doc_id, id, CASE WHEN c THEN greatest(x0 - ax, 70.0::DOUBLE) ELSE x0 - ax END AS l, CASE WHEN c THEN greatest(top - ay, 90.0::DOUBLE) ELSE top - ay END AS t, CASE WHEN c THEN least(x1 + ax, 400.0::DOUBLE) ELSE x1 + ax END AS r, CASE WHEN c THEN least(bottom + ay, 600.0::DOUBLE) ELSE bottom + ay END AS b FROM p)
SELECT doc_id, id, round_even(l, 6) AS "left", round_even(792 - b, 6) AS bottom, round_even(r - l, 6) AS width, round_even(b - t, 6) AS height FROM w""", "blocks")
def mask_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = lambda v: F.when(F.col("pos") % 2 == 0, F.lit(v))
    box = b.mask_box(Box.flat(), Box(limit(70.0), limit(90.0), limit(400.0), limit(600.0)), F.col("source_type"), F.col("region_type"), F.lit(20.0), F.lit(H))
    return bind.blocks(spark, sf_dir).select("doc_id", "id", box.alias("m")).select("doc_id", "id", *(F.bround(f"m.{c}", 6).alias(c) for c in ("left", "bottom", "width", "height")))


@query("SELECT doc_id, id, round_even(font_size * 1.12::DOUBLE, 6) AS leading, round_even(top + 0.86::DOUBLE * font_size, 6) AS baseline, regexp_matches(font_name, '(?i)bold|black|heavy') AS bold, CASE WHEN pos % 2 = 0 THEN (x0 + x1) / 2 ELSE x0 END AS anchor, round_even(greatest(2.0::DOUBLE, least(4.0::DOUBLE, 0.35::DOUBLE * font_size)), 6) AS clip, CAST(greatest(0, floor((bottom - top + 0.2::DOUBLE * font_size) / (font_size * 1.12::DOUBLE))) AS BIGINT) AS most_lines FROM blocks", "blocks")
def drawing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = b.drawing(Box.flat(), F.col("font_size"), b.font_weight(F.col("font_name")), F.when(F.col("pos") % 2 == 0, "center").otherwise("left"))
    return bind.blocks(spark, sf_dir).select("doc_id", "id", plan.alias("p")).select("doc_id", "id", F.bround("p.leading", 6).alias("leading"), F.bround("p.baseline", 6).alias("baseline"), "p.bold", "p.anchor", F.bround("p.clip", 6).alias("clip"), "p.most_lines")


@query("SELECT doc_id, page_index FROM pages_ WHERE (doc_id + page_index) % 6 IN (0, 1) OR (doc_id + page_index) % 6 = 2", "pages_")
def page_sizes_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bind.blocks(spark, sf_dir).select("doc_id", "page_index").distinct()
    n = (F.col("doc_id") + F.col("page_index")) % 6
    before = pages.where(n != 0).select("*", F.lit(W).alias("width"), F.lit(H).alias("height"))
    after = pages.where(n != 1).select("*", F.when(n == 2, W + 0.01).when(n == 3, W + 0.001).otherwise(W).alias("width"), F.lit(H).alias("height"))
    return quality.page_sizes_differ(before, after)


@query("""
SELECT doc_id, id, round_even((x1 - x0) * (bottom - top) / (612.0::DOUBLE * 792), 9) AS share, round_even(300.0::DOUBLE + x0 / 1000 * 200, 6) AS v_x0, round_even(50.0::DOUBLE + top / 1000 * 400, 6) AS v_top, round_even(greatest(5.0::DOUBLE, least(18.0::DOUBLE, greatest(1.0::DOUBLE, bottom - top) / 1 * 0.78::DOUBLE)), 6) AS v_size,
       round_even(0.2126::DOUBLE * (pos % 10 / 10.0::DOUBLE) + 0.7152::DOUBLE * (doc_id % 10 / 10.0::DOUBLE) + 0.0722::DOUBLE * 0.5::DOUBLE, 9) AS luma, CASE WHEN 0.2126::DOUBLE * (pos % 10 / 10.0::DOUBLE) + 0.7152::DOUBLE * (doc_id % 10 / 10.0::DOUBLE) + 0.0722::DOUBLE * 0.5::DOUBLE < 0.42::DOUBLE THEN 1.0::DOUBLE ELSE 0.0 END AS ink,
       least(4.0::DOUBLE, 0.5::DOUBLE * pow(2, pos % 6)) AS wait, round_even(x0 + greatest(0.6::DOUBLE, least(1.5::DOUBLE, (x1 - x0) * 0.02::DOUBLE)), 6) AS c_x0, round_even(top + greatest(0.5::DOUBLE, least(1.2::DOUBLE, (bottom - top) * 0.08::DOUBLE)), 6) AS c_top FROM blocks""", "blocks")
def geometry_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = Box.flat()
    v = g.from_thousandths(box, Box(F.lit(300.0), F.lit(50.0), F.lit(500.0), F.lit(450.0)))
    rgb = (F.col("pos") % 10 / 10.0, F.col("doc_id") % 10 / 10.0, F.lit(0.5))
    c = g.cell_text_box(box)
    r6 = lambda x, n: F.bround(x, 6).alias(n)
    return bind.blocks(spark, sf_dir).select(
        "doc_id", "id", F.bround(g.page_share(box, F.lit(W), F.lit(H)), 9).alias("share"), r6(v.x0, "v_x0"), r6(v.top, "v_top"), r6(g.line_font_size(box.height, F.lit(0), 0.78, 5.0, 18.0), "v_size"),
        F.bround(g.luminance(*rgb), 9).alias("luma"), g.contrast_text(*rgb).alias("ink"), g.backoff_seconds(F.col("pos") % 6).alias("wait"), r6(c.x0, "c_x0"), r6(c.top, "c_top"),
    )
