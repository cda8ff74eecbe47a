"""Joins by place on a page. Every join keeps the page's key as an equality, so it is planned as a hash or
merge join by page with the geometry as a residual; a page's blocks are few, a corpus' pages are dealt out.

Ties go to the row of smallest ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.geometry import Box, overlap_ratio

PAGE = ("doc_id", "page_index")


def _other(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The right side under names of its own: each column of it as ``r_<name>``."""
    return df.select(*(F.col(c).alias(f"r_{c}") for c in df.columns))


def _same(keys: tuple[str, ...]) -> Column:
    same = F.col(keys[0]) == F.col(f"r_{keys[0]}")
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    return same


def best_overlap(left: DataFrame, right: DataFrame, least: float, take: list[str], row: str = "id", order: str = "ord", keys: tuple[str, ...] = PAGE) -> DataFrame:
    """``left`` with ``best``: overlap and the taken columns of the right row that overlaps it most, null
    below ``least``. Both sides have x0, top, x1, bottom; ``row`` tells left rows of a page apart."""
    ratio = overlap_ratio(Box.flat(), Box.flat("r_"))
    pairs = left.select(*keys, row, *Box._fields).join(_other(right.select(*keys, *Box._fields, order, *take), keys), _same(keys)).withColumn("_ratio", ratio).where(F.col("_ratio") >= least)
    best = pairs.groupBy(*keys, row).agg(F.max(F.struct("_ratio", (-F.col(f"r_{order}")).alias("_first"), *(F.col(f"r_{c}").alias(c) for c in take))).alias("best"))
    return left.join(best, [*keys, row], "left")


def overlapping(left: DataFrame, right: DataFrame, least: float, how: str = "left_semi", keys: tuple[str, ...] = PAGE, also: Column | None = None) -> DataFrame:
    """Left rows that some right row overlaps by at least ``least`` (or none: ``left_anti``)."""
    on = _same(keys) & (overlap_ratio(Box.flat(), Box.flat("r_")) >= least)
    return left.join(_other(right, keys), on if also is None else on & also, how)


def containing(left: DataFrame, right: DataFrame, take: list[str], row: str = "id", order: str = "ord", slack: float = 0.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """``left`` with ``found``: the smallest right box that holds its centre, null without one."""
    a, b = Box.flat(), Box.flat("r_")
    pairs = left.select(*keys, row, *Box._fields).join(_other(right.select(*keys, *Box._fields, order, *take), keys), _same(keys) & b.holds(a.center_x, a.center_y, slack))
    least = pairs.groupBy(*keys, row).agg(F.min(F.struct(b.area.alias("_area"), F.col(f"r_{order}").alias("_first"), *(F.col(f"r_{c}").alias(c) for c in take))).alias("found"))
    return left.join(least, [*keys, row], "left")


def smallest_overlapping(left: DataFrame, right: DataFrame, least: float, take: list[str], row: str = "id", order: str = "ord", keys: tuple[str, ...] = PAGE) -> DataFrame:
    """``left`` with ``found``: the smallest right box that overlaps by at least ``least``."""
    a, b = Box.flat(), Box.flat("r_")
    pairs = left.select(*keys, row, *Box._fields).join(_other(right.select(*keys, *Box._fields, order, *take), keys), _same(keys) & (overlap_ratio(a, b) >= least))
    found = pairs.groupBy(*keys, row).agg(F.min(F.struct(b.area.alias("_area"), F.col(f"r_{order}").alias("_first"), *(F.col(f"r_{c}").alias(c) for c in take))).alias("found"))
    return left.join(found, [*keys, row], "left")


def points_inside(points: DataFrame, boxes: DataFrame, how: str = "inner", slack: float = 0.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Points (columns x, y) with the boxes (``r_``) that hold them; semi and anti joins by ``how``."""
    return points.join(_other(boxes, keys), _same(keys) & Box.flat("r_").holds(F.col("x"), F.col("y"), slack), how)


def mostly_uncovered(words: DataFrame, boxes: DataFrame, word: list[str], share: float = 0.5, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Words (rows of characters: x, y, char) of which at least ``share`` of the characters lie in no box and
    that have a letter."""
    free = points_inside(words, boxes.select(*keys, *Box._fields), "left_anti", keys=keys).groupBy(*keys, *word).agg(F.count("*").alias("_free"))
    whole = words.groupBy(*keys, *word).agg(F.count("*").alias("characters"), F.max(F.col("char").rlike(r"\p{L}").cast("int")).alias("_letters"))
    return whole.join(free, [*keys, *word]).where((F.col("_free") >= share * F.col("characters")) & (F.col("_letters") == 1)).select(*keys, *word, "characters", F.col("_free").alias("uncovered"))


# ----------------------------------------------------------------------------------------------- fusion


def authoritative_pages(blocks: DataFrame, least_blocks: int = 3, least_characters: int = 12, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Pages whose native text is enough to be trusted."""
    visible = F.length(F.regexp_replace("source_text", r"(?U)\s+", ""))
    return blocks.where(F.col("source_type").startswith("native")).groupBy(*keys).agg(F.count("*").alias("native_blocks"), F.sum(visible).alias("native_characters")).where((F.col("native_blocks") >= least_blocks) & (F.col("native_characters") >= least_characters))


def relabel(native: DataFrame, parsed: DataFrame, least: float = 0.25) -> DataFrame:
    """Native blocks with the region type of the parsed block that overlaps them most, or their own."""
    return best_overlap(native, parsed, least, ["region_type"]).withColumn("region_type", F.coalesce("best.region_type", "region_type")).drop("best")


def append_unseen(native: DataFrame, parsed: DataFrame, least: float = 0.4) -> DataFrame:
    """Parsed blocks that no native block overlaps, on pages without enough native text (tables recovered
    from images on every page)."""
    unseen = overlapping(parsed, native.select(*PAGE, *Box._fields), least, "left_anti")
    trusted = authoritative_pages(native).select(*PAGE).withColumn("_trusted", F.lit(True))
    return unseen.join(trusted, list(PAGE), "left").where(F.col("_trusted").isNull() | (F.col("source_type") == "image-table")).drop("_trusted")


def fuse(native: DataFrame, parsed: DataFrame) -> DataFrame:
    """The hybrid layout: relabelled native blocks, then unseen parsed ones."""
    return relabel(native, parsed).unionByName(append_unseen(native, parsed), allowMissingColumns=True)


def coarse_image_table(text: Column, source_type: Column, region_type: Column, block: Box, region: Box, least: float = 0.8, share: float = 0.18) -> Column:
    """A parsed table whose text is one lump over an image region."""
    lump = (F.length(F.regexp_replace(text, r"(?U)\s+", "")) >= 80) | (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) >= 3)
    return (source_type == "mineru") & (region_type == "table") & lump & (overlap_ratio(block, region) >= least) & (block.area / F.greatest(F.lit(0.1), region.area) >= share)


def mark_coarse_tables(parsed: DataFrame, regions: DataFrame, reason: str = "the table could not be taken apart") -> DataFrame:
    """Parsed blocks with a preserve_reason where some region makes them a coarse table."""
    coarse = coarse_image_table(F.col("source_text"), F.col("source_type"), F.col("region_type"), Box.flat(), Box.flat("r_"))
    hit = parsed.select(*PAGE, "id", "source_text", "source_type", "region_type", *Box._fields).join(_other(regions.select(*PAGE, *Box._fields), PAGE), _same(PAGE) & coarse, "left_semi").select(*PAGE, "id").withColumn("_coarse", F.lit(True))
    return parsed.join(hit, [*PAGE, "id"], "left").withColumn("preserve_reason", F.when(F.col("_coarse"), F.lit(reason)).otherwise(F.col("preserve_reason"))).drop("_coarse")


def route_regions(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Image regions with ``route``: dropped where a table was recovered from them, preserved where a coarse
    table stands over them, else safe to translate."""
    done = overlapping(regions, blocks.where("source_type = 'image-table'").select(*PAGE, *Box._fields), 0.8).select(*PAGE, "id").withColumn("_done", F.lit(True))
    b = blocks.where("preserve_reason is not null").select(*PAGE, "source_text", "source_type", "region_type", *Box._fields)
    coarse = coarse_image_table(F.col("r_source_text"), F.col("r_source_type"), F.col("r_region_type"), Box.flat("r_"), Box.flat())
    kept = regions.join(_other(b, PAGE), _same(PAGE) & coarse, "left_semi").select(*PAGE, "id").withColumn("_kept", F.lit(True))
    return regions.join(done, [*PAGE, "id"], "left").join(kept, [*PAGE, "id"], "left").withColumn("route", F.when(F.col("_done"), "dropped").when(F.col("_kept"), "preserved").otherwise("safe")).drop("_done", "_kept")


def residual_targets(residuals: DataFrame, blocks: DataFrame, least: float = 0.15) -> DataFrame:
    """Residuals with the id of the block that they overlap most (null: uncovered)."""
    return best_overlap(residuals, blocks.select(*PAGE, *Box._fields, "ord", F.col("id").alias("block_id")), least, ["block_id"]).withColumn("block_id", F.col("best.block_id")).drop("best")


# --------------------------------------------------------------------------------------------- table edges


def edge_kind(box: Box, least: float) -> Column:
    """By geometry, never by label: v is tall and narrow, h wide and flat."""
    wide, high = F.abs(box.width), F.abs(box.height)
    return F.when(high >= F.greatest(F.lit(least), wide * 3), "v").when(wide >= F.greatest(F.lit(least), high * 3), "h")


def infer_cells(texts: DataFrame, edges: DataFrame, slack: float = 2.0, row: str = "id", keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The table cell around each text, from the nearest edges on its four sides; null if one is missing or
    the cell is too small."""
    t, e = Box.flat(), Box.flat("r_")
    kind = edge_kind(e, 5.0)
    span_y = t.center_y.between(F.least(e.top, e.bottom) - slack, F.greatest(e.top, e.bottom) + slack)
    span_x = t.center_x.between(F.least(e.x0, e.x1) - slack, F.greatest(e.x0, e.x1) + slack)
    pairs = texts.select(*keys, row, *Box._fields).join(_other(edges.select(*keys, *Box._fields), keys), _same(keys))
    v, h = (kind == "v") & span_y, (kind == "h") & span_x
    sides = pairs.groupBy(*keys, row, *Box._fields).agg(
        F.max(F.when(v & (e.center_x <= t.x0 + slack), e.center_x)).alias("c_x0"),
        F.max(F.when(h & (e.center_y <= t.top + slack), e.center_y)).alias("c_top"),
        F.min(F.when(v & (e.center_x >= t.x1 - slack), e.center_x)).alias("c_x1"),
        F.min(F.when(h & (e.center_y >= t.bottom - slack), e.center_y)).alias("c_bottom"),
    )
    c = Box.flat("c_")
    large = (c.width >= F.greatest(F.lit(3.0), t.width - 2 * slack)) & (c.height >= F.greatest(F.lit(3.0), t.height - 2 * slack))
    return sides.select(*keys, row, F.when(large, c.struct()).alias("cell"))


def supported_cells(cells: DataFrame, edges: DataFrame, tolerance: float = 1.2, row: str = "id", keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Cells with ``supported``: an edge within the tolerance covers 65 % of each side."""
    c, e = Box.flat(), Box.flat("r_")
    kind = F.when(F.abs(e.width) >= F.greatest(F.lit(3.0), F.abs(e.height) * 3), "h").when(F.abs(e.height) >= F.greatest(F.lit(3.0), F.abs(e.width) * 3), "v")
    across = F.greatest(F.lit(0.0), F.least(c.x1, F.greatest(e.x0, e.x1)) - F.greatest(c.x0, F.least(e.x0, e.x1))) >= F.greatest(F.lit(1.0), c.width) * 0.65
    down = F.greatest(F.lit(0.0), F.least(c.bottom, F.greatest(e.top, e.bottom)) - F.greatest(c.top, F.least(e.top, e.bottom))) >= F.greatest(F.lit(1.0), c.height) * 0.65
    side = lambda at, of, fits, k: F.max(F.coalesce((kind == k) & (F.abs(at - of) <= tolerance) & fits, F.lit(False)).cast("int"))
    found = (
        cells.select(*keys, row, *Box._fields).join(_other(edges.select(*keys, *Box._fields), keys), _same(keys))
        .groupBy(*keys, row).agg((side(e.center_y, c.top, across, "h") + side(e.center_y, c.bottom, across, "h") + side(e.center_x, c.x0, down, "v") + side(e.center_x, c.x1, down, "v")).alias("_sides"))
    )
    return cells.join(found, [*keys, row], "left").withColumn("supported", F.coalesce(F.col("_sides") == 4, F.lit(False))).drop("_sides")


def credible_grids(edges: DataFrame, tolerance: float = 1.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Pages with ``credible``: at least three coordinates in either direction that three edges share."""
    b = Box.flat()
    kind = edge_kind(b, 5.0)
    at = F.bround(F.when(kind == "v", b.center_x).otherwise(b.center_y) / max(0.1, tolerance))
    often = edges.select(*keys, kind.alias("kind"), at.alias("at")).where("kind is not null").groupBy(*keys, "kind", "at").agg(F.count("*").alias("n")).where("n >= 3")
    n = lambda k: F.count_if(F.col("kind") == k)
    found = often.groupBy(*keys).agg(n("v").alias("vertical"), n("h").alias("horizontal"))
    pages = edges.select(*keys).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pages.join(found, list(keys), "left").select(*keys, zero("vertical"), zero("horizontal")).withColumn("credible", (F.col("vertical") >= 3) & (F.col("horizontal") >= 3))


def credible_tables(cells: DataFrame, table: list[str]) -> DataFrame:
    """Tables with ``credible``: four cells and three distinct boundaries in either direction."""
    b = Box.flat()
    bounds = cells.select(*table, F.explode(F.array(F.struct(F.bround(b.x0, 1).alias("x"), F.bround(b.top, 1).alias("y")), F.struct(F.bround(b.x1, 1).alias("x"), F.bround(b.bottom, 1).alias("y")))).alias("p"))
    return bounds.groupBy(*table).agg((F.count("*") / 2).cast("long").alias("cells"), F.count_distinct("p.x").alias("xs"), F.count_distinct("p.y").alias("ys")).withColumn("credible", (F.col("cells") >= 4) & (F.col("xs") >= 3) & (F.col("ys") >= 3))


def distinct_cells(cells: DataFrame, order: str = "ord", keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The first cell of each box to three decimals."""
    rounded = [F.bround(c, 3).alias(n) for n, c in zip(Box._fields, Box.flat(), strict=True)]
    return cells.groupBy(*keys, *rounded).agg(F.min(order).alias(order))


def orientation_counts(edges: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Flat and tall edges of a page; a table needs two of each."""
    b = Box.flat()
    wide, high = F.abs(b.width), F.abs(b.height)
    return edges.groupBy(*keys).agg(F.count_if(wide >= high * 3).alias("horizontal"), F.count_if(high >= wide * 3).alias("vertical")).withColumn("enough", (F.col("horizontal") >= 2) & (F.col("vertical") >= 2))
