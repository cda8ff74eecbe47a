"""Rollups of a document's blocks, and the routes that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.geometry import Box, page_share
from foliograph.functions.text import compact, newline_count
from foliograph.operators.blocks import translatable
from foliograph.operators.spatial import points_inside


def document_stats(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Characters without white space, and blocks that are unsafe, of tables, of tables from images."""
    unsafe = ~translatable(F.col("preserve_reason"), F.col("fragment_confidence"))
    return blocks.groupBy(doc).agg(
        F.sum(F.length(compact(F.col("source_text")))).alias("characters"),
        F.count("*").alias("blocks"),
        F.count_if(unsafe).alias("unsafe_blocks"),
        F.count_if(F.col("region_type") == "table").alias("table_blocks"),
        F.count_if(F.col("source_type") == "image-table").alias("image_table_blocks"),
        F.count_if(F.col("source_type").startswith("native")).alias("native_blocks"),
    )


def coverage(covered: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.least(F.lit(1.0), covered / total))


def native_coverage(characters: DataFrame, boxes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Letters of each document (rows x, y, char by page), those that lie in some box, and their share."""
    letters = characters.where(F.col("char").rlike(r"\p{L}"))
    total = letters.groupBy(doc).agg(F.count("*").alias("total"))
    covered = points_inside(letters, boxes, "left_semi").groupBy(doc).agg(F.count("*").alias("_covered"))
    out = total.join(covered, doc, "left").withColumn("covered", F.coalesce("_covered", F.lit(0)).cast("long")).drop("_covered")
    return out.withColumn("coverage", coverage(F.col("covered"), F.col("total")))


def usable_native(source_type: Column, characters: Column, share: Column) -> Column:
    return source_type.startswith("native") & (characters >= 8) & (share >= 0.98)


def structural_analysis_needed(usable: Column, unsafe: Column, tables: Column, has_regions: Column) -> Column:
    return ~usable | (unsafe > 0) | (tables >= 4) | has_regions


def parser_route(strategy: Column, usable: Column, needed: Column) -> Column:
    """Whether the structure parser is asked: always, unless native text is usable, or only where needed."""
    return F.when(strategy == "structure-first", True).when(strategy == "native-first", ~usable).otherwise(needed)


def granularity(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Whether a document's translatable blocks are fine enough: average length, oversized, many-line and unsafe ones,
    and ``passed``. Blocks carry page_width and page_height; ``pages`` and ``coverage`` are per document."""
    n = F.length(compact(F.col("source_text")))
    unsafe = (page_share(Box.flat(), F.col("page_width"), F.col("page_height")) >= 0.05) & (F.col("geometry_fill_ratio") < 0.35)
    stats = blocks.where(translatable(F.col("preserve_reason"), F.col("fragment_confidence"))).groupBy(doc).agg(
        F.count("*").alias("blocks"), F.avg(n).alias("average"), F.count_if(n > 260).alias("oversized"),
        F.count_if((newline_count(F.col("source_text")) >= 2) & (n > 160)).alias("multiline"), F.count_if(unsafe).alias("unsafe"),
        F.max("pages").alias("pages"), F.max("coverage").alias("coverage"),
    )
    b = F.col("blocks")
    failed = ((F.col("average") > 220) & (b < 20 * F.col("pages"))) | (F.col("oversized") / b >= 0.2) | (F.col("multiline") / b >= 0.1) | (F.col("unsafe") > 0)
    return stats.withColumn("passed", (F.col("coverage") < 0.8) | ~failed)


def select_layout(native: DataFrame, parsed: DataFrame, flags: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each document's blocks from its usable native text (``usable`` in flags), else from the parser."""
    use = flags.select(doc, "usable")
    chosen = native.join(use.where("usable"), doc, "left_semi")
    return chosen.unionByName(parsed.join(use.where("usable"), doc, "left_anti"), allowMissingColumns=True)


def sum_usage(rows: DataFrame, group: list[str]) -> DataFrame:
    """Token sums; available if any part is."""
    return rows.groupBy(*group).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")), F.bool_or("token_usage_available").alias("token_usage_available"))


def render_counts(outcomes: DataFrame, doc: str = "doc_id") -> DataFrame:
    return outcomes.groupBy(doc).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("replaced", "missing", "overflow", "unchanged", "preserved")))
