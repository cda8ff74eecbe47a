"""The main path of a localization, from layout sources to drawing decisions and learned pairs, for any number of documents
at once. Translator and policy come from outside; everything else is the operators in their order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.operators import documents, grouping, quality, spatial, translation
from foliograph.operators.external import Translator, passthrough, translate_batches
from foliograph.sources import sinks


class Localized(NamedTuple):
    blocks: DataFrame
    translations: DataFrame
    issues: DataFrame
    status: DataFrame
    drawing: DataFrame
    candidates: DataFrame


def layout(native: DataFrame, parsed: DataFrame, regions: DataFrame) -> DataFrame:
    """The hybrid layout: coarse tables marked, native blocks relabelled, unseen parsed blocks appended."""
    return spatial.fuse(native, spatial.mark_coarse_tables(parsed, regions))


def localize(blocks: DataFrame, memory: DataFrame, translate: Translator, policy: str, generic_words: list[str], source_language: str = "en", target_language: str = "zh-CN", mode: str = "review") -> Localized:
    """``blocks``: doc_id, id, page_index, reading_order, place, source_text, source_type, region_type, preserve_reason,
    fragment_confidence, font_size, font_weight, alignment. Memory hits are never sent; batches end with their page."""
    wanted = blocks.where("preserve_reason is null and fragment_confidence >= 0.55")
    looked = translation.memory_lookup(wanted, memory, source_language, target_language, policy)
    hits = looked.where("memory_target is not null").select("doc_id", "id", F.col("memory_target").alias("target_text"))
    misses = translation.memory_misses(looked)
    batches = misses.join(grouping.greedy_batches(misses), ["doc_id", "page_index", "id"])
    fresh = translate_batches(batches, ["doc_id", "page_index", "batch"], translate).select("doc_id", "id", "target_text")
    translations = hits.unionByName(fresh).unionByName(passthrough(blocks))
    pairs = wanted.select("doc_id", "id", "page_index", "reading_order", "source_text").join(translations, ["doc_id", "id"])
    problems = quality.translation_issues(quality.translation_problems(pairs, generic_words, target=target_language), ["doc_id", "id", "page_index"])
    found = problems.select("doc_id", F.lit("translation").alias("stage"), "code", "severity", F.col("code").alias("message"), F.col("page_index").cast("int"), F.col("id").alias("block_id"))
    drawing = sinks.drawing_outcome(blocks, translations)
    overflow = quality.text_overflow(drawing.where("fit.overflow and outcome in ('redact', 'mask')"), blocks)
    missing = translation.missing_translations(blocks, translations).select("doc_id", *quality.issue("missing_translation"))
    issues = quality.union_issues(found, overflow, missing, quality.duplicate_overlays(blocks), quality.unstable_fragments(blocks, "proper name"))
    status = quality.passed(issues, blocks.select("doc_id").distinct())
    # Only documents that passed teach anything.
    taught = pairs.join(status.where("passed").select("doc_id"), "doc_id", "left_semi").withColumn("ord", F.struct("doc_id", "page_index", "reading_order"))
    counted = translation.settled_pairs(translation.pair_occurrences(taught))
    return Localized(blocks, translations, quality.stored_issues(issues), status, drawing, translation.glossary_candidates(counted, mode))


def gate(blocks: DataFrame) -> DataFrame:
    """Documents that are too coarse to be translated block by block."""
    return documents.granularity(blocks).where("not passed")
