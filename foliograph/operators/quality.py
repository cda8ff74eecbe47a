"""Quality rules: rows in, issues out. An issue: doc_id, stage, code, severity, message, page_index, block_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.geometry import Box, overlap_ratio, page_share
from foliograph.functions.text import HANGUL, KANA, ascii_lower, latin_words, model_or_standard, newline_count, number_tokens, remove_model_tokens, remove_terms, strip, suffix_pattern

ISSUE = ("stage", "code", "severity", "message", "page_index", "block_id")
#: Thresholds of what may change outside replaced text.
MOST_CHANGE, MOST_COLOR_LOSS, MOST_DARK_LOSS = 0.002, 0.03, 0.05


def issue(code: str, severity: str = "error", stage: str = "validation", message: str | None = None, page: str | None = "page_index", block: str | None = "id") -> list[Column]:
    return [
        F.lit(stage).alias("stage"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message or code).alias("message"),
        (F.col(page) if page else F.lit(None)).cast("int").alias("page_index"), (F.col(block) if block else F.lit(None)).cast("string").alias("block_id"),
    ]


def translation_problems(rows: DataFrame, generic_words: list[str], terms: Column | None = None, target: str = "zh-CN", preserve_models: bool = True) -> DataFrame:
    """Rows (source_text, target_text) with ``residue`` (kana or Hangul left in Chinese), ``english`` (generic words that
    stand in both) and ``numbers`` (another multiset of numbers)."""
    clean = remove_terms(F.col("target_text"), terms) if terms is not None else F.col("target_text")
    models = remove_model_tokens if preserve_models else (lambda c: c)
    generic = F.array(*map(F.lit, generic_words)).cast("array<string>")
    both = F.array_intersect(F.array_intersect(latin_words(models(F.col("source_text"))), latin_words(models(clean))), generic)
    return rows.withColumns({
        "residue": F.coalesce(clean.rlike(f"[{KANA}{HANGUL}]"), F.lit(False)) & F.lit(target == "zh-CN"),
        "english": F.array_join(F.array_sort(both), ","),
        "numbers": F.lit(preserve_models) & (number_tokens(F.col("source_text")) != number_tokens(F.col("target_text"))),
    })


def translation_issues(problems: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each rule that a translation breaks."""
    codes = F.array(F.when(F.col("residue"), F.lit("script_residue")), F.when(F.col("english") != "", F.lit("generic_english")), F.when(F.col("numbers"), F.lit("number_mismatch")))
    return problems.select(*keys, F.explode(F.array_compact(codes)).alias("code")).withColumn("severity", F.lit("error"))


def text_overflow(overflow: DataFrame, blocks: DataFrame) -> DataFrame:
    return overflow.select("doc_id", "id").join(blocks.select("doc_id", "id", "page_index"), ["doc_id", "id"], "left").select("doc_id", *issue("text_overflow"))


def unstable_fragments(blocks: DataFrame, except_reason: str) -> DataFrame:
    return blocks.where(F.col("preserve_reason").isNotNull() & (F.col("preserve_reason") != except_reason)).select("doc_id", *issue("unstable_source_fragment", "warning"))


def unsafe_masks(blocks: DataFrame, replaced: DataFrame) -> DataFrame:
    large = page_share(Box.flat(), F.col("page_width"), F.col("page_height")) >= 0.05
    return blocks.where(large & (F.col("geometry_fill_ratio") < 0.35)).join(replaced, ["doc_id", "id"], "left_semi").select("doc_id", *issue("unsafe_mask_geometry"))


def coarse_native(text: Column, region: Column, source_type: Column, box: Box, font_size: Column) -> Column:
    return (region != "table") & source_type.startswith("native") & (newline_count(text) >= 3) & (box.height >= 3 * font_size)


def coarse_native_blocks(blocks: DataFrame, replaced: DataFrame) -> DataFrame:
    coarse = coarse_native(F.col("source_text"), F.col("region_type"), F.col("source_type"), Box.flat(), F.col("font_size"))
    return blocks.where(coarse).join(replaced, ["doc_id", "id"], "left_semi").select("doc_id", *issue("coarse_native_text_block"))


def duplicate_overlays(blocks: DataFrame, least: float = 0.15) -> DataFrame:
    """Text read from an image over text that a page has already."""
    read = blocks.where("source_type = 'vision'")
    own = blocks.where("source_type <> 'vision'").select(F.col("doc_id").alias("r_doc_id"), F.col("page_index").alias("r_page_index"), *Box.flat().named("r_"))
    on = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page_index") == F.col("r_page_index")) & (overlap_ratio(Box.flat(), Box.flat("r_")) >= least)
    return read.join(own, on, "left_semi").select("doc_id", *issue("duplicate_visual_overlay"))


def pixel_issues(pages: DataFrame) -> DataFrame:
    """Pages with ``change``, ``color_loss`` and ``dark_loss`` beyond what text replacement explains."""
    codes = F.array(F.when(F.col("change") > MOST_CHANGE, F.lit("non_text_content_changed")), F.when((F.col("color_loss") > MOST_COLOR_LOSS) | (F.col("dark_loss") > MOST_DARK_LOSS), F.lit("graphical_content_erased")))
    found = pages.select("doc_id", "page_index", F.explode(F.array_compact(codes)).alias("code"))
    return found.select("doc_id", F.lit("validation").alias("stage"), "code", F.lit("error").alias("severity"), F.col("code").alias("message"), F.col("page_index").cast("int"), F.lit(None).cast("string").alias("block_id"))


def most_change(pages: DataFrame) -> DataFrame:
    """The largest change and losses of each document's pages, and how many were compared."""
    return pages.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("change", "color_loss", "dark_loss")), F.count("*").alias("pages"))


def review_gaps(expected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Documents of which fewer pages were reviewed than they have."""
    seen = reviewed.groupBy("doc_id").agg(F.count_distinct("page_index").alias("_seen"))
    short = expected.join(seen, "doc_id", "left").where(F.coalesce("_seen", F.lit(0)) < F.col("pages"))
    return short.select("doc_id", *issue("incomplete_page_review", page=None, block=None))


def render_failures(failed: DataFrame) -> DataFrame:
    """Documents (doc_id, error) whose pages could not be drawn for review."""
    return failed.select("doc_id", "error", *issue("page_render_failed", page=None, block=None)).withColumn("message", F.col("error")).drop("error")


def text_failures(problems: DataFrame) -> DataFrame:
    """What is left of translation problems (doc_id, id, code) after all repairs."""
    rows = problems.select("doc_id", F.col("id").cast("string").alias("block_id"), F.concat_ws(" ", F.col("id").cast("string"), F.col("code")).alias("message"))
    return rows.select("doc_id", F.lit("translation-quality").alias("stage"), F.lit("translation_quality_failed").alias("code"), F.lit("error").alias("severity"), "message", F.lit(None).cast("int").alias("page_index"), "block_id")


def visual_failures(residuals: DataFrame, shown: int = 10) -> DataFrame:
    """One issue for each document with residual texts (ord, text) that is still to be translated: the first of them."""
    from foliograph.operators.report import top_texts

    rows = top_texts(residuals, ["doc_id"], "ord", "text", shown)
    return rows.select("doc_id", F.lit("visual-quality").alias("stage"), F.lit("untranslated_visual_text").alias("code"), F.lit("error").alias("severity"), F.concat(F.col("count").cast("string"), F.lit(": "), "texts").alias("message"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("string").alias("block_id"))


def evaluation_failures(jobs: DataFrame, key: str = "doc_id") -> DataFrame:
    """For jobs (has_file, error) that failed after their file was made: the one issue that replaces theirs."""
    rows = jobs.where("has_file and error is not null").withColumn("doc_id", F.col(key))
    return rows.select("doc_id", F.lit("visual-quality").alias("stage"), F.lit("quality_evaluation_failed").alias("code"), F.lit("error").alias("severity"), F.left("error", F.lit(1000)).alias("message"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("string").alias("block_id"))


def page_sizes_differ(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages that one file lacks or that differ in size to two decimals."""
    keys = ["doc_id", "page_index"]
    size = lambda df, n: df.select(*keys, F.struct(F.bround("width", 2), F.bround("height", 2)).alias(n))
    return size(before, "a").join(size(after, "b"), keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def union_issues(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stored_issues(issues: DataFrame) -> DataFrame:
    """As they are kept: defaults filled, texts cut."""
    cut = lambda c, n, default: F.left(F.coalesce(F.col(c), F.lit(default)), F.lit(n)).alias(c)
    return issues.select("doc_id", cut("stage", 64, "validation"), cut("code", 64, "unknown"), cut("severity", 16, "error"), cut("message", 1000, ""), "page_index", F.left("block_id", F.lit(128)).alias("block_id"))


def passed(issues: DataFrame, jobs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each job with its issues, errors, whether it passed, and the status that follows."""
    counted = issues.groupBy(key).agg(F.count("*").alias("_issues"), F.count_if(F.col("severity") == "error").alias("_errors"))
    out = jobs.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("_issues", F.lit(0)).cast("long").alias("issues"), F.coalesce("_errors", F.lit(0)).cast("long").alias("errors"))
    return out.withColumns({"passed": F.col("errors") == 0, "status": F.when(F.col("errors") == 0, "completed").otherwise("needs_review")})


def status_after(failed: Column, has_file: Column, errors: Column) -> Column:
    """A job that failed still needs only review if its file is there."""
    return F.when(failed & ~has_file, "failed").when(failed | (errors > 0), "needs_review").otherwise("completed")


def kept_residuals(residuals: DataFrame, terms: DataFrame, contexts: DataFrame, generic_words: list[str], remarks: list[str], key: str = "doc_id") -> DataFrame:
    """Residual texts (ord, text) that are still to be translated: not blank, not repeated up to case, no remark on
    legibility, no part of a protected term (key, term), no company name and no model or standard. A text is a company's
    name also if a source text (key, source_text) that holds it has a company suffix."""
    rows = residuals.withColumn("text", strip(F.col("text"))).where("text <> ''")
    first = Window.partitionBy(key, F.lower("text")).orderBy("ord")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    remark = F.lit(False)
    for r in remarks:
        remark = remark | F.lower("text").contains(r)
    from foliograph.functions.text import COMPANY_SUFFIXES, lone_company_name

    alone = F.coalesce(lone_company_name(F.col("text"), generic_words), F.lit(False))
    rows = rows.where(~remark & ~model_or_standard(F.col("text")) & ~alone)
    part = rows.alias("r").join(terms.alias("t"), (F.col(f"r.{key}") == F.col(f"t.{key}")) & F.contains(F.lower("t.term"), F.lower("r.text")), "left_anti")
    named = contexts.where(F.col("source_text").rlike(suffix_pattern(COMPANY_SUFFIXES))).alias("c")
    latin = F.col("r.text").rlike(r"^[A-Za-z][A-Za-z .,&'®™/-]*$") & ~F.col("r.text").rlike(suffix_pattern(COMPANY_SUFFIXES))
    return part.join(named, (F.col(f"r.{key}") == F.col(f"c.{key}")) & latin & F.contains(F.lower("c.source_text"), F.lower("r.text")), "left_anti")


def surviving(residuals: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """All residual rows whose text was kept, up to case."""
    k = kept.select(F.col(key).alias("_k"), F.lower("text").alias("_t")).distinct()
    return residuals.join(k, (F.col(key) == F.col("_k")) & (F.lower(strip(F.col("text"))) == F.col("_t")), "left_semi")


def repair_rounds(rows: DataFrame, find, repairs: list, most: int = 2) -> DataFrame:
    """Applies model repairs up to ``most`` times and then each deterministic repair once, finding the problems anew
    before each and stopping when there are none. ``find``: rows -> problem rows; a repair: (rows, problems) -> rows.
    Every round is checkpointed where the session has a folder for it, so plans stay short."""
    model, *fixed = repairs
    for repair in [model] * most + fixed:
        problems = find(rows)
        if problems.isEmpty():
            break
        rows = repair(rows, problems)
        if rows.sparkSession.sparkContext.getCheckpointDir():
            rows = rows.checkpoint()
    return rows


def folded(text: Column) -> Column:
    return ascii_lower(strip(text))
