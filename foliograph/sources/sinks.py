"""Sinks: what is to be drawn is decided in DataFrames; bytes are made by a renderer that is passed in, a file a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.geometry import Box, clipped
from foliograph.functions.text import normalize_source, normalize_translation
from foliograph.functions.values import archive_name
from foliograph.operators.blocks import drawing, fit, least_font, mask_box


def drawing_outcome(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Blocks with ``outcome``: preserved, missing (an error), unchanged (skipped), redact (native text) or mask; and the
    drawing plan of those that change."""
    joined = blocks.join(translations.select("doc_id", "id", "target_text"), ["doc_id", "id"], "left")
    said = normalize_translation(F.coalesce("target_text", F.lit("")))
    outcome = (
        F.when(F.col("preserve_reason").isNotNull() | (F.col("fragment_confidence") < 0.55), "preserved")
        .when(said == "", "missing")
        .when(said == normalize_source(F.col("source_text")), "unchanged")
        .when(F.col("source_type") == "native", "redact")
        .otherwise("mask")
    )
    placed = fit(said, Box.flat(), F.col("font_size"), least_font(F.col("source_type"), F.col("region_type")))
    out = joined.withColumns({"text": said, "outcome": outcome, "fit": placed})
    return out.withColumn("plan", drawing(Box.flat(), F.col("fit.font_size"), F.col("font_weight"), F.col("alignment")))


def redactions(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of text to delete, cut to their page; empty ones are skipped."""
    page = Box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    held = clipped(Box.flat(), page)
    rows = blocks.where("outcome = 'redact'").join(pages.select("doc_id", "page_index", "width", "height"), ["doc_id", "page_index"])
    return rows.where((held.width > 0) & (held.height > 0)).select("doc_id", "page_index", "id", held.struct().alias("box"))


def masks(blocks: DataFrame, pages: DataFrame, vision_padding: float = 12.0, attempt: int = 0) -> DataFrame:
    """Rectangles that cover text which can't be deleted; text read from images gets 8 points more at each attempt."""
    rows = blocks.where("outcome = 'mask'").join(pages.select("doc_id", "page_index", F.col("height").alias("_h")), ["doc_id", "page_index"])
    padding = F.lit(vision_padding + 8.0 * attempt)
    return rows.select("doc_id", "page_index", "id", mask_box(Box.flat(), Box.of("mask_bbox"), F.col("source_type"), F.col("region_type"), padding, F.col("_h")).alias("mask"))


def render(files: DataFrame, plans: DataFrame, draw: Callable[[bytes, list[dict]], bytes]) -> DataFrame:
    """path and result (bytes) of each file, drawn from its plan rows; an empty result fails the task."""
    grouped = plans.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*(c for c in plans.columns if c != "path")))).alias("plan"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [draw(bytes(c), [dict(p) for p in plan] if plan is not None else []) for c, plan in zip(part["content"], part["plan"], strict=True)]
            if not all(made):
                raise ValueError("a renderer gave an empty file")
            yield pd.DataFrame({"path": part["path"], "result": made})

    return files.select("path", "content").join(grouped, "path", "left").mapInPandas(run, "path string, result binary")


def write_new(df: DataFrame, path: str) -> None:
    """Appends rows."""
    df.write.mode("append").parquet(path)


def write_partitions(df: DataFrame, path: str, by: str = "job_id") -> None:
    """Replaces the partitions that occur in ``df`` and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def archived_path(job: Column, at: Column) -> Column:
    return archive_name(job, at)


def move_file(spark, source: str, target: str) -> bool:
    """Moves one file where Spark's file systems reach it."""
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = src.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(dst.getParent())
    return fs.rename(src, dst)


def download(jobs: DataFrame) -> DataFrame:
    """What a download answers: 200 or 409, and the quality that its header names."""
    ok = F.col("downloadable") & F.col("has_file")
    return jobs.select("job_id", F.when(ok, 200).otherwise(409).alias("code"), F.when(ok, F.when(F.col("status") == "completed", "passed").otherwise("review-recommended")).alias("quality"))
