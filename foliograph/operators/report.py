"""Report rows: rollups, searches, labels and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.state import ACTIVE


def issue_rollup(issues: DataFrame, group: list[str], order: str = "id") -> DataFrame:
    """Issues by severity, code and message: pages (from 1), the first five blocks, count; ``first`` for a stable order."""
    by = [*group, "severity", "code", "message"]
    blocks = issues.where("block_id is not null").groupBy(*by, "block_id").agg(F.min(order).alias("_at"))
    first = leading(blocks, by, "_at", "block_id", 5).withColumnRenamed("block_id", "blocks")
    rolled = issues.groupBy(*by).agg(F.array_sort(F.collect_set(F.col("page_index") + 1)).alias("pages"), F.count("*").alias("count"), F.min(order).alias("first"))
    return rolled.join(first, by, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))


def leading(rows: DataFrame, group: list[str], order: str, value: str, most: int) -> DataFrame:
    """The first few values of each group as an array. Rank limits are applied before rows are dealt out, so a group is
    never gathered whole."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(order, value))).where(F.col("_rank") <= most)
    return ranked.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", value))), lambda x: x[value]).alias(value))


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the query, case aside; all for an empty query."""
    wanted = query.strip().lower()
    if not wanted:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted)), F.lit(False))
    return rows.where(hit)


def kpis(jobs: DataFrame, available: Column) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count_if(available).alias("available"))


def shown_progress(status: Column, progress: Column) -> Column:
    return F.when(status == "needs_review", 100).otherwise(progress)


def may_reprocess(status: Column, outdated: Column) -> Column:
    return outdated | status.isin("needs_review", "failed", "cancelled")


def outcome(status: Column, outdated: Column, error: Column, last_log: Column, texts: dict[str, str]) -> Column:
    """The message of a job: that of its outcome, else its last log's."""
    return (
        F.when(outdated, texts["outdated"])
        .when(status == "completed", texts["completed"])
        .when(status == "needs_review", texts["needs_review"])
        .when(status.isin("failed", "cancelled"), F.coalesce(error, F.lit(texts["failed"])))
        .otherwise(last_log)
    )


def customer_message(status: Column, stage: Column, message: Column, pattern: str, instead: str) -> Column:
    return F.when((status == "needs_review") & ((stage == "needs-review") | F.coalesce(message.rlike(pattern), F.lit(False))), F.lit(instead)).otherwise(message)


def top_texts(rows: DataFrame, group: list[str], order: str, text: str, most: int = 10) -> DataFrame:
    """The first few texts of each group in one line, and how many there are."""
    first = leading(rows, group, order, text, most).withColumn("texts", F.array_join(text, ", ")).drop(text)
    return rows.groupBy(*group).agg(F.count("*").alias("count")).join(first, group, "left")


def intake(files: DataFrame, order: str = "ord", most_bytes: int = 200 << 20, most_files: int = 50) -> DataFrame:
    """Chosen files with ``reason``: null if taken, else not_pdf, too_large, duplicate (same name, size and time) or
    too_many. One person's selection: the running count is over it alone (column ``selection``)."""
    kind = F.when(~F.lower("name").endswith(".pdf"), "not_pdf").when(F.col("size") > most_bytes, "too_large")
    rows = files.withColumn("_kind", kind)
    again = F.row_number().over(Window.partitionBy("selection", F.col("_kind").isNull(), "name", "size", "mtime").orderBy(order))
    rows = rows.withColumn("_kind", F.coalesce("_kind", F.when(again > 1, "duplicate")))
    taken = F.sum(F.col("_kind").isNull().cast("int")).over(Window.partitionBy("selection").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("reason", F.coalesce("_kind", F.when(taken > most_files, "too_many"))).drop("_kind")
