"""Job state from appended rows: every table is the newest view of events, every change a new table.

Parquet has no merge; a single committer writes the next version, readers keep the last whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.geometry import clamp
from foliograph.functions.text import safe_error, strip
from foliograph.functions.values import elapsed_ms

ACTIVE = ("queued", "analyzing", "segmenting", "parsing", "translating", "repairing", "rendering", "validating")
TERMINAL = ("completed", "needs_review", "failed", "cancelled")
COUNTERS = ("parse_ms", "llm_ms", "render_ms", "validation_ms", "input_tokens", "output_tokens", "total_tokens", "batches", "resumed", "memory_hits", "issue_count")


def newest(events: DataFrame, key: list[str], order: list[str], last: list[str], kept: list[str]) -> DataFrame:
    """One row a key: ``last`` columns from the newest event, ``kept`` ones the newest that isn't null."""
    at = F.struct(*order)
    return events.groupBy(*key).agg(
        *(F.max_by(c, at).alias(c) for c in last),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in kept),
    )


def progress(value: Column) -> Column:
    return clamp(value, 0, 100)


def log_row(stage: Column, message: Column, percent: Column) -> list[Column]:
    return [F.left(stage, F.lit(64)).alias("stage"), F.left(strip(message), F.lit(1000)).alias("message"), progress(percent).alias("progress")]


def accumulate(deltas: DataFrame, key: str, counters: tuple[str, ...], flag: str | None = None) -> DataFrame:
    """Sums of increments, none below 0; the flag if any sets it."""
    sums = [F.sum(F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))).cast("long").alias(c) for c in counters]
    return deltas.groupBy(key).agg(*sums, *([F.bool_or(F.coalesce(flag, F.lit(False))).alias(flag)] if flag else []))


def durations(runs: DataFrame, as_of: Column) -> DataFrame:
    """With duration_ms: from start to finish, or to ``as_of`` while a job runs."""
    return runs.withColumn("duration_ms", elapsed_ms(F.col("started_at"), F.coalesce("finished_at", as_of)))


def started_and_finished(events: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """The first start, and the last finish unless a later start has taken it back."""
    start, end = F.col(kind) == "start", F.col(kind) == "finish"
    out = events.groupBy(key).agg(F.min(F.when(start, F.col(at))).alias("started_at"), F.max(F.when(start, F.col(at))).alias("_last"), F.max(F.when(end, F.col(at))).alias("_end"))
    return out.select(key, "started_at", F.when(F.col("_end") >= F.coalesce("_last", "_end"), F.col("_end")).alias("finished_at"))


def availability(status: Column, version: Column, current: str, has_file: Column, legacy: Column) -> dict[str, Column]:
    """Three flags: shown as available (current version only), may be downloaded (in review also of other versions but the
    legacy one), outdated (completed by another version)."""
    now = version == current
    return {
        "available": status.isin("completed", "needs_review") & now & has_file,
        "downloadable": has_file & (((status == "completed") & now) | ((status == "needs_review") & ~legacy)),
        "outdated": (status == "completed") & ~now,
    }


def recover(jobs: DataFrame, files: DataFrame, legacy_message: str) -> DataFrame:
    """Jobs that a restart interrupted (active, or failed with the exact legacy message) with their next state: failed if
    the source is gone, else queued again at 0."""
    cut = F.col("status").isin(*ACTIVE) | ((F.col("status") == "failed") & (F.col("error_message") == legacy_message))
    there = files.where("exists").select(F.col("path").alias("source_path")).distinct().withColumn("_there", F.lit(True))
    found = jobs.where(F.coalesce(cut, F.lit(False))).join(there, "source_path", "left")
    ok = F.coalesce("_there", F.lit(False))
    return found.withColumns({
        "status": F.when(ok, "queued").otherwise("failed"),
        "progress": F.when(ok, 0).otherwise(F.col("progress")),
        "error_message": F.when(ok, F.lit(None)).otherwise("the source file is missing"),
    }).drop("_there")


def reprocess(jobs: DataFrame, current: str) -> DataFrame:
    """Jobs with ``accepted`` (not active) and what a new run resets; batches are dropped only if another version made them."""
    ok = ~F.col("status").isin(*ACTIVE)
    return jobs.withColumns({
        "accepted": ok,
        "drop_batches": ok & (F.col("pipeline_version") != current),
        "status": F.when(ok, "queued").otherwise(F.col("status")),
        "progress": F.when(ok, 0).otherwise(F.col("progress")),
        "pipeline_version": F.when(ok, F.lit(current)).otherwise(F.col("pipeline_version")),
    })


def batches_after_reprocess(batches: DataFrame, reset: DataFrame) -> DataFrame:
    return batches.join(reset.where("drop_batches").select("job_id"), "job_id", "left_anti")


def cancel(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), status).otherwise("cancelled")


def merge_batch_progress(saves: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Batch rows from successive saves: maps merged with the later value winning, attempts and tokens added, the flag
    kept once set, status and error from the last save."""
    at = F.struct(*order)
    entries = saves.select(*key, at.alias("_at"), F.explode("translations").alias("_k", "_v")).groupBy(*key, "_k").agg(F.max_by("_v", "_at").alias("_v"))
    maps = entries.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("translations"))
    sums = saves.groupBy(*key).agg(
        *(F.sum(c).cast("long").alias(c) for c in ("attempts", "input_tokens", "output_tokens", "total_tokens")),
        F.bool_or("token_usage_available").alias("token_usage_available"),
        F.max_by("status", at).alias("status"), F.max_by(safe_error(F.col("error_message"), F.lit("")), at).alias("error_message"),
    )
    return sums.join(maps, key, "left")


def resumable(batches: DataFrame) -> DataFrame:
    """Batches with ``complete``: done, and each of their blocks has its translation."""
    whole = F.forall("block_ids", lambda i: F.map_contains_key(F.coalesce("translations", F.create_map().cast("map<string,string>")), i))
    return batches.withColumn("complete", (F.col("status") == "completed") & whole)


def with_new_columns(old: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive schema change: columns that the table lacks, at their defaults; null ones filled."""
    return old.withColumns({c: F.coalesce(F.col(c), v) if c in old.columns else v for c, v in defaults.items()})


def insert_missing(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.unionByName(wanted.join(rows, key, "left_anti"), allowMissingColumns=True)


def backfill_version(jobs: DataFrame, metrics: DataFrame, current: str, legacy: str) -> DataFrame:
    """Legacy jobs whose metrics show a validated, batched run were made by the current version."""
    done = metrics.where("validation_ms > 0 and batches > 0").select("job_id").withColumn("_done", F.lit(True))
    return jobs.join(done, "job_id", "left").withColumn("pipeline_version", F.when((F.col("pipeline_version") == legacy) & F.col("_done"), F.lit(current)).otherwise(F.col("pipeline_version"))).drop("_done")


def replace_issues(kept: DataFrame, new: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """The issue table after the named jobs' rows were replaced (by none, too)."""
    return kept.join(jobs.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def current_run(logs: DataFrame, key: str, order: list[str], restart: Column) -> DataFrame:
    """Logs with ``is_current``: from the last restart on, or all without one."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = logs.withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(restart, F.col("_n"))).over(Window.partitionBy(key))
    return numbered.withColumn("is_current", F.col("_n") >= F.coalesce(last, F.lit(0))).drop("_n")


def latest(logs: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    return logs.groupBy(key).agg(*(F.max_by(c, F.struct(*order)).alias(c) for c in columns))


def details(jobs: DataFrame, logs: DataFrame, metrics: DataFrame, issues: DataFrame, key: str = "job_id") -> DataFrame:
    """Each job with its metrics, its logs in order and its issues in order."""
    rows = lambda df, name, order: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in (key, *order))))).alias(name))
    return jobs.join(metrics, key, "left").join(rows(logs, "logs", ["created_at", "id"]), key, "left").join(rows(issues, "issues", ["id"]), key, "left")


def safe_service_url(url: Column, allow_plain: bool = False) -> Column:
    """Whether a service may be called there: http or https, a host, no credentials; plain http only on this machine,
    under ``.test``, or where it is allowed."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    near = place.rlike(r"^(localhost|127\.0\.0\.1|\[::1\])(:[0-9]+)?$") | place.rlike(r"\.test(:[0-9]+)?$")
    return scheme.isin("http", "https") & (place != "") & ~place.contains("@") & ((scheme == "https") | near | F.lit(allow_plain))
