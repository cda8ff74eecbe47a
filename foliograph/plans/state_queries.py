"""Queries over jobs, logs, issues and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import values as v
from foliograph.functions.geometry import Box
from foliograph.operators import documents, external, pixels, quality, report, state, tables
from foliograph.operators.blocks import fit, least_font
from foliograph.plans import bind
from foliograph.plans.bind import query, table
from foliograph.plans.layout_queries import FIT_CTES
from foliograph.sources import scans, sinks

CURRENT, LEGACY = "v3", "legacy"
AS_OF = "2030-01-01 00:00:00"
_ACTIVE = "('queued', 'analyzing', 'segmenting', 'parsing', 'translating', 'repairing', 'rendering', 'validating')"


@query("SELECT l_orderkey AS job_id, CAST(sum(l_quantity::BIGINT) AS BIGINT) AS input_tokens, CAST(sum(greatest(0, l_linenumber - 3)) AS BIGINT) AS output_tokens, bool_or(l_returnflag = 'R') AS token_usage_available FROM lineitem GROUP BY l_orderkey")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_quantity").cast("long").alias("input_tokens"), (F.col("l_linenumber") - 3).alias("output_tokens"), (F.col("l_returnflag") == "R").alias("token_usage_available"))
    return state.accumulate(rows, "job_id", ("input_tokens", "output_tokens"), "token_usage_available")


@query("SELECT l_suppkey AS supplier, CAST(sum(l_linenumber) AS BIGINT) AS input_tokens, CAST(sum(l_quantity::BIGINT) AS BIGINT) AS output_tokens, CAST(sum(l_linenumber + l_quantity::BIGINT) AS BIGINT) AS total_tokens, bool_or(l_returnflag = 'R') AS token_usage_available FROM lineitem GROUP BY l_suppkey")
def token_usage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), n.alias("input_tokens"), q.alias("output_tokens"), (n + q).alias("total_tokens"), (F.col("l_returnflag") == "R").alias("token_usage_available"))
    return documents.sum_usage(rows, ["supplier"])


@query("""
SELECT job_id, min(created_at) FILTER (stage = 'view') AS started_at, CASE WHEN max(created_at) FILTER (stage = 'purchase') >= coalesce(max(created_at) FILTER (stage = 'view'), max(created_at) FILTER (stage = 'purchase')) THEN max(created_at) FILTER (stage = 'purchase') END AS finished_at,
  CAST(coalesce(greatest(0, (epoch_us(coalesce(CASE WHEN max(created_at) FILTER (stage = 'purchase') >= coalesce(max(created_at) FILTER (stage = 'view'), max(created_at) FILTER (stage = 'purchase')) THEN max(created_at) FILTER (stage = 'purchase') END, TIMESTAMP '2030-01-01')) - epoch_us(min(created_at) FILTER (stage = 'view'))) // 1000), 0) AS BIGINT) AS duration_ms
FROM logs GROUP BY job_id""", "logs")
def metrics_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bind.logs(spark, sf_dir).withColumn("kind", F.when(F.col("stage") == "view", "start").when(F.col("stage") == "purchase", "finish"))
    runs = state.started_and_finished(e, "job_id", "created_at", "kind")
    return state.durations(runs, F.lit(AS_OF).cast("timestamp_ntz"))


@query("""
, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, id) AS n FROM logs)
SELECT job_id, id, n >= coalesce(max(CASE WHEN stage = 'error' THEN n END) OVER (PARTITION BY job_id), 0) AS is_current FROM n""", "logs")
def log_current_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_run(bind.logs(spark, sf_dir), "job_id", ["created_at", "id"], F.col("stage") == "error").select("job_id", "id", "is_current")


@query("SELECT job_id, arg_max(stage, (created_at, id)) AS stage, arg_max(value, (created_at, id)) AS value FROM logs GROUP BY job_id", "logs")
def log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(bind.logs(spark, sf_dir), "job_id", ["created_at", "id"], ["stage", "value"])


@query("SELECT job_id, id, left(stage, 64) AS stage, left(trim('  ' || props || ' '), 1000) AS message, greatest(0, least(100, id % 300 - 50)) AS progress FROM logs", "logs")
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = state.log_row(F.col("stage"), F.concat(F.lit("  "), "props", F.lit(" ")), F.col("id") % 300 - 50)
    return bind.logs(spark, sf_dir).select("job_id", "id", *cols)


_FLAGS = """status IN ('completed', 'needs_review') AND pipeline_version = 'v3' AND has_file AS available,
  has_file AND ((status = 'completed' AND pipeline_version = 'v3') OR (status = 'needs_review' AND pipeline_version <> 'legacy')) AS downloadable, status = 'completed' AND pipeline_version <> 'v3' AS outdated"""


def _flags() -> dict:
    return state.availability(F.col("status"), F.col("pipeline_version"), CURRENT, F.col("has_file"), F.col("pipeline_version") == LEGACY)


@query(f", f AS (SELECT *, {_FLAGS} FROM jobs) SELECT job_id, available, downloadable, outdated, outdated OR status IN ('needs_review', 'failed', 'cancelled') AS again, CASE WHEN status = 'needs_review' THEN 100 ELSE progress END AS shown FROM f", "jobs")
def job_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = bind.jobs(spark, sf_dir).withColumns(_flags())
    return j.select("job_id", "available", "downloadable", "outdated", report.may_reprocess(F.col("status"), F.col("outdated")).alias("again"), report.shown_progress(F.col("status"), F.col("progress")).alias("shown"))


@query(f", f AS (SELECT *, {_FLAGS} FROM jobs) SELECT job_id, CASE WHEN downloadable THEN 200 ELSE 409 END AS code, CASE WHEN downloadable THEN CASE WHEN status = 'completed' THEN 'passed' ELSE 'review-recommended' END END AS quality FROM f", "jobs")
def job_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.download(bind.jobs(spark, sf_dir).withColumns(_flags()))


@query(f", f AS (SELECT *, {_FLAGS} FROM jobs) SELECT count(*) AS total, count(*) FILTER (status IN {_ACTIVE}) AS active, count(*) FILTER (available) AS available FROM f", "jobs")
def kpi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.kpis(bind.jobs(spark, sf_dir), _flags()["available"])


@query("SELECT job_id, file_name FROM jobs WHERE contains(lower(file_name), 'urgent 1') OR contains(lower(pipeline_version), 'urgent 1')", "jobs")
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.search(bind.jobs(spark, sf_dir), " URGENT 1 ", ["file_name", "pipeline_version"]).select("job_id", "file_name")


@query("SELECT job_id, row_number() OVER (ORDER BY created_at DESC, job_id) AS place FROM jobs", "jobs")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.placed(bind.jobs(spark, sf_dir).select("job_id", "created_at")).select("job_id", "place")


@query("SELECT job_id, status FROM jobs WHERE status = 'failed'", "jobs")
def candidates_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.candidates(bind.jobs(spark, sf_dir).withColumn("id", F.col("job_id")), "failed").select("job_id", "status")


@query(f"""
SELECT job_id, CASE WHEN job_id % 1000 % 7 <> 0 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN job_id % 1000 % 7 <> 0 THEN 0 ELSE progress END AS progress, CASE WHEN job_id % 1000 % 7 = 0 THEN 'the source file is missing' END AS error_message
FROM jobs WHERE status IN {_ACTIVE} OR (status = 'failed' AND error_message = 'old failure')""", "jobs")
def recover_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.range(1000).select(F.concat(F.lit("in/"), F.col("id").cast("string")).alias("path"), (F.col("id") % 7 != 0).alias("exists"))
    return state.recover(bind.jobs(spark, sf_dir), files, "old failure").select("job_id", "status", "progress", "error_message")


@query(f"SELECT job_id, status NOT IN {_ACTIVE} AS accepted, status NOT IN {_ACTIVE} AND pipeline_version <> 'v3' AS drop_batches, CASE WHEN status IN {_ACTIVE} THEN status ELSE 'queued' END AS status, CASE WHEN status IN {_ACTIVE} THEN progress ELSE 0 END AS progress FROM jobs", "jobs")
def reprocess_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.reprocess(bind.jobs(spark, sf_dir), CURRENT).select("job_id", "accepted", "drop_batches", "status", "progress")


@query(f"SELECT l_orderkey AS job_id, l_linenumber FROM lineitem JOIN jobs ON job_id = l_orderkey WHERE NOT (status NOT IN {_ACTIVE} AND pipeline_version <> 'v3')", "jobs")
def batches_after_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    return state.batches_after_reprocess(batches, state.reprocess(bind.jobs(spark, sf_dir), CURRENT))


@query("SELECT job_id, CASE WHEN status IN ('completed', 'needs_review', 'failed', 'cancelled') THEN status ELSE 'cancelled' END AS status, 'legacy/' || job_id || '-' || strftime(created_at, '%Y%m%dT%H%M%SZ') || '.pdf' AS archived FROM jobs", "jobs")
def job_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.jobs(spark, sf_dir).select("job_id", state.cancel(F.col("status")).alias("status"), v.archive_name(F.col("job_id").cast("string"), F.col("created_at")).alias("archived"))


@query("SELECT job_id, arg_max(stage, (created_at, id)) AS stage, arg_max(value, (created_at, id)) FILTER (stage <> 'error') AS value FROM logs GROUP BY job_id", "logs")
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bind.logs(spark, sf_dir).withColumn("value", F.when(F.col("stage") != "error", F.col("value")))
    return state.newest(e, ["job_id"], ["created_at", "id"], ["stage"], ["value"])


@query("SELECT job_id, coalesce(error_message, 'none') AS error_message, 0 AS retries FROM jobs", "jobs")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.with_new_columns(bind.jobs(spark, sf_dir).select("job_id", "error_message"), {"error_message": F.lit("none"), "retries": F.lit(0)})


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS batches FROM orders")
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("batches"))
    return state.insert_missing(o.where("job_id % 3 = 0"), o.select("job_id", F.lit(0).cast("long").alias("batches")), "job_id")


@query("SELECT job_id, CASE WHEN pipeline_version = 'legacy' AND job_id % 4 <> 0 THEN 'v3' ELSE pipeline_version END AS pipeline_version FROM jobs", "jobs")
def backfill_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = bind.jobs(spark, sf_dir)
    metrics = j.select("job_id", (F.col("job_id") % 4).alias("validation_ms"), F.lit(1).alias("batches"))
    return state.backfill_version(j, metrics, CURRENT, LEGACY).select("job_id", "pipeline_version")


@query("SELECT doc_id AS job_id, code, 'kept' AS origin FROM issues WHERE doc_id % 4 > 1 UNION ALL SELECT doc_id, 'c-new', 'new' FROM issues WHERE doc_id % 4 = 0", "issues")
def replace_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = bind.issues(spark, sf_dir).withColumnRenamed("doc_id", "job_id")
    new = i.where("job_id % 4 = 0").select("job_id", F.lit("c-new").alias("code"), F.lit("new").alias("origin"))
    return state.replace_issues(i.select("job_id", "code", F.lit("kept").alias("origin")), new, i.where("job_id % 4 < 2"))


@query("""
, s AS (SELECT l_orderkey AS job_id, l_partkey % 3 AS batch, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, 'b' || (l_suppkey % 4) AS k, 'v' || l_linenumber AS val, l_linenumber % 2 AS attempts, l_quantity::BIGINT AS input_tokens, l_returnflag = 'R' AS flag, l_linestatus AS status FROM lineitem),
m AS (SELECT job_id, batch, k, arg_max(val, ord) AS val FROM s GROUP BY ALL)
SELECT s.job_id, s.batch, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, bool_or(flag) AS token_usage_available, arg_max(status, ord) AS status,
  (SELECT string_agg(k || '=' || val, ',' ORDER BY k) FROM m WHERE m.job_id = s.job_id AND m.batch = s.batch) AS translations FROM s GROUP BY s.job_id, s.batch""")
def batch_progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    saves = l.select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") % 3).alias("batch"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), F.create_map(F.concat(F.lit("b"), (F.col("l_suppkey") % 4).cast("string")), F.concat(F.lit("v"), F.col("l_linenumber").cast("string"))).alias("translations"),
        (F.col("l_linenumber") % 2).alias("attempts"), F.col("l_quantity").cast("long").alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0).alias("total_tokens"), (F.col("l_returnflag") == "R").alias("token_usage_available"), F.col("l_linestatus").alias("status"), F.lit(None).cast("string").alias("error_message"),
    )
    m = state.merge_batch_progress(saves, ["job_id", "batch"], ["ord"])
    shown = F.array_join(F.transform(F.map_entries("translations"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("job_id", "batch", "attempts", "input_tokens", "token_usage_available", "status", shown.alias("translations"))


@query("SELECT l_orderkey AS job_id, bool_and(l_linestatus = 'F') AND bool_and(l_linenumber % 5 <> 0) AS complete FROM lineitem GROUP BY l_orderkey")
def batch_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.collect_set(n).alias("block_ids"), F.min(F.when(F.col("l_linestatus") == "F", "completed").otherwise("a running")).alias("status"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("l_linenumber") % 5 != 0, F.struct(n.alias("k"), F.lit("x").alias("v")))))).alias("translations"),
    )
    return state.resumable(b).select("job_id", "complete")


@query("""
, p AS (SELECT doc_id, severity, code, message, list_sort(list(DISTINCT page_index + 1)) AS pages, list(block_id ORDER BY id)[1:5] AS blocks, count(*) AS count FROM issues GROUP BY ALL)
SELECT doc_id, severity, code, message, array_to_string(pages, ',') AS pages, array_to_string(blocks, ',') AS blocks, count FROM p""", "issues")
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report.issue_rollup(bind.issues(spark, sf_dir), ["doc_id"])
    return r.select("doc_id", "severity", "code", "message", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("blocks", ",").alias("blocks"), "count")


@query("SELECT d.doc_id, count(i.id) AS issues, count(i.id) FILTER (severity = 'error') AS errors, count(i.id) FILTER (severity = 'error') = 0 AS passed, CASE WHEN count(i.id) FILTER (severity = 'error') = 0 THEN 'completed' ELSE 'needs_review' END AS status FROM documents d LEFT JOIN issues i USING (doc_id) GROUP BY d.doc_id", "issues")
def job_quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.passed(bind.issues(spark, sf_dir), table(spark, sf_dir, "documents"))


@query(FIT_CTES + """
, o AS (SELECT doc_id, 'text_overflow' AS code, page_index, id FROM fitted WHERE overflow),
m AS (SELECT doc_id, 'unsafe_mask_geometry' AS code, page_index, id FROM blocks WHERE (x1 - x0) * (bottom - top) / (612.0::DOUBLE * 792) >= 0.05 AND geometry_fill_ratio < 0.35),
u AS (SELECT doc_id, 'unstable_source_fragment' AS code, page_index, id FROM blocks WHERE preserve_reason IS NOT NULL AND preserve_reason <> 'chart name'),
c AS (SELECT doc_id, 'coarse_native_text_block' AS code, page_index, id FROM parsed WHERE region_type <> 'table' AND length(source_text) - length(replace(source_text, chr(10), '')) >= 3 AND bottom - top >= 36)
SELECT doc_id, 'validation' AS stage, code, CASE WHEN code = 'unstable_source_fragment' THEN 'warning' ELSE 'error' END AS severity, page_index, id AS block_id FROM (FROM o UNION ALL FROM m UNION ALL FROM u UNION ALL FROM c)""", "blocks", "parsed")
def quality_issue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bind.blocks(spark, sf_dir)
    overflow = b.where(fit(F.col("source_text"), Box.flat(), F.col("font_size"), least_font(F.col("source_type"), F.col("region_type")))["overflow"])
    coarse = bind.parsed(spark, sf_dir).withColumns({"source_type": F.lit("native"), "font_size": F.lit(12.0)})
    every = quality.union_issues(quality.text_overflow(overflow, b), quality.unsafe_masks(b, b.select("doc_id", "id")), quality.unstable_fragments(b, "chart name"), quality.coarse_native_blocks(coarse, coarse.select("doc_id", "id")))
    return quality.stored_issues(every).select("doc_id", "stage", "code", "severity", "page_index", "block_id")


@query("SELECT doc_id, 'incomplete_page_review' AS code FROM documents WHERE doc_id % 3 = 1 AND doc_id IN (SELECT doc_id FROM pages_)", "pages_")
def review_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bind.blocks(spark, sf_dir).select("doc_id", "page_index").distinct()
    asked = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    seen = pages.where("doc_id % 3 <> 1 or page_index <> 0")
    return quality.review_gaps(asked, seen).select("doc_id", "code")


@query("SELECT doc_id, code, page_index FROM (SELECT doc_id, page_index, unnest(list_filter([CASE WHEN doc_id % 10 / 1000.0::DOUBLE > 0.002::DOUBLE THEN 'non_text_content_changed' END, CASE WHEN page_index % 2 = 1 THEN 'graphical_content_erased' END], lambda x: x IS NOT NULL)) AS code FROM pages_)", "pages_")
def pixel_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bind.blocks(spark, sf_dir).select("doc_id", "page_index").distinct()
    rows = pages.select("doc_id", "page_index", (F.col("doc_id") % 10 / 1000.0).alias("change"), F.when(F.col("page_index") % 2 == 1, 0.04).otherwise(0.0).alias("color_loss"), F.lit(0.0).alias("dark_loss"))
    return quality.pixel_issues(rows).select("doc_id", "code", "page_index")


@query("SELECT job_id, CASE WHEN status = 'failed' AND NOT has_file THEN 'failed' WHEN status = 'failed' OR progress % 3 > 0 THEN 'needs_review' ELSE 'completed' END AS status FROM jobs", "jobs")
def status_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.jobs(spark, sf_dir).select("job_id", quality.status_after(F.col("status") == "failed", F.col("has_file"), F.col("progress") % 3).alias("status"))


@query("SELECT doc_id, array_to_string(list(block_id ORDER BY id)[1:10], ', ') AS texts, count(*) AS count FROM issues GROUP BY doc_id", "issues")
def top_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_texts(bind.issues(spark, sf_dir), ["doc_id"], "id", "block_id")


@query("""
, f AS (SELECT o_custkey AS selection, o_orderkey AS ord, 'n' || (o_orderkey % 40) || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.PDF' END AS name, CASE WHEN o_orderkey % 11 = 0 THEN 300000000 ELSE 1000 END AS size, o_orderkey % 3 AS mtime FROM orders),
k AS (SELECT *, CASE WHEN NOT lower(name) LIKE '%.pdf' THEN 'not_pdf' WHEN size > 209715200 THEN 'too_large' END AS kind FROM f),
d AS (SELECT *, coalesce(kind, CASE WHEN row_number() OVER (PARTITION BY selection, kind IS NULL, name, size, mtime ORDER BY ord) > 1 THEN 'duplicate' END) AS k2 FROM k)
SELECT selection, ord, coalesce(k2, CASE WHEN sum(CASE WHEN k2 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY selection ORDER BY ord ROWS UNBOUNDED PRECEDING) > 10 THEN 'too_many' END) AS reason FROM d""")
def file_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("selection"), k.alias("ord"), F.concat(F.lit("n"), (k % 40).cast("string"), F.when(k % 7 == 0, ".txt").otherwise(".PDF")).alias("name"), F.when(k % 11 == 0, 300000000).otherwise(1000).alias("size"), (k % 3).alias("mtime"))
    return report.intake(files, most_files=10).select("selection", "ord", "reason")


@query("SELECT o_custkey AS archive, arg_min(name, (length(name), name)) AS name FROM (SELECT o_custkey, left('aaaaaaaaaa', (o_orderkey % 9 + 1)::INT) || CASE WHEN o_orderkey % 4 = 0 THEN '_content_list_v2.json' WHEN o_orderkey % 4 = 1 THEN '.md' ELSE '_content_list.json' END AS name FROM orders) WHERE name LIKE '%_content_list.json' GROUP BY o_custkey")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.left(F.lit("aaaaaaaaaa"), (k % 9 + 1).cast("int")), F.when(k % 4 == 0, "_content_list_v2.json").when(k % 4 == 1, ".md").otherwise("_content_list.json"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), name.alias("name"))
    return scans.archive_members(rows, "archive", "name", "_content_list.json", "_content_list_v2.json")


@query("""
SELECT event_id, CASE WHEN value < 1024 THEN printf('%d B', CAST(trunc(value) AS BIGINT)) ELSE printf('%.1f KB', value / 1024) END AS size, strftime(ts, '%Y-%m-%d %H:%M') AS shown, CASE event_type WHEN 'view' THEN 'Seen' WHEN 'error' THEN 'Failed' ELSE event_type END AS label FROM events""")
def labels_and_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", v.human_bytes(F.col("value")).alias("size"), v.shown_minute(F.col("ts")).alias("shown"), v.labelled(F.col("event_type"), {"view": "Seen", "error": "Failed"}).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 200000 < 1000 THEN printf('%d ms', event_id % 200000) WHEN event_id % 200000 < 60000 THEN printf('%.2f s', (event_id % 200000) / 1000.0::DOUBLE) ELSE printf('%d min %d s', (event_id % 200000) // 60000, (event_id % 200000) % 60000 // 1000) END AS took FROM (SELECT event_id * 40 AS event_id FROM events)")
def shown_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * 40
    return table(spark, sf_dir, "events").select(n.alias("event_id"), v.human_ms(n % 200000).alias("took"))


@query("""
SELECT job_id, CASE WHEN status = 'completed' AND pipeline_version <> 'v3' THEN 'older version' WHEN status = 'completed' THEN 'done' WHEN status = 'needs_review' THEN 'look again' WHEN status IN ('failed', 'cancelled') THEN coalesce(error_message, 'stopped') ELSE 'step ' || progress END AS outcome,
       CASE WHEN status = 'needs_review' AND (job_id % 8 = 0 OR coalesce(regexp_matches(error_message, '^no'), false)) THEN 'please check' ELSE error_message END AS message FROM jobs""", "jobs")
def outcome_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"outdated": "older version", "completed": "done", "needs_review": "look again", "failed": "stopped"}
    j = bind.jobs(spark, sf_dir)
    shown = report.outcome(F.col("status"), _flags()["outdated"], F.col("error_message"), F.concat(F.lit("step "), F.col("progress").cast("string")), texts)
    stage = F.when(F.col("job_id") % 8 == 0, "needs-review").otherwise("render")
    return j.select("job_id", shown.alias("outcome"), report.customer_message(F.col("status"), stage, F.col("error_message"), "^no", "please check").alias("message"))


@query("SELECT j.job_id, count(DISTINCT l.id) AS logs, count(DISTINCT i.id) AS issues, m.input_tokens FROM jobs j LEFT JOIN logs l USING (job_id) LEFT JOIN issues i ON i.doc_id = j.job_id LEFT JOIN (SELECT l_orderkey AS job_id, CAST(sum(l_quantity::BIGINT) AS BIGINT) AS input_tokens FROM lineitem GROUP BY 1) m ON m.job_id = j.job_id GROUP BY ALL", "jobs", "logs", "issues")
def job_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = metrics_rollup(spark, sf_dir).select("job_id", "input_tokens")
    issues = bind.issues(spark, sf_dir).withColumnRenamed("doc_id", "job_id")
    d = state.details(bind.jobs(spark, sf_dir), bind.logs(spark, sf_dir).select("job_id", "id", "created_at", "stage"), metrics, issues)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return d.select("job_id", F.when(F.col("logs").isNull(), 0).otherwise(n("logs")).cast("long").alias("logs"), F.when(F.col("issues").isNull(), 0).otherwise(n("issues")).cast("long").alias("issues"), "input_tokens")


@query(r"""
, u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'http://localhost:8080/x' WHEN 2 THEN 'https://user:pw@host/x' WHEN 3 THEN 'ftp://host/x' ELSE 'http://svc.test' END AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth FROM u)
SELECT page_id, scheme IN ('http', 'https') AND auth <> '' AND NOT contains(auth, '@') AND (scheme = 'https' OR regexp_matches(lower(auth), '^(localhost|127\.0\.0\.1|\[::1\])(:[0-9]+)?$') OR regexp_matches(lower(auth), '\.test(:[0-9]+)?$')) AS allowed FROM p""")
def service_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.col("url")).when(k == 1, "http://localhost:8080/x").when(k == 2, "https://user:pw@host/x").when(k == 3, "ftp://host/x").otherwise("http://svc.test")
    return table(spark, sf_dir, "pages").select("page_id", state.safe_service_url(url).alias("allowed"))


@query("SELECT doc_id, count(*) FILTER (o = 0) AS replaced, count(*) FILTER (o = 1) AS missing, count(*) FILTER (o = 2) AS overflow, 0::BIGINT AS unchanged, count(*) FILTER (o = 3) AS preserved FROM (SELECT doc_id, pos % 4 AS o FROM lines) GROUP BY doc_id", "lines")
def render_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = bind.pick(["replaced", "missing", "overflow", "preserved"], F.col("pos") % 4)
    return documents.render_counts(bind.lines(spark, sf_dir).withColumn("outcome", kind))


@query(r"""
, said AS (SELECT *, CASE WHEN pos % 4 = 2 THEN '  ' || source_text ELSE 'other &amp; &#8211; &eacute;' END AS raw FROM blocks),
read AS (SELECT *, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]+>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#8211;', '–'), '&eacute;', 'é'), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS l FROM said)
SELECT doc_id, id, CASE WHEN preserve_reason IS NOT NULL OR fragment_confidence < 0.55 THEN 'preserved' WHEN pos % 4 = 1 OR len(l) = 0 THEN 'missing' WHEN array_to_string(l, chr(10)) = trim(regexp_replace(source_text, '[ \t]+', ' ', 'g')) THEN 'unchanged' WHEN source_type = 'native' THEN 'redact' ELSE 'mask' END AS outcome,
  CASE WHEN pos % 4 = 1 THEN '' ELSE array_to_string(l, chr(10)) END AS text FROM read""", "blocks")
def drawing_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bind.blocks(spark, sf_dir).withColumns({"font_weight": F.lit(400), "alignment": F.lit("left")})
    k = F.col("pos") % 4
    said = b.where("pos % 4 <> 1").select("doc_id", "id", F.when(k == 2, F.concat(F.lit("  "), "source_text")).otherwise("other &amp; &#8211; &eacute;").alias("target_text"))
    return sinks.drawing_outcome(b, said).select("doc_id", "id", "outcome", "text")


@query("SELECT doc_id, CAST(page_index AS INT) AS page_index, printf('p%04d-full', page_index + 1) AS id, 612.0::DOUBLE AS x1, 792.0::DOUBLE AS bottom FROM (SELECT doc_id, unnest(range(0, 1 + doc_id % 3)) AS page_index FROM documents)")
def full_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.struct(F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_repeat(size, (1 + F.col("doc_id") % 3).cast("int")).alias("page_sizes"))
    return scans.full_pages(docs).select("doc_id", "page_index", "id", "x1", "bottom")


@query("SELECT doc_id, page_index, printf('p%04d-i%04d', page_index + 1, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY ord)) AS id, x0, top FROM regions WHERE x1 - x0 >= 80 AND bottom - top >= 40 AND (x1 - x0) * (bottom - top) / (612.0::DOUBLE * 792) >= 0.01", "regions")
def embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bind.regions(spark, sf_dir)
    pages = r.select("doc_id", "page_index", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()
    return scans.image_regions(r.drop("id"), pages).select("doc_id", "page_index", "id", "x0", "top")


@query("""
SELECT doc_id, page_index, id, 'T' || length(source_text) AS target_text FROM blocks""", "blocks")
def translated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as one batch through a translator that is a plain function here."""
    b = bind.blocks(spark, sf_dir).select("doc_id", "page_index", "id", "reading_order", "source_text")
    translate = lambda items: ({i["id"]: f"T{len(i['text'])}" for i in items}, {})
    return external.translate_batches(b, ["doc_id", "page_index"], translate).select("doc_id", "page_index", "id", "target_text")


def _table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each region: a header over two columns, a row for each nation, the first cell over all of them; among
    them rows without cells, a cell that never ends and paragraphs."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    cell = F.transform("names", lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>")))
    first = F.concat(F.lit("<tr><td rowspan='"), F.size("names").cast("string"), F.lit("'>"), "r_name", F.lit("</td>"), F.array_join(cell, "</tr><tr>"), F.lit("</tr>"))
    return rows.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", F.concat(F.lit("<TABLE><tr></tr><tr><th colspan=2>Places &amp; <p>more</p></th><td>never ends</tr><tr> </tr>"), first, F.lit("<tr></tr></TABLE>")).alias("html"))


@query("""
, n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)
SELECT r_regionkey, 0 AS "row", 0 AS "column", 1 AS row_span, 2 AS column_span, 'Places & more' AS source_text, true AS is_header FROM region
UNION ALL SELECT DISTINCT r_regionkey, 1, 0, CAST(c AS INT), 1, r_name, false FROM n JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_regionkey, CAST(r AS INT), 1, 1, 1, n_name, false FROM n""")
def html_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    _table_html(spark, sf_dir).createOrReplaceTempView("_tables")
    return spark.sql("SELECT r_regionkey, c.row, c.column, c.row_span, c.column_span, c.source_text, c.is_header FROM _tables t, LATERAL table_cells(t.html) c")


@query("""
, p AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 256)::INT AS r0, (l_suppkey * 13 % 256)::INT AS g0, (l_linenumber * 31 % 256)::INT AS b0, (l_partkey * 11 % 256)::INT AS r1, (l_suppkey * 17 % 256)::INT AS g1, (l_linenumber * 29 % 256)::INT AS b1 FROM lineitem),
l AS (SELECT *, (19595 * r0 + 38470 * g0 + 7471 * b0 + 32768) >> 16 AS y0, (19595 * r1 + 38470 * g1 + 7471 * b1 + 32768) >> 16 AS y1, greatest(r0, g0, b0) AS m, least(r0, g0, b0) AS n FROM p)
SELECT l_orderkey, count(*) FILTER (CASE WHEN m > 0 THEN floor((m - n) * 255 / m) ELSE 0 END >= 45 AND y1 - y0 > 30)::DOUBLE / count(*) AS color_loss, count(*) FILTER (y0 < 130 AND y1 - y0 > 60)::DOUBLE / count(*) AS dark_loss FROM l GROUP BY l_orderkey""")
def exploded_pixel_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    channel = lambda c, k, name: (c * k % 256).cast("int").alias(name)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", channel(p, 7, "r0"), channel(s, 13, "g0"), channel(n, 31, "b0"), channel(p, 11, "r1"), channel(s, 17, "g1"), channel(n, 29, "b1"))
    return pixels.exploded_loss(rows, ["l_orderkey"])


@query("""
, g AS (SELECT n_nationkey, CAST(2 + n_nationkey % 4 AS INT) AS c, CAST(2 + n_nationkey % 3 AS INT) AS r FROM nation)
SELECT n_nationkey, c AS columns, r AS rows, round_even(least((40 * r + 1) / (40 * r + 21)::DOUBLE, (50 * c + 1) / (50 * c + 21)::DOUBLE), 6) AS score FROM g""")
def grid_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid lines found in drawn images with a margin and a speck in each cell: a column and row count for each nation."""

    def measure(r) -> dict:
        import numpy as np

        columns, rows = 2 + r.n_nationkey % 4, 2 + r.n_nationkey % 3
        high, wide = 40 * rows, 50 * columns
        image = np.full((high + 21, wide + 21, 3), 255, np.uint8)
        for y in range(28, high + 10, 40):
            for x in range(30, wide + 10, 50):
                image[y : y + 3, x : x + 4] = 60
        image[10 : high + 11 : 40, 10 : wide + 11] = 0
        image[10 : high + 11, 10 : wide + 11 : 50] = 0
        xs, sx = pixels.axis_boundaries(image, True, columns)
        ys, sy = pixels.axis_boundaries(image, False, rows)
        return {"n_nationkey": int(r.n_nationkey), "columns": len(xs) - 1, "rows": len(ys) - 1, "score": round(min(sx, sy), 6)}

    return pixels.per_image(table(spark, sf_dir, "nation").select("n_nationkey"), measure, "n_nationkey int, columns int, rows int, score double")


#: Of a drawn page's 30 changed columns 19 lie in the padded block of odd pages.
_DRAWN = "SELECT n_nationkey // 2 AS doc_id, CAST(n_nationkey % 2 AS INT) AS page_index, (n_nationkey % 11) * CASE WHEN n_nationkey % 2 = 1 THEN 11 ELSE 30 END / 4800.0::DOUBLE AS change, (n_nationkey % 11) * 30 / 4800.0::DOUBLE AS color_loss, (n_nationkey % 11) * 30 / 4800.0::DOUBLE AS dark_loss FROM nation"


@query(_DRAWN)
def page_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change and loss of small drawn pages, two a document, with faint noise and, on odd pages, a block over part of the
    change."""
    import pandas as pd

    def draw(parts):
        import numpy as np

        for part in parts:
            out = []
            for k in part["n_nationkey"]:
                before = np.full((60, 80, 3), 240, np.uint8)
                before[10:20, 10:40] = (200, 30, 30)
                after = before + np.random.default_rng(int(k)).integers(0, 8, before.shape, np.uint8)
                after[10 : 10 + k % 11, 10:40] = 255
                blocks = [{"x0": 10.0, "top": 10.0, "x1": 24.0, "bottom": 20.0, "source_type": "native"}] if k % 2 else []
                out.append((int(k) // 2, int(k) % 2, 80, 60, 80, 60, before.tobytes(), after.tobytes(), 80.0, 60.0, blocks))
            yield pd.DataFrame(out, columns=["doc_id", "page_index", "width", "height", "after_width", "after_height", "before", "after", "page_width", "page_height", "blocks"])

    schema = "doc_id int, page_index int, width int, height int, after_width int, after_height int, before binary, after binary, page_width double, page_height double, blocks array<struct<x0:double,top:double,x1:double,bottom:double,source_type:string>>"
    return pixels.page_differences(table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(draw, schema))


@query(f"SELECT doc_id, max(change) AS change, max(color_loss) AS color_loss, max(dark_loss) AS dark_loss, count(*) AS pages FROM ({_DRAWN}) GROUP BY doc_id")
def most_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.most_change(page_differences(spark, sf_dir))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts of a stream, over the table at once: the same plan without a source that grows."""
    from foliograph.streaming.jobs import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "events")
