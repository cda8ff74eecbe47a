"""Jobs, glossary and memory as tables in a folder: the surface that a server or a command line calls.

Every table is a folder of whole versions; a change writes the next version and readers take the newest whole one. One
process commits at a time. Lists come back as DataFrames; a missing job or term, and a state that forbids a call, are errors
with the code that a server answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions.text import instruction
from foliograph.operators import quality, report, state, translation
from foliograph.sources import scans, sinks

JOBS = "job_id string, file_name string, file_size bigint, status string, progress int, source_path string, result_path string, pipeline_version string, error_message string, created_at timestamp, updated_at timestamp"
LOGS = "job_id string, id bigint, stage string, level string, message string, progress int, created_at timestamp"
ISSUES = "job_id string, id bigint, stage string, code string, severity string, message string, page_index int, block_id string"
GLOSSARY = "id string, source_text string, target_text string, category string, created_at timestamp, updated_at timestamp"
SNAPSHOT = "job_id string, source_text string, target_text string, category string, rank int"
CANDIDATES = "job_id string, id string, source_text string, target_text string, occurrences bigint, confidence double, status string, created_at timestamp"
METRICS = "job_id string, started_at timestamp, finished_at timestamp, " + ", ".join(f"{c} bigint" for c in state.COUNTERS) + ", token_usage_available boolean"
BATCHES = "job_id string, batch_key string, stage string, page_index int, block_ids array<string>, translations map<string,string>, status string, attempts bigint"
TABLES = {"jobs": JOBS, "logs": LOGS, "issues": ISSUES, "glossary": GLOSSARY, "snapshot": SNAPSHOT, "candidates": CANDIDATES, "metrics": METRICS, "batches": BATCHES}


class Refused(Exception):
    def __init__(self, code: int, why: str):
        super().__init__(why)
        self.code = code


class Service:
    def __init__(self, spark: SparkSession, root: str, version: str, legacy: str = "legacy"):
        self.spark, self.root, self.version, self.legacy = spark, root.rstrip("/"), version, legacy

    # -- tables

    def _versions(self, table: str) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath() for s in fs.listStatus(at)]
        done = [p for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v=")) for p in done)

    def table(self, name: str) -> DataFrame:
        found = self._versions(name)
        if not found:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.parquet(f"{self.root}/{name}/v={found[-1]}")
        empty = self.spark.createDataFrame([], TABLES[name])
        return empty.unionByName(rows, allowMissingColumns=True).select(empty.columns)

    def commit(self, name: str, rows: DataFrame) -> None:
        number = max(self._versions(name), default=0) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v={number}")

    def _add(self, name: str, rows: DataFrame) -> None:
        self.commit(name, self.table(name).unionByName(rows, allowMissingColumns=True).select(self.table(name).columns))

    def _one(self, job_id: str) -> DataFrame:
        job = self.jobs().where(F.col("job_id") == job_id)
        if job.isEmpty():
            raise Refused(404, f"no job {job_id}")
        return job

    # -- jobs

    def jobs(self) -> DataFrame:
        """Newest first, with what may be done with each."""
        j = self.table("jobs")
        flags = state.availability(F.col("status"), F.col("pipeline_version"), self.version, F.col("result_path").isNotNull(), F.col("pipeline_version") == self.legacy)
        j = j.withColumns(flags)
        return scans.newest_first(j.withColumns({"may_reprocess": report.may_reprocess(F.col("status"), F.col("outdated")), "shown_progress": report.shown_progress(F.col("status"), F.col("progress"))}))

    def create(self, files: DataFrame, as_of: str) -> DataFrame:
        """Jobs for uploads (job_id, name, length, content, path): rejected ones come back with their reason, the others are
        queued with the glossary as it is now."""
        checked = scans.uploads(files)
        at = F.lit(as_of).cast("timestamp")
        new = checked.where("reject is null").select("job_id", F.col("name").alias("file_name"), F.col("length").cast("long").alias("file_size"), F.lit("queued").alias("status"), F.lit(0).alias("progress"), F.col("path").alias("source_path"), F.lit(None).cast("string").alias("result_path"), F.lit(self.version).alias("pipeline_version"), F.lit(None).cast("string").alias("error_message"), at.alias("created_at"), at.alias("updated_at"))
        snapshot = translation.glossary_snapshot(new, self.table("glossary"))
        self._add("snapshot", snapshot)
        self._add("metrics", new.select("job_id"))
        self._add("jobs", new)
        self.log(new.select("job_id", F.lit("queued").alias("stage"), F.lit("waiting").alias("message"), F.lit(0).alias("progress")), as_of)
        return checked.where("reject is not null").select("job_id", "reject")

    def log(self, rows: DataFrame, as_of: str, level: str = "info") -> None:
        """Rows (job_id, stage, message, progress); ids go on from the last, in order but with gaps, since the rows of many
        jobs are numbered in many tasks."""
        last = self.table("logs").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        number = F.monotonically_increasing_id() + F.lit(last + 1)
        self._add("logs", rows.orderBy("job_id", "stage").select("job_id", number.cast("long").alias("id"), *state.log_row(F.col("stage"), F.col("message"), F.col("progress")), F.lit(level).alias("level"), F.lit(as_of).cast("timestamp").alias("created_at")))

    def update(self, job_id: str, changes: dict[str, Column]) -> None:
        self._one(job_id)
        mine = F.col("job_id") == job_id
        self.commit("jobs", self.table("jobs").withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in changes.items()}))

    def details(self, job_id: str, as_of: str) -> DataFrame:
        self._one(job_id)
        mine = lambda t: self.table(t).where(F.col("job_id") == job_id)
        metrics = state.durations(mine("metrics"), F.lit(as_of).cast("timestamp"))
        return state.details(self._one(job_id), mine("logs"), metrics, mine("issues"))

    def cancel(self, job_id: str) -> None:
        self.update(job_id, {"status": state.cancel(F.col("status"))})

    def reprocess(self, job_id: str, as_of: str) -> None:
        job = self._one(job_id)
        reset = state.reprocess(job.select(self.table("jobs").columns), self.version)
        if not reset.first().accepted:
            raise Refused(409, "the job is running")
        self.commit("batches", state.batches_after_reprocess(self.table("batches"), reset))
        self.commit("issues", state.replace_issues(self.table("issues"), self.table("issues").limit(0), job))
        self.commit("metrics", state.insert_missing(self.table("metrics").where(F.col("job_id") != job_id), job.select("job_id"), "job_id"))
        self.update(job_id, {"status": F.lit("queued"), "progress": F.lit(0), "pipeline_version": F.lit(self.version), "result_path": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")})
        self.log(job.select("job_id", F.lit("reprocess").alias("stage"), F.lit("again").alias("message"), F.lit(0).alias("progress")), as_of)

    def recover(self, files: DataFrame, legacy_message: str) -> list[str]:
        """After a restart: the ids that are queued again."""
        found = state.recover(self.table("jobs"), files, legacy_message).select(self.table("jobs").columns)
        self.commit("jobs", translation.candidate_upsert(self.table("jobs"), found, ("job_id",)))
        return sorted(r.job_id for r in self.table("jobs").join(found.select("job_id"), "job_id", "left_semi").where("status = 'queued'").collect())

    def finish(self, job_id: str, issues: DataFrame, result_path: str) -> str:
        """Keeps a run's issues (instead of earlier ones) and decides its status."""
        job = self._one(job_id).select("job_id")
        self.commit("issues", state.replace_issues(self.table("issues"), issues.select(self.table("issues").columns), job))
        status = quality.passed(self.table("issues"), job, "job_id").first().status
        self.update(job_id, {"status": F.lit(status), "progress": F.lit(100), "result_path": F.lit(result_path)})
        return status

    def download(self, job_id: str) -> tuple[str, str]:
        """Path and quality of a result."""
        job = self._one(job_id)
        answer = sinks.download(job.withColumn("has_file", F.col("result_path").isNotNull())).first()
        if answer.code != 200:
            raise Refused(answer.code, "there is no result to download")
        return job.first().result_path, answer.quality

    def instruction(self, job_id: str, policy: Column, labels: dict[str, str]) -> str:
        self._one(job_id)
        pairs = self.table("snapshot").where(F.col("job_id") == job_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("source_text").alias("source"), F.col("target_text").alias("target")))), lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"))).alias("g"))
        return pairs.select(instruction(policy, F.col("g"), labels)).first()[0]

    # -- glossary

    def glossary(self) -> DataFrame:
        return self.table("glossary").orderBy(F.desc("updated_at"), F.lower("source_text"))

    def put_terms(self, terms: DataFrame) -> None:
        """Terms (ord, id, source_text, target_text, category, updated_at), one for each source up to ASCII case."""
        self.commit("glossary", translation.glossary_upsert(self.table("glossary"), terms).select(self.table("glossary").columns))

    def delete_term(self, term_id: str) -> None:
        ids = self.spark.createDataFrame([(term_id,)], "id string")
        if not translation.unknown_ids(self.table("glossary"), ids).isEmpty():
            raise Refused(404, f"no term {term_id}")
        self.commit("glossary", translation.glossary_delete(self.table("glossary"), ids))

    def candidates(self, status: str | None = None) -> DataFrame:
        return scans.candidates(self.table("candidates"), status)
