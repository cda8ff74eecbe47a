"""Job events as a stream: newest state by key, counts by time, and a status machine.

The batch operators say what a state is; the stream keeps it up as files of events arrive. Every query is meant for
``trigger(availableNow=True)`` or a continuous run with a checkpoint in shared storage, and repeats safely."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliograph.operators.state import TERMINAL

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Events and values by type and tumbling window; rows later than the watermark no longer count. ``late`` None: the
    events have a watermark already."""
    return (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def status_machine(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Each key's status after every batch: events move it on, an end state stays until a restart (``error`` here)."""
    out = f"{key} bigint, status string, events bigint, restarts bigint"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, events_, restarts = state.get if state.exists else ("queued", 0, 0)
        for rows in parts:
            for kind in rows.sort_values(["ts", "event_id"])["event_type"]:
                events_ += 1
                if kind == "error":
                    status, restarts = "queued", restarts + 1
                elif status not in TERMINAL:
                    status = kind
        state.update((status, events_, restarts))
        yield pd.DataFrame({key: [k[0]], "status": [status], "events": [events_], "restarts": [restarts]})

    return events.groupBy(key).applyInPandasWithState(step, out, "status string, events bigint, restarts bigint", "update", GroupStateTimeout.NoTimeout)


def keep_newest(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str]):
    """Keeps a table of the newest row for each key: every batch writes its own part, named by the batch, so that a
    repeated batch overwrites itself; ``read_newest`` settles the parts."""

    def save(batch: DataFrame, number: int) -> None:
        from foliograph.operators.state import newest

        rest = [c for c in batch.columns if c not in key]
        newest(batch, key, order, rest, []).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_newest(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    from foliograph.operators.state import newest

    rows = spark.read.parquet(path).drop("batch")
    return newest(rows, key, order, [c for c in rows.columns if c not in key], [])


def settle_newest(spark: SparkSession, path: str, key: list[str], order: list[str]) -> None:
    """Makes one part of all but the last: what ``read_newest`` reads follows the number of keys and not that of batches.
    The last may be written again after a failure, so it stays as it is; a run that breaks off leaves rows twice, which
    settle to the same."""
    from foliograph.operators.state import newest

    parts = sorted(r.batch for r in spark.read.parquet(path).select("batch").distinct().collect())[:-1]
    if len(parts) < 2:
        return
    rows = spark.read.parquet(path).where(F.col("batch") <= parts[-1]).drop("batch")
    newest(rows, key, order, [c for c in rows.columns if c not in key], []).checkpoint().write.mode("overwrite").parquet(f"{path}/batch={parts[-1]}")
    for n in parts[:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
