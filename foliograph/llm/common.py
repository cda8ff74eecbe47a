"""What the operators of this subpackage share: tables, words, written stages, Arrow rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array (null or blank text: empty array)."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_CLASS + "+"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this session: ``spark.checkpoint.dir``, or an own folder where it is unset and everything runs
    on this machine. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="foliograph-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here and
    a lost executor costs only a new read. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df_paths: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete written stages (all of this process where none are named)."""
    for spark, path in list(_written if df_paths is None else df_paths):
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
            pass
    if df_paths is None:
        _written.clear()


atexit.register(drop_written)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``most_bytes`` of a column, or one row."""
    size = 0
    start = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)
