"""What a query needs of its session before it runs Python on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, where the session has Spark's own setting: two of them and their copies fit beside a small heap.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's executors, once an application: they need no copy of the repository. Sets the
    session's bound on Arrow batches, unless it was set already."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="foliograph-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "foliograph.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
