"""The Spark session this library is tested with."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(name: str = "quillon", cpus: str | int | None = None, **conf: object) -> SparkSession:
    """A local session with the settings the operators rely on: UTC, ANSI, AQE.

    On a cluster pass your own session instead; no operator needs this one.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()


#: Bytes of an Arrow batch, where the session has Spark's default: long rows would else make batches of 64 MB, held in the JVM and in Python at once.
BATCH_SETTING, DEFAULT_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context, and bounds the session's Arrow batches unless it sets its own bound.

    No more is needed where the executors can import the package already.
    """
    if spark.conf.get(BATCH_SETTING, None) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, BATCH)
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._quillon_shipped = True
