"""Logs as streams: replay with last-wins state, and live tallies."""

from __future__ import annotations

import json
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: The file that names the current version of a table.
POINTER = "_CURRENT"


def progress(events: DataFrame) -> DataFrame:
    """(dimension, done, scored, correct, updated_at); the same plan over a table or a stream."""
    return events.groupBy(F.col("event_type").alias("dimension")).agg(
        F.count("*").alias("done"), F.count("value").alias("scored"), F.count(F.when(F.col("value") >= 10, 1)).alias("correct"), F.max("ts").alias("updated_at")
    )


def watch(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the tallies of a stream in the memory table ``name``."""
    return progress(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: events by type and hour, with late events up to ``late``."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def publish(df: DataFrame, path: str, version: str, keep: int = 2) -> None:
    """Writes a version of a table and makes it the current one in one rename."""
    publish_all({"": df}, path, version, keep)


def publish_all(tables: Mapping[str, DataFrame], path: str, version: str, keep: int = 2, by: Sequence[str] = ()) -> None:
    """Writes a version of several tables (by name below the version) and makes them current together, in one rename.

    The pointer file is replaced, not deleted, so a reader finds the old
    version or the new one, and a crash before the rename changes nothing.  Each
    attempt has a folder of its own, so one that is repeated does not touch what
    the pointer names.  Versions before the ``keep`` last ones are deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = f"{version}-{time.time_ns():020d}"
    for name, df in tables.items():
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{path}/{attempt}/{name}".rstrip("/"))
    put_text(spark, f"{path}/{POINTER}", attempt)
    _remove_old(spark, path, attempt, keep)


def _remove_old(spark: SparkSession, path: str, newest: str, keep: int) -> None:
    """Deletes the folders of published versions but the newest and the ``keep`` before it, by the time in their names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()]
    versions = sorted((n for n in folders if re.fullmatch(r".*-\d{20}", n) and n[-20:] < newest[-20:]), key=lambda n: n[-20:])
    for name in versions[: max(0, len(versions) - keep)]:
        fs.delete(hadoop.Path(f"{path}/{name}"), True)


def current(spark: SparkSession, path: str, name: str = "") -> DataFrame | None:
    """The current version (of the table ``name``), or None before the first."""
    version = get_text(spark, f"{path}/{POINTER}")
    return spark.read.parquet(f"{path}/{version}/{name}".rstrip("/")) if version else None


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file in one rename that overwrites."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    fs = target.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf).rename(new, target, options)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file, whole, unless there is one of that name already; only one of several writers gets True.

    A temporary file is renamed without overwriting, which HDFS does in one
    step; on a local disk, where a rename would overwrite, it is linked.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(new.toUri().getPath(), target.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf).rename(new, target, options)
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    finally:
        fs.delete(new, False)
    return True


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if it is not there."""
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path(path)
    fs = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(named):
        return None
    stream = fs.open(named)
    text = str(jvm.java.lang.String(stream.readAllBytes()))
    stream.close()
    return text


TERMINAL = ("done", "failed", "cancelled")


def merge_state(old: Mapping[str, object], update: Mapping[str, object], now: str) -> dict[str, object]:
    """A run's state after an update: given keys replace, a terminal status stays, and ``updated_at`` is set."""
    merged = {**old, **{k: v for k, v in update.items() if v is not None}}
    if old.get("status") in TERMINAL:
        merged["status"] = old["status"]
    return {**merged, "updated_at": now}


def rate_and_eta(done: int, total: int, seconds: float) -> tuple[float, float | None]:
    """Items a second, and the seconds left (None before the first item)."""
    rate = done / seconds if seconds > 0 else 0.0
    return rate, (max(0, total - done) / rate if rate > 0 else None)


def throttled(call: Callable[..., None], every: float = 2.0, clock: Callable[[], float] = time.monotonic) -> Callable[..., None]:
    """``call`` at most once in ``every`` seconds; with ``force=True`` in any case."""
    last: list[float] = []

    def run(*args, force: bool = False, **named) -> None:
        now = clock()
        if force or not last or now - last[0] >= every:
            last[:] = [now]
            call(*args, **named)

    return run


def append_json(df: DataFrame, path: str, number: int | None = None) -> None:
    """Adds the rows as JSON lines; each call is a batch of files of its own, complete or absent. A numbered batch that is written again takes its own place."""
    if number is None:
        df.write.mode("append").json(path)
    else:
        df.write.mode("overwrite").json(f"{path}/batch={number}")


def overwrite_json(df: DataFrame, path: str, keep: int = 2) -> None:
    """Replaces the JSON lines at ``path`` by a version that is whole before it is named; older ones than the ``keep`` before it are deleted."""
    version = f"v-{time.time_ns():020d}"
    df.write.json(f"{path}/{version}")
    put_text(df.sparkSession, f"{path}/{POINTER}", version)
    _remove_old(df.sparkSession, path, version, keep)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``append_json`` or ``overwrite_json`` wrote."""
    version = get_text(spark, f"{path}/{POINTER}")
    return spark.read.schema(schema).json(f"{path}/{version}" if version else path)


def exists(spark: SparkSession, path: str) -> bool:
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(named)


class RunState:
    """A run's state in one small file, merged and replaced as a whole; a terminal status stays, whatever is told later."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], str] = lambda: time.strftime("%Y-%m-%dT%H:%M:%S")) -> None:
        self.spark, self.path, self.clock, self._lock = spark, path, clock, threading.Lock()

    def read(self) -> dict[str, object]:
        return json.loads(get_text(self.spark, self.path) or "{}")

    def update(self, **values: object) -> dict[str, object]:
        with self._lock:
            merged = merge_state(self.read(), values, self.clock())
            put_text(self.spark, self.path, json.dumps(merged, sort_keys=True))
        return merged


class StateListener(StreamingQueryListener):
    """Keeps the state of a streaming query by its name: rows done, rate, batches, and how it ended."""

    def __init__(self, state: RunState, name: str, total: int | None = None) -> None:
        self.state, self.name, self.total, self._ids = state, name, total, set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self._ids.add(str(event.runId))
            self.state.update(status="running", done=0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = event.progress
        if told.name == self.name:
            done = int(self.state.read().get("done") or 0) + told.numInputRows
            rate = told.processedRowsPerSecond
            eta = max(0, self.total - done) / rate if self.total is not None and rate and rate == rate else None
            self.state.update(done=done, batch=told.batchId, rate=round(rate, 3) if rate == rate else None, eta=eta)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) in self._ids:
            self.state.update(status="failed" if event.exception else "done", error=event.exception and event.exception[:500])
