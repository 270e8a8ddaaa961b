"""A keyed table in buckets, brought up to date by writing only the buckets that a batch touches.

The rows of a key are in the bucket of its hash.  A batch reads the buckets of
its keys, merges, writes these as new files, and publishes a manifest that
names the folder of every bucket, those of the others as before.  A reader
holds the manifest that the pointer named when it began, and finds all its
files until ``keep`` later versions have been published.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.staging import stage
from quillon.streaming.progress import POINTER, get_text, put_text


@dataclass(frozen=True)
class Manifest:
    """Where the rows of each bucket are; ``batch`` is the last batch that went in."""

    n_buckets: int
    schema: str
    batch: int = -1
    version: int = 0
    buckets: dict[str, str] = field(default_factory=dict)


def bucket_of(key: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    named = get_text(spark, f"{path}/{POINTER}")
    found = get_text(spark, f"{path}/{named}") if named else None
    return Manifest(**json.loads(found)) if found else None


def _read(spark: SparkSession, path: str, held: Manifest, only: list[str] | None = None) -> DataFrame:
    folders = sorted({f"{path}/{where}" for b, where in held.buckets.items() if only is None or b in only})
    schema = StructType.fromJson(json.loads(held.schema))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the last batch left it, or None before the first."""
    held = read_manifest(spark, path)
    return None if held is None else _read(spark, path, held)


def merge(batch: DataFrame, path: str, key: str, order: str, number: int, n_buckets: int = 64, keep: int = 2) -> int:
    """Puts the last record of each key (by ``order``; the batch wins a tie) into the table; returns the number of buckets written.

    A batch of a number that is already in does nothing.  Rows with a null key
    share one.  Other versions' files are deleted once ``keep`` newer manifests
    exist; a batch that fails midway leaves files that no manifest names, which
    go with the next batch.
    """
    spark = batch.sparkSession
    held = read_manifest(spark, path) or Manifest(n_buckets, batch.schema.json())
    if number <= held.batch:
        return 0
    row = F.struct(*(F.col(f"`{c}`") for c in batch.columns))
    last = lambda rows: rows.groupBy(F.col("row")[key].alias("k")).agg(F.max_by("row", F.struct(F.col("row")[order], "late")).alias("row"), F.max("late").alias("late"))
    new = stage(last(batch.select(row.alias("row"), F.lit(1).alias("late"))).select("row", "late"), "batch")
    touched = [str(r["b"]) for r in new.select(bucket_of(F.col("row")[key], held.n_buckets).alias("b")).distinct().collect()]  # no more than buckets
    if not touched:
        _publish(spark, path, replace(held, batch=number, version=held.version + 1), keep)
        return 0
    old = _read(spark, path, held, touched).select(row.alias("row"), F.lit(0).alias("late"))
    merged = last(old.unionByName(new)).select("row.*").withColumn("_bucket", bucket_of(F.col(key), held.n_buckets))
    folder = f"data/{uuid.uuid4().hex}"
    merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    written = {b: f"{folder}/_bucket={b}" for b in touched}
    _publish(spark, path, replace(held, batch=number, version=held.version + 1, buckets=held.buckets | written), keep)
    return len(touched)


def _publish(spark: SparkSession, path: str, manifest: Manifest, keep: int) -> None:
    name = f"manifest-{manifest.version:012d}.json"
    put_text(spark, f"{path}/{name}", json.dumps(manifest.__dict__, sort_keys=True))
    put_text(spark, f"{path}/{POINTER}", name)
    vacuum(spark, path, keep)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes what neither the last manifest nor the ``keep`` before it name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName().startswith("manifest-") and x.getPath().getName().endswith(".json"))
    for name in names[: -1 - keep]:
        fs.delete(hadoop.Path(f"{path}/{name}"), False)
    used = {where for name in names[-1 - keep :] for where in Manifest(**json.loads(get_text(spark, f"{path}/{name}") or "{}")).buckets.values()}
    data = hadoop.Path(f"{path}/data")
    for folder in fs.listStatus(data) if fs.exists(data) else []:
        at = f"data/{folder.getPath().getName()}"
        for bucket in fs.listStatus(folder.getPath()):
            if bucket.isDirectory() and f"{at}/{bucket.getPath().getName()}" not in used:
                fs.delete(bucket.getPath(), True)
        if not any(where.startswith(f"{at}/") for where in used):
            fs.delete(folder.getPath(), True)


def replay(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, n_buckets: int = 64, keep: int = 2) -> StreamingQuery:
    """Folds a log into a table of the last record of each key; see ``merge``. A repeated batch changes nothing."""
    fold = lambda batch, number: merge(batch, path, key, order, number, n_buckets, keep)
    return stream.writeStream.foreachBatch(lambda b, n: fold(b, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
