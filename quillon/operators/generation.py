"""Generation in batches through an injected model, with a log that a run goes on from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions.text import strip
from quillon.operators.maintenance import latest
from quillon.staging import scratch, stage
from quillon.streaming.progress import append_json, exists, read_json

#: (id, prompt, ...) to (id, output, truncated).
Model = Callable[[DataFrame], DataFrame]
LOG = "id string, output string, truncated boolean, rescued boolean, fingerprint string, batch long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log, or none before the first batch."""
    return read_json(spark, path, LOG) if exists(spark, path) else spark.createDataFrame([], LOG)


def outputs(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """The last record of each id that the settings of ``fingerprint`` gave."""
    return latest(read_log(spark, path).where(F.col("fingerprint") == fingerprint), ["id"], ["batch", "rescued"])


def failed(rows: DataFrame) -> DataFrame:
    """Outputs that are blank or were cut off."""
    return rows.where((strip(F.coalesce("output", F.lit(""))) == "") | F.coalesce("truncated", F.lit(False)))


def generate(items: DataFrame, model: Model, path: str, fingerprint: str, batch_rows: int = 100_000, rescue: Model | None = None) -> int:
    """Generates for the items (id, prompt, ...) that the log at ``path`` lacks, and returns the number of batches.

    The log lacks an item if it has no record of this ``fingerprint``.  Items
    are dealt to batches by a hash of their id; each batch is one run of the
    model and is appended to the log when it is whole, so a run that stops
    between batches (or within one) goes on with what is missing.  ``rescue``
    runs once over the failures of a batch, with what was generated as
    ``draft``; what it gives takes the place of the failure unless it fails too.
    Records that stay failures are kept as such and not generated again.  Of
    repeated ids one item counts; null ids are left out.
    """
    spark = items.sparkSession
    with scratch(spark):
        known = read_log(spark, path)
        last = known.agg(F.max("batch").alias("last")).first()["last"]
        named = items.withColumn("id", F.col("id").cast("string")).where("id is not null").dropDuplicates(["id"])
        todo = stage(named.join(known.where(F.col("fingerprint") == fingerprint).select("id").distinct(), "id", "left_anti"), "todo")
        n = -(-todo.count() // batch_rows)
        for number in range(n):
            batch = todo.where(F.pmod(F.xxhash64("id"), F.lit(n)) == number)
            with scratch(spark):
                first = stage(model(batch).select("id", "output", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.lit(False).alias("rescued")), "first")
                whole = first
                if rescue is not None and not failed(first).isEmpty():
                    again = rescue(batch.join(failed(first).select("id", F.col("output").alias("draft")), "id"))
                    mended = stage(again.select("id", "output", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.lit(True).alias("rescued")), "rescued")
                    good = mended.join(failed(mended).select("id"), "id", "left_anti")
                    whole = first.join(good.select("id"), "id", "left_anti").unionByName(good)
                append_json(whole.withColumn("fingerprint", F.lit(fingerprint)), path, (-1 if last is None else last) + 1 + number)
        return n
