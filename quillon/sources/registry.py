"""A registry that several writers may change at once: optimistic versions on the file system.

A writer reads the newest version, writes its merged rows to a folder of its
own, and tries to create the commit file of the next number, which only one
writer can.  Those that lose merge again with what the winner wrote.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillon.operators.maintenance import update_by_key, upsert_missing
from quillon.streaming.progress import get_text, put_if_absent

ORDER = ("category", "local_path")


class RegistryBusyError(RuntimeError):
    """Other writers were first each time."""


def _commits(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/commits")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _version(spark: SparkSession, path: str, number: int) -> DataFrame:
    held = json.loads(get_text(spark, f"{path}/commits/{number:012d}.json"))
    return spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{path}/{held['data']}")


def read_registry(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, by category and path, or None before the first."""
    found = _commits(spark, path)
    rows = _version(spark, path, found[-1]) if found else None
    return None if rows is None else rows.orderBy(*(c for c in ORDER if c in rows.columns))


def change(spark: SparkSession, path: str, merge: Callable[[DataFrame | None], DataFrame], attempts: int = 20, wait: float = 0.05) -> int:
    """Commits ``merge(rows)`` as the next version and returns its number; ``merge`` runs again on newer rows if another writer was first."""
    for attempt in range(attempts):
        found = _commits(spark, path)
        old = _version(spark, path, found[-1]) if found else None
        new = merge(old)
        data, number = f"data/{uuid.uuid4().hex}", (found[-1] if found else 0) + 1
        new.sortWithinPartitions(*(c for c in ORDER if c in new.columns)).write.parquet(f"{path}/{data}")
        if put_if_absent(spark, f"{path}/commits/{number:012d}.json", json.dumps({"data": data, "schema": json.loads(new.schema.json())})):
            return number
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{data}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        time.sleep(wait * (1 + attempt) * random.random())
    raise RegistryBusyError(path)


def add_sources(rows: DataFrame, path: str, key: str = "local_path") -> int:
    """Adds rows of new keys; those that are there take only the values they lack. Returns the version."""
    return change(rows.sparkSession, path, lambda old: rows.dropDuplicates([key]) if old is None else upsert_missing(old, rows.dropDuplicates([key]), key).drop("added"))


def update_sources(updates: DataFrame, path: str, key: str = "local_path") -> int:
    """Sets the given values of known keys; unknown keys are left out. Returns the version."""
    def merge(old: DataFrame | None) -> DataFrame:
        if old is None:
            raise LookupError(f"no registry at {path}")
        return update_by_key(old, updates, key)

    return change(updates.sparkSession, path, merge)
