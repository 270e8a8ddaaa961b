"""Lines of many files in one order, and tables that stay in memory until their version changes."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.staging import stage
from quillon.streaming.progress import POINTER, get_text


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a glob names, by their paths; an error if there are none."""
    named = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(named)
    paths = sorted(x.getPath().toString() for x in found or [] if x.isFile())
    if not paths:
        raise FileNotFoundError(pattern)
    return paths


def ordered_lines(spark: SparkSession, paths: Sequence[str], split: bool = True) -> DataFrame:
    """(file, line, ord, value): the lines of the files, each with the place of its file, its number there, and its place among all, from 0.

    Files are read in splits, all at once.  A line's number comes from two
    steps: lines are numbered within their task's part of a file, which is small
    enough to be counted where it is read, and the counts of the parts before are
    added.  No task sees a whole file, and lines are not moved.  ``split=False``
    reads each file in one task.
    """
    reader = spark.read.option("wholetext", "false")
    rows = reader.text(list(paths)).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    held = stage(rows, "lines")  # numbers of one reading, so that both steps see the same
    parts = held.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    names = spark.createDataFrame([(_qualified(spark, p), i) for i, p in enumerate(paths)], "of string, file int")
    counted = parts.join(F.broadcast(names), F.col("path") == F.col("of"), "left")  # a row for each split of a file
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select("path", "block", "file", "first", before("file").alias("in_file"), before(F.lit(0)).alias("in_all"))
    lines = held.join(placed, ["path", "block"])
    number = F.col("at") - F.col("first")  # within a split the ids follow each other
    return lines.select("file", (F.col("in_file") + number).alias("line"), (F.col("in_all") + number).alias("ord"), "value")


def _qualified(spark: SparkSession, path: str) -> str:
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toUri().toString()
    return re.sub("^file:/+", "/", whole)  # the number of slashes differs


class VersionedCache:
    """Tables made from published ones, kept in memory for as long as the version that they were made from is current.

    A key is a path and a name; the version is what the path's pointer says.
    When it has moved, the old table is dropped and a new one made.
    """

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], tuple[str | None, DataFrame]] = {}
        self._lock = threading.Lock()

    def get(self, spark: SparkSession, path: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name`` of the current version at ``path``; ``make`` runs only if there is none yet."""
        with self._lock:
            version = get_text(spark, f"{path}/{POINTER}")
            found = self._held.get((path, name))
            if found is not None and found[0] == version:
                return found[1]
            if found is not None:
                found[1].unpersist()
            table = make().persist(StorageLevel.MEMORY_AND_DISK)
            self._held[path, name] = (version, table)
            return table

    def clear(self) -> None:
        """Drops all tables."""
        with self._lock:
            for _, table in self._held.values():
                table.unpersist()
            self._held.clear()
