"""Tables that cut lineage: written once to the folder all executors share, then read back.

The folder is the one ``spark.checkpoint.dir`` names.  Where that is unset, a
temporary folder of the driver takes its place, but only if the executors run
on the driver's machine; elsewhere they could not read it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables; sets the checkpoint folder if none is set."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _held(spark: SparkSession) -> dict[str, None]:
    """Paths of the staged tables that exist, in order."""
    context = spark.sparkContext
    if not hasattr(context, "_quillon_staged"):
        context._quillon_staged = {}
    return context._quillon_staged


#: Paths staged within the innermost ``scratch`` block of this thread or task, if any.
_block: ContextVar[list[str] | None] = ContextVar("quillon_block", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns the written table.

    Unlike a cache, the table survives lost executors; unlike ``checkpoint()``
    it is columnar, so that later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _held(spark)[path] = None
    block = _block.get()
    if block is not None:
        block.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Deletes the staged tables of ``paths``, or all there are; plans over them cannot run again."""
    held = _held(spark)
    for path in list(held) if paths is None else paths:
        if path in held:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            held.pop(path, None)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Tables staged within are deleted when the block ends, but those named in ``keep``, which what it returns may read.

    A block knows its own tables only: queries of other threads keep theirs.
    Tables that an inner block keeps belong to the block around it.
    """
    outer, inner = _block.get(), []
    token = _block.set(inner)
    try:
        yield
    finally:
        _block.reset(token)
        kept = [p for p in inner if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] in keep]
        if outer is not None:
            outer += kept
        discard(spark, [p for p in inner if p not in kept])
