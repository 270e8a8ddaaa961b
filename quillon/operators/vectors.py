"""Vector indexes behind one interface: exact, or written by coarse cells so that a search reads few of them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.operators.search import cosines, vector_top
from quillon.staging import stage
from quillon.streaming.progress import POINTER, get_text, publish_all, put_text

#: Rows of the sample that cells are learnt from, for each cell, and rounds of learning.
SAMPLE_PER_CELL, ROUNDS = 64, 10
#: Bytes of query vectors that a pass over the index takes with it; more queries take more passes.
QUERY_BYTES = 64 << 20


class VectorIndex(Protocol):
    """Vectors (chunk_id, doc_id, ord, v) that can be asked for those nearest to (query_id, v)."""

    def cosines(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, doc_id, ord, cosine) of every pair that the index looks at."""
        ...

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, doc_id, ord, cosine, vector_rank): the k best of each query, ties by ord."""
        ...


@dataclass(frozen=True)
class ExactIndex:
    """Every vector is compared."""

    vectors: DataFrame

    def cosines(self, queries: DataFrame) -> DataFrame:
        return cosines(self.vectors, queries)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return vector_top(self.vectors, queries, k)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm == 0, 0.0, x / np.where(norm == 0, 1.0, norm))


def learn_cells(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres of ``cells`` directions at most, by spherical k-means on the ``SAMPLE_PER_CELL`` * cells rows of the smallest hashes of their ids."""
    rows = vectors.select("chunk_id", F.col("v").cast("array<double>").alias("v")).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_PER_CELL * cells).toArrow()
    x = _unit(_matrix(rows.column("v")))
    x = x[np.any(x != 0, axis=1)]
    centres = np.unique(x, axis=0) if len(x) < cells else x[:: len(x) // cells][:cells]
    for _ in range(ROUNDS if len(x) >= cells else 0):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def write_cells(vectors: DataFrame, path: str, cells: int = 64) -> None:
    """Writes the vectors below ``path``, partitioned by the cell of the nearest centre, and makes them current.

    All vectors are indexed; a zero vector is in the first cell.
    """
    spark = vectors.sparkSession
    centres = learn_cells(vectors, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            near = np.argmax(x @ centres.T, axis=1) if len(centres) and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cell"])

    rows = vectors.select("chunk_id", "doc_id", "ord", F.col("v").cast("array<double>").alias("v"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int"
    placed = stage(rows.mapInArrow(place, ddl), "placed")
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    version = f"cells-{len(sizes)}"
    # a file for each cell, and more for a cell that holds more than its share
    share = max(1, -(-sum(sizes.values()) // max(1, 4 * cells)))
    parts = F.create_map(*(F.lit(x) for c, n in (sizes or {0: 1}).items() for x in (c, -(-n // share))))
    split = placed.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.element_at(parts, F.col("cell"))))
    publish_all({"vectors": split.repartition("cell", "part").drop("part")}, path, version, by=("cell",))
    put_text(spark, f"{path}/{get_text(spark, f'{path}/{POINTER}')}/centres.json", json.dumps({"centres": centres.tolist(), "ddl": ddl}))


@dataclass(frozen=True)
class CellIndex:
    """Vectors as ``write_cells`` left them; a query looks at the ``probes`` cells whose centres are nearest to it, and at no others' files."""

    spark: SparkSession
    path: str
    probes: int

    def _parts(self) -> tuple[DataFrame, np.ndarray]:
        version = get_text(self.spark, f"{self.path}/{POINTER}")
        held = json.loads(get_text(self.spark, f"{self.path}/{version}/centres.json"))
        return self.spark.read.schema(held["ddl"]).parquet(f"{self.path}/{version}/vectors"), np.array(held["centres"])

    def _looked_at(self, queries: DataFrame, k: int | None) -> DataFrame:
        vectors, centres = self._parts()
        asked = stage(queries.select("query_id", F.col("v").cast("array<double>").alias("v")), "asked")
        width = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
        passes = max(1, -(-width["n"] * (width["w"] or 1) * 8 // QUERY_BYTES))
        kinds = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *asked.schema)}
        ddl = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "chunk_id", "doc_id", "ord")) + ", cosine double"
        found = None
        for number in range(passes):
            block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).toArrow()
            q = _unit(_matrix(block.column("v")))
            near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, : self.probes] if len(centres) and len(q) else np.zeros((len(q), 1), dtype=np.int64)
            wanted = np.zeros((len(q), max(1, len(centres))), dtype=bool)
            np.put_along_axis(wanted, near, True, axis=1)
            cells = [int(c) for c in np.flatnonzero(wanted.any(0))]
            own = vectors.where(F.col("cell").isin(cells)).mapInArrow(_compare(block.column("query_id").combine_chunks(), q, wanted, k), ddl)
            found = own if found is None else found.unionByName(own)
        return found.withColumn("cosine", F.round("cosine", 9))

    def cosines(self, queries: DataFrame) -> DataFrame:
        return self._looked_at(queries, None)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "ord"))
        return self._looked_at(queries, k).withColumn("vector_rank", rank.cast("long")).where(F.col("vector_rank") <= k)


def _compare(ids: pa.Array, q: np.ndarray, wanted: np.ndarray, k: int | None):
    """For each batch and cell the cosines of the queries that want the cell; with ``k`` those that may be among the k best of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in pc.unique(batch.column("cell")).to_pylist():
                part = batch.filter(pc.equal(batch.column("cell"), cell))
                asking = np.flatnonzero(wanted[:, cell])
                x = _unit(_matrix(part.column("v")))
                for lo in range(0, len(asking), 256):
                    some = asking[lo : lo + 256]
                    score = np.round(x @ q[some].T, 9)
                    if k is None or len(x) <= k:
                        rows, columns = np.divmod(np.arange(score.size), len(some))
                    else:
                        least = np.partition(score, len(x) - k, axis=0)[len(x) - k]
                        rows, columns = np.nonzero(score >= least)
                    taken = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(some[columns])), *(part.column(c).take(taken) for c in ("chunk_id", "doc_id", "ord")), pa.array(score[rows, columns])], ["query_id", "chunk_id", "doc_id", "ord", "cosine"]
                    )

    return run
