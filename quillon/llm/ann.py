"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors has its own codebook, and a cell of the index is a
pair of codewords.  A query traverses the pairs by the sum of its squared
distances to the two codewords, with a heap, until the cells hold enough
vectors; those cells' entries are reranked by exact distance.

How much is enough is measured on the codebook sample: the share of vectors
at which ``recall`` of the true neighbours within the sample is reached.  For a
fixed first codeword the traversed cells are those up to a sum, so a query
sends each block of the index only its vector and that sum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.staging import stage

#: Vectors at most for codebooks, and of them for measuring recall.
SAMPLE, PROBES = 8192, 256
#: Codewords of a half at most (so PAIRS = their square at most are counted and broadcast).
CODEWORDS = 128
#: Recall aimed at on the sample; larger tables have nearer neighbours and so higher recall.
RECALL = 0.97
#: Entries of a block of the index, and queries that one copy of it answers; a fuller codeword is split, a block asked by more is copied.
BLOCK, QUERIES = 4096, 4096
#: Queries that one task traverses the cells for.
TRAVERSED = 128


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squared(x: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x**2).sum(1)[:, None] + (code**2).sum(1)[None] - 2 * x @ code.T)


def codebook(x: np.ndarray, size: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means from distinct rows; an empty codeword is put on the worst-coded row."""
    distinct = np.unique(x, axis=0)
    size = min(size, len(distinct))
    code = distinct[np.sort(random.choice(len(distinct), size, replace=False))]
    for _ in range(rounds):
        d = _squared(x, code)
        near = d.argmin(1)
        n = np.bincount(near, minlength=size)
        total = np.zeros_like(code)
        np.add.at(total, near, x)
        code = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], x[d.min(1).argmax()])
    return code


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves and the share of vectors to traverse."""

    half: int
    codes: tuple[np.ndarray, np.ndarray]
    share: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(x[:, : self.half], self.codes[0]), _squared(x[:, self.half :], self.codes[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(1), b.argmin(1)


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> float:
    """The sum at which the cells, taken by ascending ``a[i] + b[j]``, hold ``enough`` entries; infinity if they never do.

    The multi-sequence algorithm: a pair enters the heap when both pairs before
    it, on its row and its column, have left.
    """
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    first, second = a[order_a].tolist(), b[order_b].tolist()
    held = counts[np.ix_(order_a, order_b)].tolist()
    passed = [0] * len(first)  # on each row, columns that have left the heap
    heap, total = [(first[0] + second[0], 0, 0)], 0
    while heap:
        least, i, j = heapq.heappop(heap)
        total += held[i][j]
        if total >= enough:
            return least
        passed[i] = j + 1
        if j + 1 < len(second) and (i == 0 or passed[i - 1] > j + 1):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if i + 1 < len(first) and passed[i + 1] == j:
            heapq.heappush(heap, (first[i + 1] + second[j], i + 1, j))
    return float("inf")


def fit_index(sample: np.ndarray, codewords: int, recall: float = RECALL, seed: int = 11, k: int = 10) -> MultiIndex:
    random = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    codes = (codebook(sample[:, :half], codewords, random), codebook(sample[:, half:], codewords, random))
    index = MultiIndex(half, codes, 1.0)
    if len(sample) <= k + 1:
        return index
    probes = np.sort(random.choice(len(sample), min(PROBES, len(sample)), replace=False))
    exact = _squared(sample[probes], sample)
    exact[np.arange(len(probes)), probes] = np.inf
    true = np.argpartition(exact, k, axis=1)[:, :k]
    (a, b), (i, j) = index.distances(sample[probes]), index.cells(sample)
    needed = []
    for p in range(len(probes)):
        sums = np.sort(a[p][i] + b[p][j])
        needed.append(np.searchsorted(sums, (a[p][i] + b[p][j])[true[p]], side="right") / len(sample))
    return MultiIndex(half, codes, float(np.quantile(np.concatenate(needed), recall)))


def _assign(index: MultiIndex):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("i", pa.int32()), ("j", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = index.cells(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(i, pa.int32()), pa.array(j, pa.int32())], schema=schema)

    return run


def _ask(index: MultiIndex, counts: np.ndarray, parts: np.ndarray, enough: int):
    """A row for each block that holds a cell the query traverses."""
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("reach", pa.float64()), ("i", pa.int32()), ("part", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = index.distances(_matrix(batch.column("v")))
            at, reach, i, part = [], [], [], []
            for row in range(batch.num_rows):
                limit = traverse(a[row], b[row], counts, enough)
                for c in np.flatnonzero((a[row] + b[row].min() <= limit) & (parts > 0)):
                    for p in range(parts[c]):
                        at.append(row)
                        reach.append(limit)
                        i.append(c)
                        part.append(p)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(rows), batch.column("v").take(rows), pa.array(reach, pa.float64()), pa.array(i, pa.int32()), pa.array(part, pa.int32())], schema=schema
            )

    return run


def _rerank(index: MultiIndex, k: int):
    """One block: the k nearest entries of the cells that each query traverses, by exact distance."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if entries.num_rows and queries.num_rows:
            ids, x, j = entries.column("vec_id").to_numpy(), _matrix(entries.column("v").combine_chunks()), entries.column("j").to_numpy()
            q, reach, c = _matrix(queries.column("q").combine_chunks()), queries.column("reach").to_numpy(), queries.column("i").to_numpy()[0]
            a, b = index.distances(q)
            for row, query in enumerate(queries.column("query_id").to_numpy()):
                near = np.flatnonzero((a[row, c] + b[row][j] <= reach[row]) & (ids != query))
                score = np.sqrt(((x[near] - q[row]) ** 2).sum(axis=1))
                order = np.lexsort((ids[near], score))
                if len(order):
                    found = ids[near][order]
                    order = order[np.sort(np.unique(found, return_index=True)[1])[:k]]  # an id once
                out[0].append(np.full(len(order), query, dtype=np.int64))
                out[1].append(ids[near][order])
                out[2].append(score[order])
        arrays = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, score being the Euclidean distance in double precision.

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows of another id; fewer than ``k`` candidates are all returned.  Equal
    distances go to the smaller id.  Null ids, and vectors that are null,
    empty, zero, or hold null or non-finite components take no part, and nor do
    vectors whose length is not the commonest (the greatest of those that are).
    An id that is repeated is one candidate, at its nearest vector, and asks
    once, with its least vector.  Other columns are ignored; an empty table
    gives an empty table.

    Every row is indexed.  Codebooks come from SAMPLE vectors at most; the
    driver gets those and the CODEWORDS squared cell counts.  A cell counts
    distinct vectors, so copies do not use up a query's share; a codeword of
    many rows is split in blocks of about BLOCK, and a block that many queries
    ask is copied, so that a group holds about BLOCK entries and QUERIES queries.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = named.where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    rows = rows.where(F.size("v") == lengths[0].d)
    total = lengths[0]["count"]
    chosen = rows.where(F.abs(F.xxhash64("vec_id", F.lit(1)) % (1 << 20)) < min(1 << 20, -(-2 * SAMPLE * (1 << 20) // total)))
    sample = chosen.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()
    index = fit_index(_matrix(sample.column("v").combine_chunks()), max(1, min(CODEWORDS, round((total / 4) ** 0.5))), recall, k=k)

    entries = stage(rows.mapInArrow(_assign(index), "vec_id long, v array<double>, i int, j int"), "entries")
    shape = (len(index.codes[0]), len(index.codes[1]))
    distinct, held = np.zeros(shape, dtype=np.int64), np.zeros(shape[0], dtype=np.int64)
    per_vector = entries.groupBy("i", "j", F.xxhash64("v").alias("h")).agg(F.count("*").alias("n"))
    for r in per_vector.groupBy("i", "j").agg(F.count("*").alias("vectors"), F.sum("n").alias("rows")).collect():  # a row for each cell
        distinct[r.i, r.j] = r.vectors
        held[r.i] += r.rows
    parts = -(-held // BLOCK)
    enough = max(10 * k, int(np.ceil(index.share * distinct.sum())))
    queries = stage(entries.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    tasks = max(1, -(-queries.count() // TRAVERSED))
    asks = queries.repartition(tasks, "vec_id").mapInArrow(_ask(index, distinct, parts, enough), "query_id long, q array<double>, reach double, i int, part int")
    asks = stage(asks, "asks")
    asked = np.zeros(shape[0], dtype=np.int64)
    for r in asks.where("part = 0").groupBy("i").count().collect():  # a row for each codeword
        asked[r.i] = r["count"]
    copies = F.element_at(F.array(*(F.lit(int(max(1, -(-n // QUERIES)))) for n in asked)), F.col("i") + 1)
    asks = asks.withColumn("copy", F.pmod(F.xxhash64("query_id", F.lit(4)), copies).cast("int"))
    split = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.element_at(F.array(*(F.lit(int(max(1, p))) for p in parts)), F.col("i") + 1)).cast("int")
    blocks = entries.select("vec_id", "v", "i", "j", split.alias("part"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy")).groupBy("i", "part", "copy")
    found = blocks.cogroup(asks.groupBy("i", "part", "copy")).applyInArrow(_rerank(index, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
