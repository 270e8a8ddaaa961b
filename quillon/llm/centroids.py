"""Lloyd's clustering of integer vectors with partial-distance search.

Each round compares a block of vectors with one centroid after the other.  The
squared differences are added up over the dimensions of highest variance first,
a few at a time; a vector leaves the comparison as soon as its sum is strictly
above its best distance so far, so only true contenders see all dimensions.
Everything is integer arithmetic, so any split of the vectors into tasks gives
the same result.

A task returns the sums of its vectors for each centroid; Spark adds them up,
and only k rows of sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillon.staging import stage

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Integer components beyond this count as this: squared distances then fit a long.
LARGEST = 1 << 27
#: Dimensions added up between two looks at the best distance, and vectors compared at once.
STRIDE, BLOCK = 8, 4096


@dataclass(frozen=True)
class Clusters:
    """Integer centroids (k, dimensions), and the dimensions by falling variance."""

    centroids: np.ndarray
    order: np.ndarray


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector (ties: the smaller) and the squared distance; dimensions are taken in the order given."""
    dims = vectors.shape[1]
    best = np.square(vectors - centroids[0]).sum(1)
    cluster = np.zeros(len(vectors), dtype=np.int32)
    for j in range(1, len(centroids)):
        rows = np.arange(len(vectors))
        so_far = np.zeros(len(vectors), dtype=np.int64)
        for lo in range(0, dims, STRIDE):
            away = vectors[rows, lo : lo + STRIDE] - centroids[j, lo : lo + STRIDE]
            so_far += np.square(away).sum(1)
            near = so_far <= best[rows]
            rows, so_far = rows[near], so_far[near]
        closer = so_far < best[rows]
        best[rows[closer]], cluster[rows[closer]] = so_far[closer], j
    return cluster, best


def integer_vectors(vectors: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>): floor(scale * x) of the vectors of exactly ``dims`` components, none null or non-finite. Vectors of other kinds are left out."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            batch = batch.filter(pc.equal(pc.fill_null(pc.list_value_length(lists), -1), dims))
            flat = batch.column("v").flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null is not a number here
            good = np.isfinite(x).all(1)
            whole = np.clip(np.floor(x[good] * scale), -LARGEST, LARGEST).astype(np.int32)
            values = pa.ListArray.from_arrays(np.arange(len(whole) + 1, dtype=np.int32) * dims, pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), values], ["vec_id", "v"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(convert, "vec_id long, v array<int>")


def _matrix(column: pa.Array, order: np.ndarray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(order))[:, order].astype(np.int64)


def first_centroids(whole: DataFrame, k: int = CLUSTERS, dims: int = DIMENSIONS) -> np.ndarray:
    """The vectors of the k smallest SHA-256 of ``3:<vec_id>``, in the order of these; rows of one id in the order of their components, null ids last."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = whole.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), dims)


def variance_order(whole: DataFrame, dims: int = DIMENSIONS) -> np.ndarray:
    """The dimensions by falling variance over all vectors. It decides how soon a comparison ends, not how."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = _matrix(batch.column("v"), np.arange(dims)).astype(np.float64)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + np.square(x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, float(n))), pa.array(sums), pa.array(squares)], ["d", "n", "s", "q"])

    rows = whole.select("v").mapInArrow(moments, "d int, n double, s double, q double").groupBy("d").agg(*(F.sum(c).alias(c) for c in "nsq")).collect()
    variance = np.zeros(dims)
    for r in rows:
        variance[r["d"]] = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0.0
    return np.argsort(-variance, kind="stable")


def _sums(whole: DataFrame, state: Clusters) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has vectors their number and exact componentwise sums."""
    order, centroids = state.order, state.centroids[:, state.order]
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column("v").slice(lo, BLOCK), order)
                cluster, _ = nearest(x, centroids)
                count += np.bincount(cluster, minlength=k)
                for j in range(k):
                    sums[j] += x[cluster == j].sum(0)
        own = np.flatnonzero(count)
        values = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * dims, pa.array(sums[own][:, np.argsort(order)].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), values], ["cluster", "n", "s"])

    parts = whole.select("v").mapInArrow(add, "cluster int, n long, s array<long>")
    exact = [F.sum(F.get("s", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{d}"]) for d in range(dims)]) for r in rows}


def fit_clusters(whole: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS) -> Clusters:
    """The centroids after ``rounds`` rounds, each the floor of its vectors' mean; one without vectors stays. With fewer than k vectors there are as many centroids."""
    state = Clusters(first_centroids(whole, k, dims), variance_order(whole, dims))
    for _ in range(rounds if len(state.centroids) else 0):
        moved = state.centroids.copy()
        for j, (n, sums) in _sums(whole, state).items():
            moved[j] = [s // n for s in sums]
        if (moved == state.centroids).all():
            break  # the rounds left would change nothing
        state = Clusters(moved, state.order)
    return state


def assign(whole: DataFrame, state: Clusters) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    order, centroids = state.order, state.centroids[:, state.order]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                cluster, distance = nearest(_matrix(part.column("v"), order), centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return whole.mapInArrow(search, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dims`` finite components.

    Vectors that are null, of another length or hold a null or non-finite
    component have no row; no vector gives an empty table.  Repeated rows count
    and are returned as often as they occur; null ids are clustered but start no
    centroid unless there is no other.  Integer components beyond ``LARGEST``
    count as that; an inertia that no long holds is null.  Other columns are not read.
    """
    whole = stage(integer_vectors(vectors, dims, id_col=id_col, vector_col=vector_col), "vectors")
    state = fit_clusters(whole, k, rounds, dims)
    if not len(state.centroids):
        return whole.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    found = stage(assign(whole, state), "assigned")
    spread = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in state.centroids.tolist()]
    each = [(j, long(spread[j]), digest[j]) for j in sorted(spread)]
    of = F.broadcast(vectors.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, centroid_sha256 string"))  # k rows
    return found.join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(long(sum(spread.values()))).cast("long").alias("inertia"), "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS) -> str:
    """The same in DuckDB's SQL, every distance in full."""
    def nearest_of(c: str) -> str:
        return f"""
  SELECT rn, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (
    SELECT v.rn, c.k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS dist FROM v JOIN {c} c USING (d) GROUP BY v.rn, c.k) GROUP BY rn"""

    sql = f"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims}),
v AS MATERIALIZED (SELECT rn, d, q[d] AS x FROM rows, (SELECT unnest(range(1, {dims + 1})) AS d)),
c0 AS MATERIALIZED (
  SELECT k, d, q[d] AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS k, q FROM rows QUALIFY k < {k}), (SELECT unnest(range(1, {dims + 1})) AS d))"""
    for r in range(1, rounds + 1):
        was = f"c{r - 1}"
        sql += f""",
a{r} AS MATERIALIZED ({nearest_of(was)}),
c{r} AS MATERIALIZED (
  SELECT c.k, c.d, coalesce(m.x, c.x) AS x FROM {was} c LEFT JOIN (
    SELECT a.k, v.d, CAST((sum(v.x) - ((sum(v.x) % count(*) + count(*)) % count(*))) // count(*) AS BIGINT) AS x
    FROM a{r} a JOIN v USING (rn) GROUP BY a.k, v.d) m ON c.k = m.k AND c.d = m.d)"""
    return sql + f""",
last AS MATERIALIZED ({nearest_of(f"c{rounds}")}),
named AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT rows.vec_id, CAST(last.k AS INTEGER) AS cluster, last.dist AS distance, CAST(sum(last.dist) OVER (PARTITION BY last.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(last.dist) OVER () AS BIGINT) AS inertia, named.centroid_sha256
FROM last JOIN rows USING (rn) JOIN named USING (k)
"""
