"""Lexical, vector and hybrid retrieval over chunk tables.

Chunks are (chunk_id, doc_id, ord, text), queries (query_id, question).  Texts
stay out of the shuffles: postings and vectors carry ids alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.text import tokenize
from quillon.staging import stage

#: Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Buckets of the hashed bag-of-tokens embedding.
DIMENSIONS = 16
#: Questions scored at once, and rows of a batch scored at once.
QUESTIONS, ROWS = 256, 4096
#: Rows whose weights of all asked terms are held at once.
LEXICAL_ROWS = 256
#: Bytes of question vectors that a pass over all vectors takes along.
QUESTION_BYTES = 64 << 20
#: Rows of questions (terms, vectors, candidates) up to which they are sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class SearchConfig:
    """Defaults of retrieval; checked when made."""

    top_k: int = 5
    threshold: float = 0.55
    strategy: str = "hybrid"
    rrf_k: int = 60
    doc_quota: int = 2
    candidate_pool: int = 50

    def __post_init__(self) -> None:
        if self.strategy not in ("hybrid", "vector"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if min(self.top_k, self.rrf_k, self.doc_quota) < 1 or self.candidate_pool < self.top_k:
            raise ValueError("top_k, rrf_k and doc_quota are 1 at least, candidate_pool top_k at least")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold is between 0 and 1")

    @property
    def pool(self) -> int:
        return max(self.candidate_pool, 5 * self.top_k)

    def cutoff(self, threshold: float | None) -> float | None:
        """Null means the configured value for hybrid, and no filter for vector search."""
        return threshold if threshold is not None else self.threshold if self.strategy == "hybrid" else None


# ------------------------------------------------------------------ lexical


def postings(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return texts.select(F.col(id_col), F.explode(tokenize(text_col)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def bm25_weights(post: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf becomes EPSILON times the mean over all terms. ``n_chunks`` has one row, n."""
    return _idf(post.groupBy("term").agg(F.count("*").alias("df")), n_chunks)


def _idf(df: DataFrame, n_chunks: DataFrame) -> DataFrame:
    df = stage(df, "frequencies").crossJoin(F.broadcast(n_chunks))  # one row
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, ord, bm25) of the chunks that share a term with the query; repeated query tokens count again.

    With ``k`` each task keeps only what may be among the k best of a query, so
    pairs are neither listed nor shuffled.  The asked terms and their weights
    go to every task if there are BROADCAST_ROWS at most.
    """
    held = stage(chunks.select("chunk_id", "ord", tokenize("text").alias("tokens")), "tokens")
    sizes = held.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total"))
    found = held.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = _idf(found, sizes.select("n"))
    asked = queries.select("query_id", F.explode(tokenize("question")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = stage(asked.join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "asked")
    if k is None:
        return _bm25_joined(held, sizes, asked)
    one = sizes.first()
    rows = asked.orderBy("query_id", "term").toArrow()  # BROADCAST_ROWS at most
    kind = held.schema["chunk_id"].dataType.simpleString(), held.schema["ord"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    ddl = f"query_id {kind[2]}, chunk_id {kind[0]}, ord {kind[1]}, bm25 double"
    return held.mapInArrow(_bm25_batches(rows, (one.total or 0) / max(1, one.n), k), ddl).withColumn("bm25", F.round("bm25", 9))


def _bm25_joined(held: DataFrame, sizes: DataFrame, asked: DataFrame) -> DataFrame:
    post = held.select("chunk_id", "ord", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("chunk_id", "ord", "dl", "term").agg(F.count("*").alias("tf"))
    hits = post.join(asked, "term").crossJoin(F.broadcast(sizes.select((F.col("total") / F.col("n")).alias("avgdl"))))  # one row
    gain = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id", "ord").agg(F.round(F.sum(gain), 9).alias("bm25"))


def _best(scores: np.ndarray, k: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what may be among the k best of its column once scores are rounded to 9 places."""
    kept = scores if among is None else np.where(among, scores, -np.inf)
    least = np.partition(kept, len(kept) - k, axis=0)[len(kept) - k] - 2e-9 if len(kept) > k else np.full(kept.shape[1], -np.inf)
    near = kept >= least
    return np.nonzero(near if among is None else near & among)


def _bm25_batches(asked: pa.Table, average: float, k: int):
    """asked: (query_id, term, weight), a query's rows together."""
    ids, at = np.unique(asked.column("query_id").to_numpy(zero_copy_only=False), return_inverse=True)
    terms = pc.unique(asked.column("term"))
    which = pc.index_in(asked.column("term"), value_set=terms).to_numpy()
    weight = asked.column("weight").to_numpy()
    id_type = asked.schema.field("query_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                column = batch.column("tokens")
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.fill_null(pc.index_in(column.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)[found >= 0]
                pair, tf = np.unique(row * len(terms) + found[found >= 0], return_counts=True)
                row, term = pair // max(1, len(terms)), pair % max(1, len(terms))
                gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[row] / average)) if len(tf) else np.zeros(0)
                for first in range(0, len(ids), QUESTIONS):
                    mine = (at >= first) & (at < first + QUESTIONS)
                    used, where = np.unique(which[mine], return_inverse=True)
                    table = np.zeros((len(used), min(QUESTIONS, len(ids) - first)))
                    table[where, at[mine] - first] = weight[mine]
                    place = np.searchsorted(used, term)
                    real = (place < len(used)) & (used[np.minimum(place, len(used) - 1)] == term)
                    scores, shared = np.zeros((len(sizes), table.shape[1])), np.zeros((len(sizes), table.shape[1]), dtype=bool)
                    asked_in = (table != 0).astype(np.float32)
                    for top in range(0, len(sizes), LEXICAL_ROWS):  # the chunks' weights of all asked terms, for a few chunks at once
                        some = real & (row >= top) & (row < top + LEXICAL_ROWS)
                        held = np.zeros((min(LEXICAL_ROWS, len(sizes) - top), len(used)))
                        held[row[some] - top, place[some]] = gain[some]
                        scores[top : top + LEXICAL_ROWS] = held @ table
                        shared[top : top + LEXICAL_ROWS] = (held > 0).astype(np.float32) @ asked_in > 0
                    r, q = _best(scores, k, shared)
                    score = scores[r, q]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[q + first], id_type), batch.column("chunk_id").take(pa.array(r)), batch.column("ord").take(pa.array(r)), pa.array(score)],
                        names=["query_id", "chunk_id", "ord", "bm25"],
                    )

    return run


def bm25_top(scores: DataFrame, k: int) -> DataFrame:
    """The k best by score, ties by chunk order; cut to k before scores of 0 or less are dropped."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "ord"))
    return scores.withColumn("bm25_rank", rank.cast("long")).where(F.col("bm25_rank") <= k).where("bm25 > 0")


# ------------------------------------------------------------------ vectors


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A unit vector; a zero vector stays zero."""
    norm = l2_norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_vectors(texts: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, v): tokens counted by a hash of them; a text without tokens has a zero vector. Stands in for an embedding model."""
    tokens = F.transform(tokenize(text_col), lambda t: (F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("long") % dimensions).cast("int"))
    one = texts.select(F.col(id_col), F.explode_outer(tokens).alias("b")).groupBy(id_col)
    return one.agg(F.array(*(F.count(F.when(F.col("b") == i, 1)) for i in range(dimensions))).alias("v"))


def digest_vectors(texts: DataFrame, id_col: str, text_col: str, dimensions: int = 8) -> DataFrame:
    """(id, v): the first bytes of the text's SHA-256 over 255, less a half, to length 1; at most 32. A fixed embedding for tests."""
    digest = F.sha2(F.col(text_col), 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255 - 0.5
    return texts.select(F.col(id_col), l2_normalize(F.array(*(byte(i) for i in range(min(dimensions, 32))))).alias("v"))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def cosines(vectors: DataFrame, query_vectors: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, ord, cosine) of a stated query set against all vectors (chunk_id, doc_id, ord, v).

    With ``k`` each task keeps only what may be among the k best of a query, by
    a matrix product for each block of questions.  A pass over the vectors takes
    ``QUESTION_BYTES`` of question vectors along; more take more passes.
    """
    asked = stage(query_vectors.select("query_id", F.col("v").cast("array<double>").alias("q")), "asked")
    vectors = vectors.select("chunk_id", "doc_id", "ord", F.col("v").cast("array<double>").alias("v"))
    if k is None:
        return vectors.crossJoin(asked).select("query_id", "chunk_id", "doc_id", "ord", F.round(cosine(F.col("v"), F.col("q")), 9).alias("cosine"))
    kinds = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *asked.schema)}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "chunk_id", "doc_id", "ord")) + ", cosine double"
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    passes = max(1, -(-size["n"] * (size["width"] or 1) * 8 // QUESTION_BYTES))
    blocks = [asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) for i in range(passes)]
    found = [vectors.mapInArrow(_cosine_batches(block.toArrow(), k), ddl) for block in blocks]
    return reduce(DataFrame.unionByName, found).withColumn("cosine", F.round("cosine", 9))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cosine_batches(asked: pa.Table, k: int):
    names = ("query_id", "chunk_id", "doc_id", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = _matrix(asked.column("q")) if asked.num_rows else np.zeros((0, 0))
        squared = (q * q).sum(axis=1)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                v = _matrix(batch.column("v"))
                own = (v * v).sum(axis=1)
                for first in range(0, len(q), QUESTIONS):
                    norms = np.sqrt(own[:, None] * squared[None, first : first + QUESTIONS])
                    score = np.where(norms == 0, 0.0, v @ q[first : first + QUESTIONS].T / np.where(norms == 0, 1.0, norms))
                    r, c = _best(score, k)
                    rows = pa.array(r)
                    ids = pc.take(asked.column("query_id").combine_chunks(), pa.array(c + first))
                    yield pa.RecordBatch.from_arrays([ids, *(batch.column(n).take(rows) for n in names[1:]), pa.array(score[r, c])], names=[*names, "cosine"])

    return run


def vector_top(vectors: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, doc_id, ord, cosine, vector_rank): the k nearest of each query, ties by chunk order."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "ord"))
    return cosines(vectors, query_vectors, k).withColumn("vector_rank", rank.cast("long")).where(F.col("vector_rank") <= k)


# ------------------------------------------------------------------ fusion


def vector_pool(vectors: DataFrame, query_vectors: DataFrame, config: SearchConfig) -> DataFrame:
    """The candidate pool of pure vector search: its score is the cosine."""
    top = vector_top(vectors, query_vectors, config.pool)
    return top.withColumns({"bm25_rank": F.lit(None).cast("long"), "score": F.col("cosine"), "place": F.col("vector_rank")})


def fuse(vectors: DataFrame, query_vectors: DataFrame, bm25: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, chunk_id, doc_id, ord, cosine, vector_rank, bm25_rank, score, place): the candidate pool in its order.

    Only candidates of the lexical list are looked up among the vectors.
    """
    lexical = stage(bm25_top(bm25, config.pool).select("query_id", F.col("chunk_id").alias("found"), "bm25_rank"), "lexical")
    if lexical.count() <= BROADCAST_ROWS:
        lexical = F.broadcast(lexical)
    asked = query_vectors.select("query_id", F.col("v").alias("q"))
    of_lexical = vectors.join(lexical, F.col("chunk_id") == F.col("found")).join(asked, "query_id")
    of_lexical = of_lexical.select("query_id", "chunk_id", "doc_id", "ord", F.round(cosine(F.col("v"), F.col("q")), 9).alias("cosine"), F.lit(None).cast("long").alias("vector_rank"), "bm25_rank")
    both = vector_top(vectors, query_vectors, config.pool).withColumn("bm25_rank", F.lit(None).cast("long")).unionByName(of_lexical)
    rank_sum = lambda c: F.coalesce(1.0 / (config.rrf_k + F.max(c)), F.lit(0.0))
    full = both.groupBy("query_id", "chunk_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("ord").alias("ord"),
        F.max("cosine").alias("cosine"),
        F.max("vector_rank").alias("vector_rank"),
        F.max("bm25_rank").alias("bm25_rank"),
        F.round(rank_sum("vector_rank") + rank_sum("bm25_rank"), 9).alias("score"),
    )
    order = (F.desc("score"), F.desc("cosine"), F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "ord")
    return full.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def take(pool: DataFrame, config: SearchConfig, threshold: float | Column | None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Threshold, then at most ``doc_quota`` of a document, then the first ``top_k``; ``rank`` counts from 1."""
    kept = pool if threshold is None else pool.where(F.col("cosine") >= threshold)
    of_doc = F.row_number().over(Window.partitionBy(*by, "doc_id").orderBy("place"))
    kept = kept.withColumn("_of_doc", of_doc).where(F.col("_of_doc") <= config.doc_quota)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= config.top_k).drop("_of_doc")


Embed = Callable[[DataFrame, str, str], DataFrame]


def search(chunks: DataFrame, queries: DataFrame, config: SearchConfig | None = None, threshold: float | None = None, embed: Embed = hashed_vectors) -> DataFrame:
    """Hits of every query: query_id, rank, chunk_id, doc_id, score, cosine, vector_rank, bm25_rank.

    Blank questions have no hits.  ``embed(table, id, text)`` gives (id, v).
    """
    config = config or SearchConfig()
    asked = queries.where(F.length(F.regexp_replace(F.coalesce("question", F.lit("")), r"(?U)\s+", "")) > 0)
    hits = take(pool_of(chunks, asked, config, embed), config, config.cutoff(threshold))
    return hits.select("query_id", "rank", "chunk_id", "doc_id", "score", "cosine", "vector_rank", "bm25_rank")


def pool_of(chunks: DataFrame, queries: DataFrame, config: SearchConfig, embed: Embed = hashed_vectors) -> DataFrame:
    """The candidate pool before any threshold, which does not depend on it.

    Vectors are written once with what identifies their chunks.
    """
    vectors = stage(embed(chunks, "chunk_id", "text").join(chunks.select("chunk_id", "doc_id", "ord"), "chunk_id").select("chunk_id", "doc_id", "ord", "v"), "vectors")
    asked = stage(embed(queries, "query_id", "question").select("query_id", "v"), "questions")
    if config.strategy != "hybrid":
        return vector_pool(vectors, asked, config)
    return fuse(vectors, asked, bm25_scores(chunks, queries, config.pool), config)


def contexts(hits: DataFrame) -> DataFrame:
    """One row per query with its chunk ids in order of rank."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x.chunk_id)
    return hits.groupBy("query_id").agg(ordered.alias("chunk_ids"), F.count("*").alias("n_hits"))


def calibrate(pool: DataFrame, gold: DataFrame, queries: DataFrame, thresholds: Sequence[float], config: SearchConfig) -> DataFrame:
    """(threshold, n_relevant, recall, false_hit, avg_returned) for every threshold; -1 is no filter.

    ``gold`` (query_id, chunk_id) names relevant chunks; a query without gold
    is irrelevant.  Quota and k follow the threshold, so the pool is made once
    and taken from once for each threshold.
    """
    spark = pool.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    hits = take(pool.crossJoin(F.broadcast(grid)), config, F.col("threshold"), ("threshold", "query_id"))
    relevant = queries.join(gold.select("query_id").distinct().withColumn("relevant", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("relevant", F.lit(False)).alias("relevant"))
    found = hits.join(gold.withColumn("is_gold", F.lit(1)), ["query_id", "chunk_id"], "left").groupBy("threshold", "query_id").agg(
        F.count("*").alias("n"), F.max(F.coalesce("is_gold", F.lit(0))).alias("hit")
    )
    whole = relevant.crossJoin(F.broadcast(grid)).join(found, ["threshold", "query_id"], "left")
    n = F.coalesce("n", F.lit(0))
    return whole.groupBy("threshold").agg(
        F.count(F.when(F.col("relevant"), 1)).alias("n_relevant"),
        F.round(F.avg(F.when(F.col("relevant"), F.coalesce("hit", F.lit(0)))), 6).alias("recall"),
        F.round(F.avg(F.when(~F.col("relevant"), (n > 0).cast("int"))), 6).alias("false_hit"),
        F.round(F.avg(n), 6).alias("avg_returned"),
    )
