"""Retrieval queries: chunks are the documents, queries the benchmark items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions.text import strip, tokenize
from quillon.operators import search as S, vectors as V
from quillon.plans.registry import query
from quillon.staging import shared_dir, stage

CONFIG = S.SearchConfig()
GRID = (-1.0, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9, 0.95)


def chunks_of(table) -> DataFrame:
    return table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), "text")


def queries_of(table) -> DataFrame:
    return table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: lower(x))"
BASE = f"""
chunks AS (SELECT doc_id AS chunk_id, source AS doc_id, doc_id AS ord, text FROM documents),
queries AS (SELECT item_id AS query_id, text AS question FROM benchmark),
tokens AS (SELECT chunk_id, unnest({TOKENS.format('text')}) AS term FROM chunks),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('question')}) AS term FROM queries) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln((SELECT count(*) FROM chunks) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raws) * 0.25 ELSE raw END AS idf FROM raws),
lens AS (SELECT chunk_id, sum(tf) AS dl FROM post GROUP BY chunk_id),
avgs AS (SELECT sum(dl)::DOUBLE / (SELECT count(*) FROM chunks) AS avgdl FROM lens),
bm AS (
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS bm25
  FROM post JOIN asked USING (term) JOIN idfs USING (term) JOIN lens USING (chunk_id), avgs GROUP BY query_id, chunk_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS bm25_rank FROM bm),
buckets AS (SELECT chunk_id, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 16 AS b, sum(tf) AS n FROM post GROUP BY ALL),
qbuckets AS (SELECT query_id, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 16 AS b, sum(qtf) AS n FROM asked GROUP BY ALL),
cn AS (SELECT chunk_id, sum(n * n)::DOUBLE AS nn FROM buckets GROUP BY chunk_id),
qn AS (SELECT query_id, sum(n * n)::DOUBLE AS nn FROM qbuckets GROUP BY query_id),
dots AS (SELECT query_id, chunk_id, sum(buckets.n * qbuckets.n)::DOUBLE AS d FROM buckets JOIN qbuckets USING (b) GROUP BY ALL),
cos AS (
  SELECT q.query_id, c.chunk_id, c.doc_id, c.ord, round(coalesce(d / sqrt(cn.nn * qn.nn), 0), 9) AS cosine
  FROM queries q CROSS JOIN chunks c LEFT JOIN dots USING (query_id, chunk_id) LEFT JOIN cn USING (chunk_id) LEFT JOIN qn USING (query_id)),
cosr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ord) AS vector_rank FROM cos),
fused AS (
  SELECT query_id, chunk_id, max(vector_rank) AS vector_rank, max(bm25_rank) AS bm25_rank,
         round(coalesce(1.0::DOUBLE / (60 + max(vector_rank)), 0) + coalesce(1.0::DOUBLE / (60 + max(bm25_rank)), 0), 9) AS score
  FROM (SELECT query_id, chunk_id, vector_rank, NULL AS bm25_rank FROM cosr WHERE vector_rank <= 50
        UNION ALL SELECT query_id, chunk_id, NULL, bm25_rank FROM bmr WHERE bm25_rank <= 50 AND bm25 > 0)
  GROUP BY query_id, chunk_id),
pool AS (
  SELECT f.*, c.doc_id, c.ord, c.cosine,
         row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, c.cosine DESC, f.vector_rank NULLS LAST, f.bm25_rank NULLS LAST, c.ord) AS place
  FROM fused f JOIN cos c USING (query_id, chunk_id)),
quota AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY place) AS rd FROM pool WHERE cosine >= 0.55),
taken AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM quota WHERE rd <= 2),
hits AS (SELECT query_id, rank, chunk_id, doc_id, score, cosine, vector_rank, bm25_rank FROM taken WHERE rank <= 5),
gold AS (SELECT q.query_id, c.chunk_id FROM queries q JOIN chunks c ON contains(c.text, q.question))
"""


def _sql(body: str) -> str:
    return f"WITH {BASE} {body}"


@query(f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({TOKENS.format('text')}, ' ')) AS digest FROM documents")
def tokenize_documents(spark, table):
    tokens = tokenize("text")
    return table("documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query(_sql("SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idfs"))
def bm25_idf(spark, table):
    chunks = chunks_of(table)
    post = S.postings(chunks, "chunk_id", "text")
    return S.bm25_weights(post, chunks.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(_sql("SELECT query_id, bm25_rank, chunk_id, round(bm25, 6) AS bm25 FROM bmr WHERE bm25_rank <= 10 AND bm25 > 0"))
def bm25_topk(spark, table):
    top = S.bm25_top(S.bm25_scores(chunks_of(table), queries_of(table), 10), 10)
    return top.select("query_id", "bm25_rank", "chunk_id", F.round("bm25", 6).alias("bm25"))


@query(
    """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END * 1000) AS BIGINT) AS VARCHAR)), ',') AS unit
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)"""
)
def l2_normalize(spark, table):
    unit = F.transform(S.l2_normalize(F.col("embedding")), lambda x: F.round(x * 1000).cast("long").cast("string"))
    return table("embeddings").select("vec_id", F.array_join(unit, ",").alias("unit"))


CENTRES = """
parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centres AS (SELECT label, i, round(avg(x), 6) AS c FROM parts GROUP BY label, i),
pairs AS (
  SELECT c.label AS query_id, p.vec_id, any_value(p.label) AS label, round(sum(c * x) / sqrt(sum(c * c) * sum(x * x)), 9) AS cosine, round(sqrt(sum((c - x) * (c - x))), 9) AS distance
  FROM parts p JOIN centres c USING (i) GROUP BY c.label, p.vec_id)
"""


def _centres(table) -> tuple[DataFrame, DataFrame]:
    """Vectors, and the mean of each label; the labels are the stated query set."""
    vectors = table("embeddings").select("vec_id", "label", "embedding")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("c"))
    centres = means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s.c).alias("c"))
    return vectors.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("v")), centres.select("query_id", F.col("c").alias("v"))


@query(f"WITH {CENTRES} SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank, vec_id, round(cosine, 6) AS cosine FROM pairs) WHERE rank <= 10")
def vector_topk(spark, table):
    return S.vector_top(*_centres(table), 10).select("query_id", F.col("vector_rank").alias("rank"), F.col("chunk_id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


@query(f"WITH {CENTRES} SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank, vec_id, round(cosine, 6) AS cosine FROM pairs) WHERE rank <= 10")
def vector_cells(spark, table):
    """The same from an index written by cells, with every cell looked at."""
    vectors, centres = _centres(table)
    path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    V.write_cells(vectors, path, cells=8)
    hits = V.CellIndex(spark, path, probes=8).search(centres, 10)
    return hits.select("query_id", F.col("vector_rank").alias("rank"), F.col("chunk_id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


@query(
    f"""WITH {CENTRES}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM pairs),
q AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY place) AS rd FROM placed WHERE place <= 50)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, vec_id, label, round(cosine, 6) AS cosine FROM q WHERE rd <= 2) WHERE rank <= 5"""
)
def vector_search(spark, table):
    """Vector strategy: no threshold by default, two of a label at most."""
    config = S.SearchConfig(strategy="vector")
    hits = S.take(S.vector_pool(*_centres(table), config), config, config.cutoff(None))
    return hits.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), F.col("doc_id").alias("label"), F.round("cosine", 6).alias("cosine"))


@query(
    f"""WITH {CENTRES} SELECT query_id, count(*) FILTER (distance < 0.8) AS n_found, round(min(distance), 6) AS nearest,
CASE WHEN count(*) FILTER (distance < 0.8) > 0 THEN 'found' ELSE 'nothing below the limit' END AS status FROM pairs GROUP BY query_id"""
)
def vector_l2_threshold(spark, table):
    """Labels against all vectors; only tallies leave a task."""
    vectors, centres = _centres(table)
    gap = F.aggregate(F.zip_with("v", "c", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = vectors.crossJoin(F.broadcast(centres.select("query_id", F.col("v").alias("c")))).select("query_id", F.round(F.sqrt(gap), 9).alias("distance"))  # a row for each label
    near = F.count(F.when(F.col("distance") < 0.8, 1))
    status = F.when(near > 0, "found").otherwise("nothing below the limit")
    return pairs.groupBy("query_id").agg(near.alias("n_found"), F.round(F.min("distance"), 6).alias("nearest"), status.alias("status"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("score", "cosine")})


@query(_sql("SELECT query_id, chunk_id, vector_rank, bm25_rank, round(score, 6) AS score, place FROM pool"))
def rrf_fusion(spark, table):
    pool = S.pool_of(chunks_of(table), queries_of(table), CONFIG)
    return pool.select("query_id", "chunk_id", "vector_rank", "bm25_rank", F.round("score", 6).alias("score"), "place")


HITS = "SELECT query_id, rank, chunk_id, doc_id, round(score, 6) AS score, round(cosine, 6) AS cosine, vector_rank, bm25_rank FROM hits"


@query(_sql(HITS))
def hybrid_search(spark, table):
    """The flagship: both legs, fused, thresholded, two chunks of a source at most, five in all."""
    return _rounded(S.search(chunks_of(table), queries_of(table), CONFIG))


@query(_sql("SELECT query_id, array_to_string(list(CAST(chunk_id AS VARCHAR) ORDER BY rank), ',') AS chunk_ids, count(*) AS n_hits FROM hits GROUP BY query_id"))
def batch_contexts(spark, table):
    found = S.contexts(S.search(chunks_of(table), queries_of(table), CONFIG))
    return found.select("query_id", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"), "n_hits")


@query(_sql("SELECT doc_id, count(*) AS n_hits FROM hits GROUP BY doc_id"))
def hits_per_doc(spark, table):
    return S.search(chunks_of(table), queries_of(table), CONFIG).groupBy("doc_id").agg(F.count("*").alias("n_hits"))


@query(
    _sql(
        """SELECT h.query_id, 'kb::' || h.doc_id || '::' || substr(md5(h.doc_id || c.text), 1, 12) AS ref, h.doc_id AS source,
CASE WHEN length(c.text) > 300 THEN substr(c.text, 1, 300) ELSE c.text END AS detail, round(h.cosine, 4) AS score FROM hits h JOIN chunks c USING (chunk_id)"""
    )
)
def hit_projection(spark, table):
    """Hits as evidence records; texts are joined only to the hits."""
    chunks = chunks_of(table)
    hits = S.search(chunks, queries_of(table), CONFIG).select("query_id", "chunk_id", "doc_id", "cosine").join(chunks.select("chunk_id", "text"), "chunk_id")
    ref = F.concat(F.lit("kb::"), "doc_id", F.lit("::"), F.substring(F.md5(F.concat("doc_id", "text")), 1, 12))
    return hits.select("query_id", ref.alias("ref"), F.col("doc_id").alias("source"), F.substring("text", 1, 300).alias("detail"), F.round("cosine", 4).alias("score"))


@query(
    _sql(
        """SELECT count(*) AS n_queries, round(avg(n), 6) AS avg_hits, count(*) FILTER (n = 0) AS n_empty
FROM (SELECT q.query_id, count(h.chunk_id) AS n FROM queries q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id)"""
    )
)
def retrieval_stats(spark, table):
    queries = queries_of(table)
    per_query = queries.join(S.search(chunks_of(table), queries, CONFIG), "query_id", "left").groupBy("query_id").agg(F.count("chunk_id").alias("n"))
    return per_query.agg(F.count("*").alias("n_queries"), F.round(F.avg("n"), 6).alias("avg_hits"), F.count(F.when(F.col("n") == 0, 1)).alias("n_empty"))


def gold_of(table) -> DataFrame:
    """(query_id, chunk_id) where the document holds the item's whole text; items are the stated query set.

    A document is looked into only for the items whose rarest inner token it
    has: within a text that holds the item that token is a whole one. Items of
    fewer than three tokens are looked for in every document.
    """
    chunks = chunks_of(table).select("chunk_id", "text")
    inner = F.slice("tokens", 2, F.greatest(F.lit(0), F.size("tokens") - 2))
    items = stage(queries_of(table).select("query_id", "question", tokenize("question").alias("tokens")).select("query_id", "question", F.explode_outer(F.array_distinct(inner)).alias("term")), "items")
    asked = items.where("term is not null").select("term").distinct()
    held = chunks.select("chunk_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))
    held = stage(held.join(asked, "term", "left_semi"), "asked_terms")  # each text is tokenised once; only asked terms are written
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rarest = items.join(df, "term", "left").groupBy("query_id", "question").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "term")).alias("r"))
    rarest = stage(rarest.select("query_id", "question", "r.term"), "rarest")
    near = held.join(rarest.where("term is not null"), "term").select("query_id", "question", "chunk_id")
    found = near.join(chunks, "chunk_id").where(F.contains("text", "question")).select("query_id", "chunk_id")
    few = rarest.where("term is null")
    short = few.join(chunks, F.contains("text", "question")).select("query_id", "chunk_id") if few.limit(1).count() else found.limit(0)
    return stage(found.unionByName(short), "gold")


@query(
    _sql(
        """, n AS (SELECT q.query_id, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = q.query_id) AS relevant,
  (SELECT count(*) FROM hits h WHERE h.query_id = q.query_id) AS returned,
  EXISTS (SELECT 1 FROM hits h JOIN gold g USING (query_id, chunk_id) WHERE h.query_id = q.query_id) AS hit FROM queries q)
SELECT count(*) FILTER (relevant) AS n_relevant, round(avg(CASE WHEN relevant THEN hit::INT END), 6) AS recall, round(avg(returned), 6) AS avg_returned,
  coalesce(string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) FILTER (relevant AND NOT hit), '') AS misses FROM n""".replace("WITH", "")
    )
)
def recall_at_k(spark, table):
    queries, gold = queries_of(table), gold_of(table)
    hits = S.search(chunks_of(table), queries, CONFIG).select("query_id", "chunk_id")
    found = hits.join(gold.withColumn("g", F.lit(1)), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("returned"), F.max("g").alias("hit"))
    rows = queries.select("query_id").join(gold.select("query_id").distinct().withColumn("relevant", F.lit(1)), "query_id", "left").join(found, "query_id", "left")
    missed = F.col("relevant").isNotNull() & F.col("hit").isNull()
    return rows.agg(
        F.count("relevant").alias("n_relevant"),
        F.round(F.avg(F.when(F.col("relevant") == 1, F.coalesce("hit", F.lit(0)))), 6).alias("recall"),
        F.round(F.avg(F.coalesce("returned", F.lit(0))), 6).alias("avg_returned"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(missed, F.col("query_id")))), lambda x: x.cast("string")), ",").alias("misses"),
    )


GRID_SQL = f""", grid AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS threshold),
gq AS (SELECT threshold, pool.*, row_number() OVER (PARTITION BY threshold, query_id, doc_id ORDER BY place) AS rd FROM pool, grid WHERE cosine >= threshold),
gt AS (SELECT *, row_number() OVER (PARTITION BY threshold, query_id ORDER BY place) AS rank FROM gq WHERE rd <= 2),
gh AS (SELECT threshold, gt.query_id, count(*) AS n, max(CASE WHEN gold.chunk_id IS NULL THEN 0 ELSE 1 END) AS hit
  FROM gt LEFT JOIN gold ON gt.query_id = gold.query_id AND gt.chunk_id = gold.chunk_id WHERE rank <= 5 GROUP BY ALL),
gw AS (SELECT g.threshold, q.query_id, q.query_id IN (SELECT query_id FROM gold) AS relevant, coalesce(n, 0) AS n, coalesce(hit, 0) AS hit
  FROM queries q CROSS JOIN grid g LEFT JOIN gh ON gh.threshold = g.threshold AND gh.query_id = q.query_id),
gr AS (SELECT threshold, count(*) FILTER (relevant) AS n_relevant, round(avg(CASE WHEN relevant THEN hit END), 6) AS recall,
  round(avg(CASE WHEN NOT relevant THEN (n > 0)::INT END), 6) AS false_hit, round(avg(n), 6) AS avg_returned FROM gw GROUP BY threshold)
"""


def _grid(table) -> DataFrame:
    queries = queries_of(table)
    return S.calibrate(S.pool_of(chunks_of(table), queries, CONFIG), gold_of(table), queries, GRID, CONFIG)


@query(_sql(GRID_SQL + "SELECT * FROM gr"))
def calibrate_grid(spark, table):
    return _grid(table)


@query(_sql(GRID_SQL + "SELECT threshold, recall, false_hit FROM gr WHERE coalesce(false_hit, 0) <= 0.5 ORDER BY recall DESC, threshold DESC LIMIT 1"))
def calibrate_best(spark, table):
    """The best threshold: recall first, then the threshold, among those whose false hits are few."""
    return _grid(table).where(F.coalesce("false_hit", F.lit(0.0)) <= 0.5).orderBy(F.desc("recall"), F.desc("threshold")).limit(1).select("threshold", "recall", "false_hit")


CITED = """, answers AS (SELECT query_id, 'See ' || string_agg('[chunk_id: kb::d' || chunk_id || '::x]', ' ' ORDER BY rank) || ' and kb::other::1.' AS answer,
  list('kb::d' || chunk_id || '::x' ORDER BY rank) AS valid FROM hits GROUP BY query_id),
cited AS (SELECT query_id, valid, list_distinct(list_concat(regexp_extract_all(answer, 'chunk_id: ([A-Za-z0-9_:.-]{4,64})', 1), regexp_extract_all(answer, '(kb::[A-Za-z0-9_:.-]{1,48}::[A-Za-z0-9_-]+)', 1))) AS c FROM answers)
"""


@query(_sql(CITED + "SELECT query_id, len(c) AS n_citations, round(len(list_intersect(c, valid))::DOUBLE / len(c), 6) AS locatable FROM cited"))
def citation_locatable(spark, table):
    """Hits rendered as cited answers, one invented citation in each."""
    from quillon.functions.text import extract_citations, locatable_rate

    hits = S.search(chunks_of(table), queries_of(table), CONFIG)
    ids = S.contexts(hits).withColumn("valid", F.transform("chunk_ids", lambda x: F.concat(F.lit("kb::d"), x.cast("string"), F.lit("::x"))))
    answer = F.concat(F.lit("See "), F.array_join(F.transform("valid", lambda x: F.concat(F.lit("[chunk_id: "), x, F.lit("]"))), " "), F.lit(" and kb::other::1."))
    cited = ids.withColumn("c", extract_citations(answer, F.array().cast("array<string>")))
    return cited.select("query_id", F.size("c").cast("long").alias("n_citations"), F.round(locatable_rate(F.col("c"), F.col("valid")), 6).alias("locatable"))


@query("SELECT item_id, length(text) AS n_chars, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS preview FROM (SELECT item_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)")
def preview(spark, table):
    from quillon.functions.text import preview as shorten

    return table("benchmark").select("item_id", F.length("text").cast("long").alias("n_chars"), shorten(F.col("text")).alias("preview"))


@query("SELECT count(*) AS n_documents, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) > 0) AS n_readable FROM documents")
def scan_text_nonempty(spark, table):
    return table("documents").agg(F.count("*").alias("n_documents"), F.count(F.when(F.length(strip(F.coalesce("text", F.lit("")))) > 0, 1)).alias("n_readable"))


@query(
    """WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, i, CAST(CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS DOUBLE) / 255 - 0.5 AS x FROM b, range(8) t(i)), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY doc_id)
SELECT doc_id, CAST(i AS BIGINT) AS i, round(x / norm, 6) AS x FROM v JOIN n USING (doc_id)"""
)
def digest_embedding(spark, table):
    """Vectors that depend on nothing but the text's digest."""
    rows = S.digest_vectors(table("documents").where("text is not null"), "doc_id", "text")
    return rows.select("doc_id", F.posexplode("v").alias("i", "x")).select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
