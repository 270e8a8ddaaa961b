"""Snapshots, logs, deduplication and sampling over documents and events.

The older snapshot of the documents has other texts where the length is a
multiple of 7, lacks those whose digest begins with 0, and the newer one lacks
those whose digest begins with f, so every row of the table takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.text import hash_bucket as bucket_of
from quillon.operators import maintenance as M
from quillon.plans.registry import query


def snapshots(table):
    docs = table("documents").select("doc_id", F.md5("text").alias("sha"), "text", "source")
    changed = F.when(F.length("text") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.col("sha"))
    old = docs.where(~F.col("sha").startswith("0")).withColumn("sha", changed)
    return old, docs.where(~F.col("sha").startswith("f"))


SNAP = """d AS (SELECT doc_id, md5(text) AS sha, text, source FROM documents),
old AS (SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN md5(text || '!') ELSE sha END AS sha, text, source FROM d WHERE NOT starts_with(sha, '0')),
new AS (SELECT * FROM d WHERE NOT starts_with(sha, 'f'))"""


@query(
    f"""WITH {SNAP} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed'
WHEN o.sha = n.sha THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.doc_id = n.doc_id"""
)
def manifest_diff(spark, table):
    old, new = snapshots(table)
    return M.manifest_diff(old, new, "doc_id", "sha")


@query(
    f"""WITH {SNAP}, joined AS (SELECT n.doc_id, o.sha IS NOT NULL AS reused FROM new n LEFT JOIN old o ON o.doc_id = n.doc_id AND o.sha = n.sha)
SELECT reused, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM joined GROUP BY reused"""
)
def incremental_reuse(spark, table):
    """Chunks are known by document and digest; only those not reused need an embedding."""
    old, new = snapshots(table)
    key = F.concat_ws(":", "doc_id", "sha").alias("chunk_id")
    found = M.reuse(new.select(key, "doc_id"), old.select(key, F.col("sha").alias("embedding")), "chunk_id", "embedding")
    return found.groupBy("reused").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@query(f"WITH {SNAP} SELECT source, count(*) AS removed FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id AND n.sha = o.sha) GROUP BY source")
def incremental_removed(spark, table):
    old, new = snapshots(table)
    return old.join(new.select("doc_id", "sha"), ["doc_id", "sha"], "left_anti").groupBy("source").agg(F.count("*").alias("removed"))


ACQ = """a AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS license FROM documents WHERE NOT starts_with(md5(text), '0')),
b AS (SELECT doc_id, 'late' AS source, lang || '-2' AS license FROM documents WHERE NOT starts_with(md5(text), 'f'))"""


def acquisitions(table):
    docs = table("documents")
    sha = F.md5("text")
    a = docs.where(~sha.startswith("0")).select("doc_id", "source", F.when(F.col("lang") != "en", F.col("lang")).alias("license"))
    b = docs.where(~sha.startswith("f")).select("doc_id", F.lit("late").alias("source"), F.concat("lang", F.lit("-2")).alias("license"))
    return a, b


@query(f"WITH {ACQ} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.source, b.source) AS source, coalesce(a.license, b.license) AS license, a.doc_id IS NULL AS added FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def acq_upsert(spark, table):
    return M.upsert_missing(*acquisitions(table), "doc_id")


@query(f"WITH {ACQ} SELECT a.doc_id, coalesce(b.source, a.source) AS source, coalesce(b.license, a.license) AS license FROM a LEFT JOIN b ON a.doc_id = b.doc_id")
def acq_update(spark, table):
    return M.update_by_key(*acquisitions(table), "doc_id")


@query(
    """WITH r AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'fr' THEN '.xls' ELSE '.md' END AS path FROM documents WHERE NOT starts_with(md5(text), '0')),
f AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'fr' THEN '.xls' ELSE '.md' END AS path FROM documents WHERE NOT starts_with(md5(text), 'f'))
SELECT coalesce(r.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN r.path IS NULL THEN 'unregistered' WHEN NOT ends_with(r.path, '.md') THEN 'unsupported' ELSE 'ok' END AS status
FROM r FULL JOIN f ON r.path = f.path"""
)
def registry_reconcile(spark, table):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", ".xls").otherwise(".md")).alias("path")
    docs = table("documents")
    return M.reconcile(docs.where(~F.md5("text").startswith("0")).select(path), docs.where(~F.md5("text").startswith("f")).select(path), "path")


@query(f"WITH {SNAP} SELECT n.doc_id, n.sha FROM new n ANTI JOIN old o ON n.doc_id = o.doc_id")
def archive_anti_join(spark, table):
    """What an archive that never overwrites would take."""
    old, new = snapshots(table)
    return new.join(old.select("doc_id"), "doc_id", "left_anti").select("doc_id", "sha")


@query(f"WITH {SNAP} SELECT n.doc_id AS chunk_id, o.source AS license, n.source FROM new n JOIN old o ON n.doc_id = o.doc_id")
def chunks_with_source(spark, table):
    old, new = snapshots(table)
    return new.select("doc_id", "source").join(old.select("doc_id", F.col("source").alias("license")), "doc_id").select(F.col("doc_id").alias("chunk_id"), "license", "source")


@query("SELECT md5(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, table):
    return M.duplicates(table("documents"), [F.md5("text").alias("sha")], "doc_id")


@query("SELECT lang, md5(text) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def dedupe_first(spark, table):
    docs = table("documents").select("lang", F.md5("text").alias("sha"), "doc_id")
    return M.first_by_key(docs, ["lang", "sha"], ["doc_id"])


FINGER = "md5(substr(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_]+', '', 'g'), 1, 1200)) || '-' || CAST(CAST(round_even(length(text) / 200.0, 0) AS BIGINT) AS VARCHAR)"


@query(f"SELECT {FINGER} AS fingerprint, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedupe_fingerprint(spark, table):
    docs = table("documents").select(M.fingerprint(F.col("text")).alias("fingerprint"), "doc_id")
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS nth FROM documents)
SELECT doc_id, seq, 'kb::' || source || '::' || substr(md5(source || '||' || text || CASE WHEN nth = 1 THEN '' ELSE '||#' || CAST(nth AS VARCHAR) END), 1, 12) AS chunk_id FROM s"""
)
def chunk_ids(spark, table):
    return M.with_chunk_ids(table("documents"), "source", "text", "doc_id").select("doc_id", "seq", "chunk_id")


@query("SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_docs, count(DISTINCT md5(text)) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents")
def corpus_stats(spark, table):
    return table("documents").agg(
        F.count("*").alias("n_chunks"), F.count_distinct("source").alias("n_docs"), F.count_distinct(F.md5("text")).alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


@query("SELECT CAST('0x' || substr(md5(text), 1, 4) AS BIGINT) % 48 AS bucket, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def hash_bucket(spark, table):
    """48 volumes by the hash of the text."""
    return table("documents").groupBy(bucket_of(F.col("text"), 48).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, substr(md5(text), 1, 10) AS answer_md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def answer_md5(spark, table):
    return table("documents").select("doc_id", F.substring(F.md5("text"), 1, 10).alias("answer_md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query(
    """WITH h AS (SELECT doc_id, source, lang, md5('20240601|' || source || '|' || lang || '|' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY h, doc_id) AS r FROM h),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r2 FROM u WHERE r <= 2)
SELECT doc_id, source, lang FROM g WHERE r2 <= 5"""
)
def stratified_sample(spark, table):
    docs = table("documents").select("doc_id", "source", "lang", F.col("doc_id").alias("ord"))
    return M.systematic_sample(docs, "source", ["lang"], 20240601, 2, 5).select("doc_id", "source", "lang")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def items_per_dimension(spark, table):
    return M.first_by_key(table("documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 10)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def per_group_cap(spark, table):
    return M.cap_per_group(table("documents"), ["source"], [F.desc(F.length("text")), "doc_id"], 3).select("source", "doc_id")


@query(
    """SELECT source, doc_id, total FROM (SELECT source, doc_id, CAST(sum(length(text)) OVER w AS BIGINT) AS total, row_number() OVER w AS r FROM documents
WINDOW w AS (PARTITION BY source ORDER BY length(text), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE total <= 20000 AND r <= 40"""
)
def size_budget_prefix(spark, table):
    docs = table("documents").select("source", "doc_id", F.length("text").alias("size"))
    return M.prefix_within_budget(docs, ["source"], ["size", "doc_id"], "size", 20000, 40).select("source", "doc_id", "total")


@query(
    """WITH RECURSIVE o AS (SELECT source, doc_id, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, doc_id, r, size <= 20000 AS kept, CASE WHEN size <= 20000 THEN size ELSE 0 END AS total FROM o WHERE r = 1
UNION ALL SELECT o.source, o.doc_id, o.r, f.total + o.size <= 20000, f.total + CASE WHEN f.total + o.size <= 20000 THEN o.size ELSE 0 END FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.r = f.r + 1)
SELECT source, doc_id, CAST(total AS BIGINT) AS total FROM f WHERE kept"""
)
def size_budget_skip(spark, table):
    """In the order of ids, whatever still fits."""
    docs = table("documents").select("source", "doc_id", F.length("text").cast("long").alias("size"))
    return M.fit_within_budget(docs, ["source"], ["doc_id"], "size", 20000).select("source", "doc_id", "total")


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE n <= 90 OR r IN (SELECT i * n // 90 FROM range(90) t(i))"""
)
def even_step_sample(spark, table):
    """90 documents at even steps of a seeded order."""
    return M.spread_sample(table("documents").select("doc_id"), F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), ["doc_id"], 90)


@query(
    """SELECT path, CAST(greatest(1, least((length(path) - 12) * 3, 2)) AS BIGINT) AS k FROM (SELECT source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'fr' THEN '.xls' WHEN lang = 'de' THEN '.JSON' ELSE '.json' END AS path FROM documents)
WHERE starts_with(path, 'src1/') AND ends_with(lower(path), '.json')"""
)
def path_filter(spark, table):
    """Files below one folder by their suffix; ``k`` is a number asked for, kept from 1 to 2."""
    suffix = F.when(F.col("lang") == "fr", ".xls").when(F.col("lang") == "de", ".JSON").otherwise(".json")
    paths = table("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return paths.where(M.in_folder(F.col("path"), "src1/", [".json"])).select("path", M.within_cap((F.length("path") - 12) * 3, 2).cast("long").alias("k"))


# ------------------------------------------------------------------ logs

LOG = "l AS (SELECT user_id AS id, event_id AS ord, event_type AS dimension, event_type = 'error' AS truncated, value AS score, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS fp FROM events)"


def log_of(table):
    k = F.get_json_object("props", "$.k").cast("long")
    return table("events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.col("event_type").alias("dimension"), (F.col("event_type") == "error").alias("truncated"), F.col("value").alias("score"), (k % 3).alias("fp")
    )


@query(f"WITH {LOG} SELECT id, CASE WHEN truncated THEN 'truncated' ELSE 'done' END AS state FROM l WHERE fp = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1")
def resume_done_set(spark, table):
    return M.done_set(log_of(table), "id", "ord", F.col("fp") == 0)


@query(f"WITH {LOG} SELECT id, ord, dimension, round(score, 6) AS score FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1")
def latest_prediction(spark, table):
    return M.latest(log_of(table), ["id"], ["ord"]).select("id", "ord", "dimension", F.round("score", 6).alias("score"))


@query(
    f"""WITH {LOG}, done AS (SELECT id, truncated FROM l WHERE fp = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)
SELECT DISTINCT id FROM l WHERE id NOT IN (SELECT id FROM done WHERE NOT truncated)"""
)
def resume_pending(spark, table):
    log = log_of(table)
    return M.pending(log.select("id").distinct(), M.done_set(log, "id", "ord", F.col("fp") == 0), "id")


@query(
    f"""WITH {LOG}, j AS (SELECT id, fp FROM l WHERE dimension <> 'error' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
a AS (SELECT id, fp FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)
SELECT a.id, coalesce(substr(md5(CAST(a.fp AS VARCHAR)), 1, 10) = substr(md5(CAST(j.fp AS VARCHAR)), 1, 10), FALSE) AS valid FROM a LEFT JOIN j ON a.id = j.id"""
)
def judge_cache_valid(spark, table):
    """A judgment holds as long as the digest of the answer it judged is that of the current answer."""
    digest = F.substring(F.md5(F.col("fp").cast("string")), 1, 10)
    log = log_of(table)
    answers = M.latest(log, ["id"], ["ord"]).select("id", digest.alias("now"))
    judged = M.latest(log.where("dimension <> 'error'"), ["id"], ["ord"]).select("id", digest.alias("then"))
    return answers.join(judged, "id", "left").select("id", F.coalesce(F.col("now") == F.col("then"), F.lit(False)).alias("valid"))


@query("SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 8")
def recent_tail(spark, table):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table("events").select("user_id", "event_id", r.cast("long").alias("r")).where("r <= 8")


@query(
    """SELECT user_id, event_id, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / count(*) OVER w / 100, 6) AS running_mean, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS negatives
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def judge_running_mean(spark, table):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    return table("events").select(
        "user_id", "event_id", F.round(F.sum(cents).over(w).cast("double") / F.count("*").over(w) / 100, 6).alias("running_mean"), F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("negatives")
    )


@query("SELECT event_type AS dimension, count(*) AS done, count(value) AS scored, count(*) FILTER (value >= 10) AS correct, max(ts) AS updated_at FROM events GROUP BY 1")
def progress_by_dimension(spark, table):
    from quillon.streaming.progress import progress

    return progress(table("events"))


@query(
    """WITH r AS (SELECT user_id, event_type AS stage, ts AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
n AS (SELECT *, (SELECT max(ts) FROM events) AS now FROM r),
a AS (SELECT user_id, stage FROM n WHERE stage <> 'purchase' AND updated_at >= now - INTERVAL 180 MINUTE)
SELECT user_id, stage, 'active' AS kind FROM a
UNION ALL SELECT user_id, stage, 'newest' FROM (SELECT * FROM n ORDER BY updated_at DESC, user_id LIMIT 3) WHERE NOT EXISTS (SELECT 1 FROM a)"""
)
def active_runs(spark, table):
    """Runs not finished and updated within three hours of the last event; the newest three if there are none."""
    events = table("events").select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), F.col("ts").alias("updated_at"))
    now = events.agg(F.max("updated_at").alias("now"))
    runs = M.latest(events, ["user_id"], ["ord"]).crossJoin(F.broadcast(now))
    active = runs.where("stage <> 'purchase' and updated_at >= now - interval 180 minutes")
    none = active.agg(F.count("*").alias("n")).where("n = 0")
    newest = runs.orderBy(F.desc("updated_at"), "user_id").limit(3).crossJoin(none)
    return active.select("user_id", "stage", F.lit("active").alias("kind")).unionByName(newest.select("user_id", "stage", F.lit("newest").alias("kind")))
