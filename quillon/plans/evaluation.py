"""Evaluation queries: documents stand in for items, labels for judgments, events for runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import evaluation as E
from quillon.plans.registry import query

SCORES = """s AS (SELECT d.doc_id AS id, d.lang AS dimension, d.source AS task, CAST(l.quality AS DOUBLE) AS score, l.quality = 1 AS correct, length(d.text) > 5000 AS truncated, l.toxic AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def scores_of(table):
    """An item per document: quality as score, none pending a label."""
    docs, labels = table("documents"), table("labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("dimension"),
        F.col("source").alias("task"),
        F.col("quality").cast("double").alias("score"),
        (F.col("quality") == 1).alias("correct"),
        (F.length("text") > 5000).alias("truncated"),
        "toxic",
    )


TALLY = """count(*) AS n, count(score) AS scored, count(*) FILTER (correct) AS correct, count(*) FILTER (score IS NULL) AS pending,
count(*) FILTER (truncated) AS truncated, round(avg(score), 4) AS mean"""
ACC = """CASE WHEN scored > 0 THEN round(correct / greatest(scored, 1)::DOUBLE, 4) END AS accuracy,
CASE WHEN scored > 0 THEN round(greatest(0, (correct / scored::DOUBLE + 3.8416::DOUBLE / (2 * scored) - 1.96::DOUBLE * sqrt(correct / scored::DOUBLE * (1 - correct / scored::DOUBLE) / scored + 3.8416::DOUBLE / (4 * scored * scored))) / (1 + 3.8416::DOUBLE / scored)), 4) END AS ci_low,
CASE WHEN scored > 0 THEN round(least(1, (correct / scored::DOUBLE + 3.8416::DOUBLE / (2 * scored) + 1.96::DOUBLE * sqrt(correct / scored::DOUBLE * (1 - correct / scored::DOUBLE) / scored + 3.8416::DOUBLE / (4 * scored * scored))) / (1 + 3.8416::DOUBLE / scored)), 4) END AS ci_high"""


@query(f"WITH {SCORES}, t AS (SELECT dimension, {TALLY} FROM s GROUP BY dimension) SELECT *, {ACC} FROM t")
def summary_by_dimension(spark, table):
    return E.summarize(scores_of(table), ["dimension"])


@query(f"WITH {SCORES} SELECT dimension, task, count(*) AS n, count(*) FILTER (correct) AS correct FROM s GROUP BY dimension, task")
def summary_by_task(spark, table):
    return E.summarize(scores_of(table), ["dimension", "task"]).select("dimension", "task", "n", "correct")


@query(f"WITH {SCORES}, t AS (SELECT {TALLY} FROM s) SELECT *, {ACC} FROM t")
def summary_overall(spark, table):
    return E.summarize(scores_of(table), [])


@query(
    f"""WITH {SCORES}, t AS (SELECT task, count(score) AS scored, count(*) FILTER (correct) AS correct FROM s GROUP BY task)
SELECT task, {ACC.split(' AS accuracy,', 1)[1]} FROM t"""
)
def wilson_ci(spark, table):
    return E.summarize(scores_of(table), ["task"]).select("task", "ci_low", "ci_high")


@query(
    f"""WITH {SCORES} SELECT round(count(*) FILTER (correct)::DOUBLE / count(score), 4) AS accuracy,
round(avg(CASE WHEN dimension = 'en' THEN (toxic = 0)::INT END), 4) AS cited_rate, round(1 - count(*) FILTER (toxic = 1)::DOUBLE / count(toxic), 4) AS safety FROM s"""
)
def headline_metrics(spark, table):
    """Overall accuracy, the conditional rate of one dimension, and compliance, as one row."""
    bad, judged = F.count(F.when(F.col("toxic") == 1, 1)), F.count("toxic")
    return scores_of(table).agg(
        F.round(F.count(F.when(F.col("correct"), 1)) / F.count("score"), 4).alias("accuracy"),
        F.round(F.avg(F.when(F.col("dimension") == "en", (F.col("toxic") == 0).cast("int"))), 4).alias("cited_rate"),
        F.round(1 - bad / judged, 4).alias("safety"),
    )


RUBRIC = f"""{SCORES}, j AS (SELECT dimension, score IS NOT NULL AS ok, score AS norm, coalesce(toxic, 0) AS negatives FROM s),
r AS (SELECT dimension, count(*) AS n, round(avg(coalesce(norm, 0)), 4) AS mean, count(*) FILTER (negatives > 0) AS with_negative, round(count(*) FILTER (negatives > 0)::DOUBLE / count(*), 4) AS negative_rate FROM j WHERE ok GROUP BY dimension)"""


def _rubric(table):
    judged = scores_of(table).select("dimension", F.col("score").isNotNull().alias("ok"), F.col("score").alias("norm"), F.coalesce("toxic", F.lit(0)).alias("negatives"))
    return E.rubric_stats(judged, ["dimension"])


@query(f"WITH {RUBRIC} SELECT * FROM r")
def rubric_stats(spark, table):
    return _rubric(table)


@query(f"WITH {RUBRIC} SELECT round(1 - sum(with_negative)::DOUBLE / sum(n), 4) AS compliance FROM r")
def safety_compliance(spark, table):
    return _rubric(table).agg(F.round(1 - F.sum("with_negative") / F.sum("n"), 4).alias("compliance"))


@query(
    """SELECT event_type AS dimension, round(avg(value) FILTER (user_id % 3 = 0), 6) AS run_a, round(avg(value) FILTER (user_id % 3 = 1), 6) AS run_b, round(avg(value) FILTER (user_id % 3 = 2), 6) AS run_c FROM events GROUP BY 1"""
)
def compare_pivot(spark, table):
    """Three runs side by side; a dimension that a run lacks is null."""
    run = F.element_at(F.array(*map(F.lit, ("run_a", "run_b", "run_c"))), (F.col("user_id") % 3 + 1).cast("int"))
    runs = table("events").withColumn("run", run).groupBy(F.col("event_type").alias("dimension"))
    return runs.pivot("run", ["run_a", "run_b", "run_c"]).agg(F.round(F.avg("value"), 6))


@query("SELECT count(DISTINCT user_id) AS n_items, round(avg(value), 6) AS mean_score, CAST(CAST(round(avg((event_type = 'purchase')::INT) * 1000) AS BIGINT) AS VARCHAR) || ' per mille' AS share FROM events")
def run_summary_row(spark, table):
    share = F.round(F.avg((F.col("event_type") == "purchase").cast("int")) * 1000).cast("long").cast("string")
    return table("events").agg(F.count_distinct("user_id").alias("n_items"), F.round(F.avg("value"), 6).alias("mean_score"), F.concat(share, F.lit(" per mille")).alias("share"))


@query(
    """WITH j AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'wrong' END AS verdict, doc_id FROM labels)
SELECT count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) AS n FROM j"""
)
def verdict_tally(spark, table):
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "partial").otherwise("wrong")
    rows = table("labels").select(verdict.alias("v"))
    return rows.agg(*(F.count(F.when(F.col("v") == x, 1)).alias(x) for x in ("correct", "partial", "wrong")), F.count("*").alias("n"))


@query(
    """SELECT role, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS BIGINT) AS n_words FROM conversations GROUP BY role"""
)
def usage_totals(spark, table):
    return table("conversations").groupBy("role").agg(
        F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.regexp_count("text", F.lit("[A-Za-z0-9]+"))).alias("n_words")
    )


@query(
    """SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS DOUBLE) ELSE 0.5::DOUBLE END AS score, CASE WHEN l.doc_id IS NOT NULL THEN l.quality >= 1 ELSE FALSE END AS correct,
CASE WHEN l.doc_id IS NOT NULL THEN 'ai' ELSE 'rule' END AS judge_source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def judge_override(spark, table):
    scores = table("documents").select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score"), F.lit(False).alias("correct"))
    return E.override(scores, table("labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score")))


@query("SELECT d.doc_id AS id, d.lang AS dimension, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def score_join(spark, table):
    """Predictions of unknown items are dropped."""
    return table("documents").select("doc_id", "lang").join(table("labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("dimension"), "quality")


@query("SELECT doc_id AS id, lang AS dimension FROM documents d WHERE lang IN ('en', 'fr') AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def judge_candidates(spark, table):
    docs = table("documents").where(F.col("lang").isin("en", "fr")).select("doc_id", "lang")
    return docs.join(table("labels").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("lang").alias("dimension"))


@query("SELECT lang, count(*) AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang")
def context_coverage(spark, table):
    """What a forced retrieval would still have to fetch."""
    return table("documents").join(table("labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("missing"))


@query("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN '' ELSE CAST(l.quality AS VARCHAR) || ',' || CAST(l.toxic AS VARCHAR) END AS evidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def prompt_contexts(spark, table):
    """Items without a context get an empty list."""
    evidence = F.when(F.col("quality").isNotNull(), F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")))
    joined = table("documents").select("doc_id").join(table("labels"), "doc_id", "left")
    return joined.select(F.col("doc_id").alias("id"), F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), ",").alias("evidence"))


TASKS = tuple(E.BASE_BUDGETS)
TASK_SQL = f"[{', '.join(repr(t) for t in TASKS)}][doc_id % {len(TASKS)} + 1]"
BUDGET_SQL = f"""b AS (SELECT doc_id, {TASK_SQL} AS task, lang = 'en' AS slow, source < 'src5' AS rag, length(text) AS n,
  [{', '.join(str(E.BASE_BUDGETS[t]) for t in TASKS)}][doc_id % {len(TASKS)} + 1] + CASE WHEN source < 'src5' THEN 768 ELSE 0 END AS base FROM documents),
p AS (SELECT *, CAST(CASE WHEN slow THEN base ELSE greatest(640, floor(base * 0.6::DOUBLE + 1e-9)) END AS BIGINT) AS plain FROM b),
t AS (SELECT *, CAST(greatest(plain, least(plain * 2, 4096)) AS BIGINT) AS budget FROM p)"""


def tasks_of(table):
    task = F.element_at(F.array(*map(F.lit, TASKS)), (F.col("doc_id") % len(TASKS) + 1).cast("int"))
    docs = table("documents").select("doc_id", task.alias("task"), (F.col("lang") == "en").alias("slow"), (F.col("source") < "src5").alias("rag"), F.length("text").alias("n"))
    return docs.withColumn("budget", E.token_budget(F.col("task"), F.col("rag"), F.col("slow"), 2.0, 4096))


@query(f"WITH {BUDGET_SQL} SELECT doc_id, task, budget FROM t")
def token_budget(spark, table):
    return tasks_of(table).select("doc_id", "task", "budget")


@query(f"WITH {BUDGET_SQL} SELECT doc_id, CASE WHEN slow THEN CAST(greatest(512, floor(budget * 0.5::DOUBLE)) AS BIGINT) END AS think FROM t")
def think_budget(spark, table):
    return tasks_of(table).select("doc_id", E.think_budget(F.col("budget"), F.col("slow"), 0.5).alias("think"))


@query(f"WITH {BUDGET_SQL} SELECT task, count(*) AS n, CAST(sum(budget) AS BIGINT) AS tokens, round(sum(budget)::DOUBLE * 0.6 / 700, 3) AS seconds FROM t GROUP BY task")
def budget_estimate(spark, table):
    return tasks_of(table).groupBy("task").agg(F.count("*").alias("n"), F.sum("budget").alias("tokens"), F.round(F.sum("budget").cast("double") * 0.6 / 700, 3).alias("seconds"))


@query(f"WITH {BUDGET_SQL} SELECT doc_id, task, CAST((row_number() OVER (PARTITION BY task ORDER BY budget, n, doc_id) - 1) // 32 AS BIGINT) AS batch FROM t")
def batch_assignment(spark, table):
    return E.batches(tasks_of(table), "task", ["budget", "n", "doc_id"], 32).select("doc_id", "task", "batch")


@query(f"WITH {BUDGET_SQL} SELECT budget, slow, count(*) AS n, min(doc_id) AS first FROM t GROUP BY budget, slow")
def batch_grouping(spark, table):
    """Requests of equal budget and mode form one batch; order is restored by the id."""
    return tasks_of(table).groupBy("budget", "slow").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(f"WITH {BUDGET_SQL} SELECT doc_id, task, budget * 4 AS budget FROM t WHERE n > budget * 4")
def rescue_candidates(spark, table):
    """Answers cut at their budget get a second pass with four times as much."""
    return tasks_of(table).where("n > budget * 4").select("doc_id", "task", (F.col("budget") * 4).alias("budget"))


@query("SELECT doc_id AS id, lang FROM documents WHERE lang IN ('en', 'de') AND len(list_intersect([lang, source], ['src1', 'src2', 'de'])) > 0")
def items_filter(spark, table):
    levels = F.array("lang", "source")
    return table("documents").where(F.col("lang").isin("en", "de") & F.arrays_overlap(levels, F.array(*map(F.lit, ("src1", "src2", "de"))))).select(F.col("doc_id").alias("id"), "lang")


@query(f"WITH {BUDGET_SQL} SELECT doc_id AS id, CASE task WHEN 'rubric_scored' THEN 'needs a judge' WHEN 'open_ddx' THEN 'no reference' END AS reason, task NOT IN ('rubric_scored', 'open_ddx') AS todo FROM t")
def items_skip_route(spark, table):
    reason = F.when(F.col("task") == "rubric_scored", "needs a judge").when(F.col("task") == "open_ddx", "no reference")
    return tasks_of(table).select(F.col("doc_id").alias("id"), reason.alias("reason"), reason.isNull().alias("todo"))


@query(
    """WITH r AS (SELECT doc_id, [struct_pack(points := 5, met := lang = 'en'), struct_pack(points := 3, met := length(text) > 1000), struct_pack(points := -4, met := source = 'src0')] AS rubric FROM documents)
SELECT doc_id AS id, CAST(list_sum(list_transform(rubric, lambda c: CASE WHEN c.met THEN c.points ELSE 0 END)) AS BIGINT) AS points, CAST(8 AS BIGINT) AS most,
round(list_sum(list_transform(rubric, lambda c: CASE WHEN c.met THEN c.points ELSE 0 END))::DOUBLE / 8, 4) AS norm, CAST(rubric[3].met::INT AS BIGINT) AS n_negative, CAST(3 AS BIGINT) AS criteria_total,
CAST(list_sum(list_transform(rubric, lambda c: c.met::INT)) AS BIGINT) AS criteria_met FROM r"""
)
def rubric_score(spark, table):
    docs = table("documents").select(F.col("doc_id").alias("id"), "lang", "source", F.length("text").alias("n"))
    criterion = lambda points: F.struct(F.lit("axis").alias("axis"), F.lit("c").alias("criterion"), F.lit(points).alias("points"))
    items = docs.select("id", F.array(criterion(5), criterion(3), criterion(-4)).alias("rubric"))
    met = F.array(F.col("lang") == "en", F.col("n") > 1000, F.col("source") == "src0")
    judged = docs.select("id", F.posexplode(met).alias("i", "met")).withColumn("ord", F.lit(1))
    return E.score_rubric(items, judged).select("id", "points", "most", "norm", F.size("negative_hits").cast("long").alias("n_negative"), "criteria_total", "criteria_met")
