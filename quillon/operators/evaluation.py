"""Scoring and summarising evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Z = 1.96


def wilson_interval(k: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high) of a share's Wilson interval, within 0 and 1; zeros without trials."""
    n_ = F.greatest(n, F.lit(1)).cast("double")
    p = k / n_
    scale = 1 + z * z / n_
    middle, half = p + z * z / (2 * n_), z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))
    low, high = F.greatest(F.lit(0.0), (middle - half) / scale), F.least(F.lit(1.0), (middle + half) / scale)
    none = n == 0
    return F.struct(F.when(none, 0.0).otherwise(low).alias("low"), F.when(none, 0.0).otherwise(high).alias("high"))


def _tally(wanted: Sequence[str] = ()) -> list[Column]:
    correct = F.count(F.when(F.col("correct"), 1))
    return [
        F.count("*").alias("n"),
        F.count("score").alias("scored"),
        correct.alias("correct"),
        F.count(F.when(F.col("score").isNull(), 1)).alias("pending"),
        F.count(F.when(F.col("truncated"), 1)).alias("truncated"),
        F.round(F.avg("score"), 4).alias("mean"),
    ]


def with_accuracy(tallies: DataFrame) -> DataFrame:
    """Accuracy over the scored rows (null without one) and its interval (null likewise)."""
    ci = wilson_interval(F.col("correct"), F.col("scored"))
    some = F.col("scored") > 0
    return tallies.withColumns(
        {
            "accuracy": F.when(some, F.round(F.col("correct") / F.greatest(F.col("scored"), F.lit(1)), 4)),
            "ci_low": F.when(some, F.round(ci["low"], 4)),
            "ci_high": F.when(some, F.round(ci["high"], 4)),
        }
    )


def summarize(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, mean score, accuracy and interval of each group; over everything without ``by``."""
    return with_accuracy(scores.groupBy(*by).agg(*_tally()))


def rubric_stats(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Over rows judged ok: count, mean score (null counts 0), rows with negative hits and their share. Re-judged ids count again."""
    negative = F.count(F.when(F.col("negatives") > 0, 1))
    return judged.where("ok").groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(F.coalesce("norm", F.lit(0.0))), 4).alias("mean"), negative.alias("with_negative"), F.round(negative / F.count("*"), 4).alias("negative_rate")
    )


def override(scores: DataFrame, judgments: DataFrame) -> DataFrame:
    """Scores with the judge's where there is one: its score, correct from 1 on, and who judged."""
    j = judgments.select("id", F.col("score").alias("_score"))
    has = F.col("_score").isNotNull()
    return scores.join(j, "id", "left").select(
        "id", F.when(has, F.col("_score")).otherwise(F.col("score")).alias("score"), F.when(has, F.col("_score") >= 1).otherwise(F.col("correct")).alias("correct"), F.when(has, "ai").otherwise("rule").alias("judge_source")
    )


def score_rubric(items: DataFrame, judgments: DataFrame) -> DataFrame:
    """items (id, rubric array<struct<axis, criterion, points>>), judgments (id, ord, i, met).

    Points met are added (negative points so subtract and are listed), the
    positive points make the most; norm is null if that is 0, and may be
    negative. The last judgment of an index counts.
    """
    last = judgments.groupBy("id", "i").agg(F.max_by("met", "ord").alias("met"))
    criteria = items.select("id", F.posexplode("rubric").alias("i", "c")).select("id", "i", F.col("c.points").alias("points"))
    met = criteria.join(last, ["id", "i"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
    got = F.sum(F.when(F.col("met"), F.col("points")).otherwise(0))
    most = F.sum(F.greatest("points", F.lit(0)))
    per_item = met.groupBy("id").agg(
        got.cast("long").alias("points"),
        most.cast("long").alias("most"),
        F.when(most > 0, F.round(got / most, 4)).alias("norm"),
        F.array_sort(F.collect_list(F.when(F.col("met") & (F.col("points") < 0), F.col("i")))).alias("negative_hits"),
        F.count("*").alias("criteria_total"),
    )
    counted = last.groupBy("id").agg(F.count(F.when(F.col("met"), 1)).alias("criteria_met"))
    return per_item.join(counted, "id", "left").withColumn("criteria_met", F.coalesce("criteria_met", F.lit(0)))


# Base token budgets by task, and what retrieved context adds.
BASE_BUDGETS = {
    "mcq_single": 1536,
    "calculation": 3072,
    "evidence_qa": 1280,
    "open_diagnosis": 1536,
    "dialogue_diagnosis": 1536,
    "open_ddx": 1536,
    "open_ranked_ddx": 2048,
    "open_workup": 2048,
    "rubric_scored": 2560,
    "agentic_history_taking": 512,
    "retrieval": 512,
}
CONTEXT_BUDGET = 768
FAST_FLOOR, FAST_SHARE = 640, 0.6


def token_budget(task: Column, with_context: Column, slow: Column, scale: float = 1.0, cap: int | None = None, default: int = 512) -> Column:
    """Base by task, more with context, less when fast; scaled up at most to the cap and never below the unscaled value."""
    table = F.create_map(*(F.lit(x) for kv in BASE_BUDGETS.items() for x in kv))
    base = F.coalesce(F.element_at(table, task), F.lit(default)) + F.when(with_context, CONTEXT_BUDGET).otherwise(0)
    plain = F.when(slow, base).otherwise(F.greatest(F.lit(FAST_FLOOR), F.floor(base * FAST_SHARE + 1e-9)))
    scaled = F.floor(plain * scale + 1e-9)
    return F.greatest(plain, scaled if cap is None else F.least(scaled, F.lit(cap))).cast("long")


def think_budget(budget: Column, slow: Column, ratio: float = 1.0) -> Column:
    """Null unless slow and below the whole budget; 512 at least."""
    return F.when(slow & F.lit(ratio < 1), F.greatest(F.lit(512), F.floor(budget * ratio)).cast("long"))


def batches(rows: DataFrame, group: str, order: Sequence[Column | str], size: int) -> DataFrame:
    """``batch`` within each group: rows in order, ``size`` at a time."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("long"))
