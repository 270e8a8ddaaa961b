"""Scoring of answers by rule, one choice by task type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions import text as T

# Task types that no rule scores, and the verdict words.
UNSCORED = ("rubric_scored", "agentic_history_taking", "retrieval")
VERDICTS = {"是": "yes", "否": "no", "可能": "maybe"}
LIKELIHOOD_ORDER = {"low": 0, "medium": 1, "high": 2}

_NONE = "array<string>"


def choice_of(text: Column, options: Column) -> Column:
    """The option letter that a text names; letters are those of the options, A to J without any."""
    letters = F.coalesce(F.nullif(F.array_join(F.array_sort(F.map_keys(options)), ""), F.lit("")), F.lit("ABCDEFGHIJ"))
    last = lambda x, pattern: F.get(F.reverse(F.regexp_extract_all(x, pattern, F.lit(1))), F.lit(0))
    named = last(text, F.concat(F.lit(r"(?i)答案\s*[:：]?\s*[（(]?\s*(["), letters, F.lit(r"])\s*[)）]?")))
    tail = F.when(F.length(text) > 300, F.substring(text, -300, 300)).otherwise(text)
    return F.upper(F.coalesce(named, last(tail, F.concat(F.lit("(?:^|[^A-Za-z])(["), letters, F.lit("])(?![A-Za-z])")))))


def choice_from_conclusion(options: Column, reply: Column, hypotheses: Column) -> Column:
    """The only option that the reply holds, else the option nearest to the likeliest hypothesis (from 0.5 on)."""
    entries = F.map_entries(options)
    named = F.transform(F.filter(entries, lambda e: (e["value"] != "") & T.fuzzy_contains(e["value"], reply, 0.6)), lambda e: e["key"])
    order = F.create_map(*(F.lit(x) for kv in LIKELIHOOD_ORDER.items() for x in kv))
    known = F.filter(F.coalesce(hypotheses, F.array().cast("array<struct<name:string,likelihood:string>>")), lambda h: T.strip(F.coalesce(h["name"], F.lit(""))) != "")
    ranked = F.array_sort(F.transform(known, lambda h, i: F.struct((-F.coalesce(F.try_element_at(order, h["likelihood"]), F.lit(0))).alias("r"), i.alias("i"), h["name"].alias("name"))))
    # Of equal similarities the later letter.
    near = lambda best: F.reverse(F.array_sort(F.transform(entries, lambda e: F.struct(T.similarity(best, e["value"]).alias("s"), e["key"].alias("k")))))
    first = F.get(F.transform(F.slice(ranked, 1, 1), lambda h: F.get(near(T.strip(h["name"])), F.lit(0))), F.lit(0))
    return F.upper(F.when(F.size(named) == 1, F.get(named, F.lit(0))).when(first["s"] >= 0.5, first["k"]))


def score_items(rows: DataFrame) -> DataFrame:
    """(id, task_type, score, correct and the metrics of the task's rule) of answers.

    Rows: id, task_type, question, context, options (letter to text), answer,
    reference_answer, key_points, output, thinking and hypotheses (name,
    likelihood; null unless an agent answered).  Any of them may be null.
    Diagnosis, lists and key points are also looked for in the thinking, a
    number only if the output has none (or 0).  A null score waits for a judge.
    """
    empty = F.lit("")
    points, options = F.coalesce("key_points", F.array().cast(_NONE)), F.coalesce("options", F.create_map().cast("map<string,string>"))
    out = F.coalesce("output", empty)
    whole = F.concat(out, F.lit("\n"), F.coalesce("thinking", empty))
    given = rows.select("id", "task_type", F.coalesce("question", empty).alias("question"), F.coalesce("context", empty).alias("context"), options.alias("options"), F.coalesce("answer", empty).alias("answer"), F.coalesce("reference_answer", empty).alias("reference"), points.alias("points"), out.alias("out"), whole.alias("whole"), "hypotheses")
    out, whole, points, options, reference = (F.col(c) for c in ("out", "whole", "points", "options", "reference"))
    task = F.col("task_type")
    workup = task == "open_workup"
    inline, letter = T.inline_options(F.col("question")), T.reference_letter(reference)
    by_letter = workup & (F.size(inline) > 0) & letter.isNotNull()

    parsed = F.when(by_letter, choice_of(out, inline)).when(task == "mcq_single", F.coalesce(choice_of(out, options), F.when(F.col("hypotheses").isNotNull() & (F.size(options) > 0), choice_from_conclusion(options, out, F.col("hypotheses")))))
    number = T.extract_number(out)
    value = F.when(number != 0, number).otherwise(T.extract_number(whole))
    told = F.lower(F.regexp_extract(out, "(?i)答案\\s*[:：]?\\s*(yes|no|maybe|是|否|可能)", 1))
    verdict = F.nullif(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv)), told), told), empty)
    cited = F.regexp_extract_all(out, F.lit("\\[摘要\\s*([0-9]+)\\]"), F.lit(1))
    abstracts = F.greatest(F.regexp_count("context", F.lit("\\[摘要\\s*[0-9]+\\]")), F.lit(1))
    diagnosis = T.expected_diagnosis(points, reference)
    expected = T.expected_list(points)
    sentences = F.filter(F.flatten(F.transform(points, lambda p: F.split(p, "[。；;\n]"))), lambda s: F.length(T.strip(s)) >= 6)
    steps = given.withColumns({"choice": parsed, "value": F.when(task == "calculation", value), "verdict": F.when(task == "evidence_qa", verdict), "cited": F.when(task == "evidence_qa", cited), "abstracts": abstracts})
    diagnosing, listing = task.isin("open_diagnosis", "dialogue_diagnosis"), task.isin("open_ddx", "open_ranked_ddx")
    steps = steps.withColumns({"diagnosis": F.when(diagnosing, diagnosis), "expected": F.when(listing, expected), "sentences": F.when(workup & ~by_letter, sentences)})
    share = lambda items, limit: F.when(F.size(items) > 0, F.size(F.filter(items, lambda x: T.fuzzy_contains(x, whole, limit))) / F.size(items))
    lines = F.filter(F.split(out, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: T.strip(x) != "")
    hit_lines = F.filter(F.transform(lines, lambda x, i: F.when(F.exists("expected", lambda w: T.fuzzy_contains(w, x)), i + 1)), lambda x: x.isNotNull())
    metrics = steps.withColumns(
        {
            "citation_traceable": F.when(task == "evidence_qa", (F.size("cited") > 0) & F.forall("cited", lambda c: c.cast("long") <= F.col("abstracts"))),
            "diagnosis_similarity": F.when(diagnosing, F.round(F.coalesce(T.similarity(F.col("diagnosis"), whole), F.lit(0.0)), 3)),
            "key_point_coverage": F.when(diagnosing, share(points, 0.5)).when(workup & ~by_letter, share(F.col("sentences"), 0.45)),
            "recall": F.when(listing, share(F.col("expected"), 0.5)),
            "mrr": F.when(task == "open_ranked_ddx", F.when(F.size("expected") > 0, F.coalesce(1.0 / F.get(hit_lines, F.lit(0)), F.lit(0.0))).otherwise(0.0)),
            "hit": F.when(diagnosing, F.coalesce(T.similarity(F.col("diagnosis"), whole), F.lit(0.0)) >= 0.5),
        }
    )
    wanted = T.strip(F.col("answer"))
    correct = (
        F.when(task == "mcq_single", F.coalesce(F.col("choice") == F.upper(wanted), F.lit(False)))
        .when(task == "calculation", T.numbers_match(F.col("value"), T.extract_number(reference)))
        .when(task == "evidence_qa", F.coalesce(F.col("verdict") == F.lower(wanted), F.lit(False)))
        .when(diagnosing, F.col("hit"))
        .when(by_letter, F.coalesce(F.col("choice") == letter, F.lit(False)))
    )
    return metrics.select(
        "id", "task_type", F.coalesce(correct.cast("double"), F.when(listing, F.col("recall")).when(workup, F.col("key_point_coverage"))).alias("score"), correct.alias("correct"),
        "choice", "value", "verdict", "cited", "citation_traceable", "diagnosis", "diagnosis_similarity", "key_point_coverage", "expected", "recall", "mrr",
    )
