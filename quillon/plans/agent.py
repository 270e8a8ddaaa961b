"""Queries of the agent: tools and rounds, whole turns, tool calls in messages, completions.

A scripted model stands in for a real one: what it says is computed from the
text that it is given, and so is what the SQL expects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import agent, chat, toolbox
from quillon.plans.registry import query

# ------------------------------------------------------------------ tools in rounds

FIRST = "SELECT conv_id, text, length(text) AS n FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"
BMI_SQL = "40 + n % 80, n % 50 + 150"
CLASS_SQL = "CASE WHEN b < 18.5 THEN '偏瘦' WHEN b < 24 THEN '正常' WHEN b < 28 THEN '超重' ELSE '肥胖' END"
RESULT_SQL = f"""CASE n % 4
    WHEN 0 THEN 'calculate_bmi 返回：BMI = ' || printf('%.1f', b) || '，分级：' || {CLASS_SQL} || '{toolbox.BMI_NOTE}'
    WHEN 1 THEN 'convert_units 返回：' || printf('%g', n::DOUBLE) || ' cm = ' || printf('%g', n / 100) || ' m'
    WHEN 2 THEN 'timeline_calc 返回：今天日期：2026-09-18' || chr(10) || '时间线（由早到晚）：' || chr(10) ||
      '1. 约' || (n % 300 + 1) || '天前（≈' || strftime(DATE '2026-09-18' - CAST(n % 300 + 1 AS INTEGER), '%Y-%m-%d') || '）：' || (n % 300 + 1) || '天前' END"""


def _first_turns(table):
    users = table("conversations").where("role = 'user'")
    first = users.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select(F.col("conv_id").alias("id"), F.coalesce("text", F.lit("")).alias("question"))


def _call(name, *arguments):
    """A reply that calls a tool; arguments are pairs of a name and what stands for it in JSON."""
    parts = [x for k, v in arguments for x in (F.lit(f'"{k}": '), v, F.lit(", "))][:-1]
    return F.concat(F.lit(f"TOOL: {name}\nARGS: {{"), *parts, F.lit("}"))


def _scripted(rows, turn):
    """Calls a tool by the length of the question, then answers with the last message; every fourth answers at once."""
    question = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    n = F.length(question)
    text = lambda x: x.cast("string")
    called = (
        F.when(n % 4 == 0, _call("calculate_bmi", ("weight_kg", text(n % 80 + 40)), ("height_cm", text(n % 50 + 150))))
        .when(n % 4 == 1, _call("convert_units", ("value", text(n)), ("from_unit", F.lit('"cm"')), ("to_unit", F.lit('"m"'))))
        .when(n % 4 == 2, _call("timeline_calc", ("events", F.concat(F.lit('["'), text(n % 300 + 1), F.lit('天前"]')))))
    )
    last = F.element_at("messages", -1)["content"]
    return rows.select("id", (F.coalesce(called, F.concat(F.lit("答："), text(n))) if turn == 0 else F.concat(F.lit("答："), last)).alias("reply"))


@query(
    f"""WITH q AS (SELECT *, (40 + n % 80) / ((n % 50 + 150) / 100) ** 2 AS b FROM ({FIRST}))
SELECT conv_id, CASE WHEN n % 4 = 3 THEN 0 ELSE 1 END AS rounds, CASE n % 4 WHEN 0 THEN 'calculate_bmi' WHEN 1 THEN 'convert_units' WHEN 2 THEN 'timeline_calc' ELSE '' END AS used,
  '答：' || CASE WHEN n % 4 = 3 THEN CAST(n AS VARCHAR) ELSE {RESULT_SQL} END AS answer FROM q"""
)
def agent_rounds(spark, table):
    """Tools run on what the model asks of the first turns; their results reach the next round."""
    import datetime

    tools = toolbox.standard_tools(today=F.lit(datetime.date(2026, 9, 18)))
    done = agent.run_rounds(_first_turns(table), _scripted, tools)
    return done.select(F.col("id").alias("conv_id"), "rounds", F.array_join("used_tools", ",").alias("used"), "answer")


REQUESTS = """SELECT conv_id, turn, text,
  array_to_string(list(CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), chr(10)) AS history,
  coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER), 0) AS answered, role
  FROM conversations WHERE role IN ('user', 'assistant')"""


@query(f"SELECT conv_id || ':' || turn AS id, md5(coalesce(history, '')) AS history, answered FROM ({REQUESTS}) WHERE role = 'user'")
def turn_requests(spark, table):
    return chat.turn_requests(table("conversations")).select("id", F.md5("history").alias("history"), "answered")


#: Chunks that stand for what is retrieved: the benchmark's items; the scripted model cites one of them, and every other time one that no tool returned.
TURNS_SQL = f"""WITH r AS (SELECT conv_id || ':' || turn AS id, length(text) AS n, answered, (SELECT count(*) FROM benchmark) AS items FROM ({REQUESTS}) WHERE role = 'user' AND length(trim(text)) > 0),
e AS (SELECT *, n % 3 = 0 AND EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = n % 60) AS found, answered >= 2 AS closing FROM r)
SELECT id, CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS rounds, CASE WHEN found THEN CAST(n % 60 AS VARCHAR) ELSE '' END AS retrieved,
  CASE WHEN n % 2 = 0 AND found THEN CAST(n % 60 AS VARCHAR) ELSE '' END AS cited,
  CASE WHEN n % 2 = 0 AND found AND NOT (n % 5 = 0 AND closing) AND n % 7 <> 0 THEN 'normal' ELSE 'review_modified' END AS handled_as,
  CASE WHEN n % 5 = 0 AND NOT closing THEN 'high' WHEN n % 5 = 0 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN n % 7 = 0 THEN replace('绝对没事，' || n || '字', '绝对没事', '风险看起来较低（但不能完全排除）') ELSE '请多休息，' || n || '字' END AS reply,
  concat_ws(',', CASE WHEN n % 7 = 0 THEN 'absolutist_claim' END, CASE WHEN NOT (n % 2 = 0 AND found) THEN 'fabricated_citation' END, CASE WHEN n % 5 = 0 AND closing THEN 'closing_confidence_cap' END) AS codes FROM e"""


@query(TURNS_SQL)
def agent_turns(spark, table):
    """Every user turn answered: lookups in rounds, invented citations dropped, promises softened, a closing turn's confidence capped."""
    question = F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["content"]
    n = F.length(question)
    items = table("benchmark").select(F.col("item_id").cast("string").alias("ref"))

    def lookup(calls):
        ref = F.get_json_object("arguments", "$.item")
        found = calls.join(items, ref == F.col("ref"), "left")
        return found.select("id", F.coalesce("ref", F.lit("没有")).alias("observation"), F.col("ref").isNotNull().alias("ok"), F.array_compact(F.array("ref")).alias("chunk_ids"))

    def model(rows, turn):
        ref = F.when(n % 2 == 0, (n % 60).cast("string")).otherwise("x")
        said = F.concat(F.when(n % 7 == 0, "绝对没事，").otherwise("请多休息，"), n.cast("string"), F.lit("字"))
        confidence = F.when(n % 5 == 0, "high").otherwise("low")
        assessment = F.struct(
            F.array(F.struct(F.lit("感冒").alias("name"), F.lit("low").alias("likelihood"))).alias("hypotheses"), confidence.alias("confidence"), F.array(F.lit("及时就医")).alias("next_steps"),
            F.array(F.struct(F.lit("kb").alias("source"), ref.alias("ref"), F.lit("依据").alias("detail"))).alias("evidence"),
        )
        answer = F.to_json(F.struct(said.alias("reply"), F.lit("low").alias("risk_level"), assessment.alias("assessment")))
        call = _call("lookup", ("item", F.concat(F.lit('"'), (n % 60).cast("string"), F.lit('"'))))
        return rows.select("id", (F.when(n % 3 == 0, call).otherwise(answer) if turn == 0 else answer).alias("reply"))

    done = agent.answer_turns(chat.turn_requests(table("conversations")), model, {"lookup": lookup}, {}, max_turns=2)
    cited = F.array_join(F.transform("evidence", lambda e: e["ref"]), ",")
    return done.select("id", "rounds", F.array_join("retrieved", ",").alias("retrieved"), cited.alias("cited"), "handled_as", "confidence", "reply", F.array_join("codes", ",").alias("codes"))


# ------------------------------------------------------------------ tool calls in messages


def _messages(table):
    """Replies as messages that call up to three tools, named by what they say; user turns as answers to a call two turns before."""
    c = table("conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    call = lambda i: F.struct(F.concat(F.lit("c"), F.col("turn").cast("string"), F.lit(f"-{i}")).alias("id"), F.struct(F.concat(F.lit("tool_"), ((F.col("n") + i) % 5).cast("string")).alias("name")).alias("function"))
    calls = F.slice(F.array(call(0), call(1), call(2)), F.lit(1), F.col("n") % 4)
    answer = F.struct(F.lit("tool").alias("role"), F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"), F.lit("-"), (F.col("n") % 3).cast("string")).alias("tool_call_id"))
    asked = F.to_json(F.struct("role", calls.alias("tool_calls")))
    return c.select("conv_id", "turn", F.when(F.col("role") == "assistant", asked).otherwise(F.to_json(answer)).alias("message"))


CALLS_SQL = "SELECT conv_id, turn, unnest(range(0, length(text) % 4)) AS i, length(text) AS n FROM conversations WHERE role = 'assistant'"


@query(
    f"""WITH calls AS (SELECT conv_id, 'c' || turn || '-' || i AS id, 'tool_' || (n + i) % 5 AS name FROM ({CALLS_SQL})),
answers AS (SELECT conv_id, turn, 'c' || (turn - 1) || '-' || length(text) % 3 AS id FROM conversations WHERE role <> 'assistant')
SELECT conv_id, turn, coalesce(name, '{chat.UNNAMED}') AS name FROM answers LEFT JOIN calls USING (conv_id, id)"""
)
def toolname_join(spark, table):
    """The name of the tool that a message answers, by the id of the call."""
    return chat.tool_names(_messages(table))


@query(
    f"""WITH calls AS (SELECT conv_id, turn, i, 'tool_' || (n + i) % 5 AS name FROM ({CALLS_SQL})),
first AS (SELECT conv_id, name, count(*) AS n, min((turn, i)) AS began FROM calls GROUP BY conv_id, name)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS rounds, string_agg(name, ',' ORDER BY began) AS names FROM first GROUP BY conv_id"""
)
def used_tools_ordered(spark, table):
    """How often tools were called, and their distinct names in the order of first use."""
    return chat.used_tools(_messages(table)).select("conv_id", "rounds", F.array_join("used_tools", ",").alias("names"))


@query("SELECT conv_id, CAST(sum(length(text) % 4) AS BIGINT) AS rounds FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def tool_rounds(spark, table):
    """Tool calls of each conversation."""
    replies = table("conversations").where("role = 'assistant'").select("conv_id").distinct()
    return replies.join(chat.used_tools(_messages(table)), "conv_id", "left").select("conv_id", F.coalesce("rounds", F.lit(0)).cast("long").alias("rounds"))


# ------------------------------------------------------------------ completions


COMPLETE_SQL = f"""WITH q AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'),
s AS (SELECT *, n % 11 = 0 AS plain, n % 11 <> 0 AND n % 7 = 0 AS forced, n % 2 = 0 AS structured, n % 3 = 0 AS calls, n % 5 = 0 AS nudged, n % 4 < 2 AS whole, n % 4 = 2 AS retried FROM q)
SELECT conv_id || ':' || turn AS id,
  CASE WHEN plain THEN 'stop' WHEN forced OR calls OR nudged THEN 'tool_calls' WHEN structured AND (whole OR retried) THEN 'tool_calls' ELSE 'stop' END AS finish,
  CASE WHEN plain THEN NULL WHEN forced THEN NULL WHEN calls THEN 'tool:look' WHEN nudged THEN 'tool:look(nudged)' WHEN NOT structured THEN 'text(no-structured-tool)' WHEN whole OR retried THEN 'finalize' ELSE 'finalize_failed' END AS note,
  CASE WHEN plain THEN n WHEN forced THEN n + 1 WHEN calls THEN n WHEN nudged OR NOT structured THEN 2 * n WHEN whole THEN 3 * n + 1 ELSE 4 * n + 2 END AS completion_tokens FROM s"""


@query(COMPLETE_SQL)
def chat_completion(spark, table):
    """Every user turn as a request, on the way that its tools and choice ask for."""
    n = F.length("text")
    requests = table("conversations").where("role = 'user'").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(0).alias("calls"))).alias("messages"),
        F.array(F.lit("look")).alias("tools"), (n % 2 == 0).alias("structured"), F.when(n % 11 == 0, "none").when(n % 7 == 0, chat.STRUCTURED).otherwise("auto").alias("choice"),
    )
    size = F.length(F.get("messages", F.lit(0))["content"])

    def tool_round(rows):
        called = F.when(F.col("note").isNull(), size % 3 == 0).otherwise(size % 5 == 0)
        return rows.select("id", F.when(called, 'TOOL: look\nARGS: {"k": 1}').otherwise("草稿").alias("reply"), size.cast("long").alias("input_tokens"), size.cast("long").alias("output_tokens"))

    def finalize(rows):
        whole = F.when(F.col("note").isNull(), size % 4 < 2).otherwise(size % 4 == 2)
        return rows.select("id", F.when(whole, '{"reply": "好"}').otherwise("不是对象").alias("reply"), size.cast("long").alias("input_tokens"), (size + 1).cast("long").alias("output_tokens"))

    return chat.complete(requests, tool_round, finalize).select("id", "finish", "note", "completion_tokens")
