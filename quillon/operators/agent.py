"""Conversations with a tool-calling model, many at once: one pass over all of them for each round.

Each round the model is asked for every request that still waits.  Replies that
call a tool are split by its name, each tool runs once over all its calls, and
what it says is joined back as a message for the next round.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from quillon.operators import rules
from quillon.operators.bridge import output_column, tool_column
from quillon.operators.toolbox import Tool, red_flag_report
from quillon.staging import scratch, stage

Model = Callable[[DataFrame, int], DataFrame]

# What a turn says that came to no answer, notes to the model, what is done after a pre-scan hit.
NO_ANSWER = "抱歉，本轮我没能整理出可靠的分析。您可以换一种说法，再描述一次最主要的症状和持续时间；如果情况较急，请直接就医。"
NO_ANSWER_STEP = "如症状明显或加重，请及时就医"
NO_ANSWER_EVIDENCE = "智能体未产出结构化输出，已走保守兜底"
FIRST_TURN_NOTE = "【系统指令·首次对话】这是本次会话的第一轮：请在 reply 开头用一句话说明两点——① 不需要提供姓名、身份证号等身份信息；② 本助手提供初步评估，不能替代医生面诊。"
CLOSING_NOTE = "【系统指令·收口】本次问诊已达到追问轮数上限：本轮必须收口——给出当前评估（目前考虑、主要依据、还缺什么）与明确的就医建议（next_steps 必须含就医建议）；不要再提出新的追问；把握度不得为 high；如仍有关键信息缺失，请说明需要就医确认。"
PRELUDE, PRELUDE_NOTE = "【危险信号已由系统核对】", "上面这一步系统已经做过，不必再调用对应工具；其它工具照常按需调用。"
THIS_TURN, PRESCANNED = "本轮输入", "前置安全扫描命中："
STEPS_OF = {
    "self_harm": ("立即联系信任的人陪伴", "拨打心理援助热线 12356 或 120 求助"),
    "emergency": ("立即拨打 120 或前往最近的急诊科",),
    "out_of_scope": ("前往相应专科就诊（儿科 / 妇产科 / 精神心理科）",),
}

MESSAGE = "struct<role:string,content:string>"
EVIDENCE = "array<struct<source:string,ref:string,detail:string>>"
OUTPUT = f"reply string, risk_level string, confidence string, hypotheses array<struct<name:string,likelihood:string>>, evidence {EVIDENCE}, missing_info array<string>, next_steps array<string>, red_flags array<string>"
TURN = ("id", "reply", "risk_level", "confidence", "next_steps", "handled_as", "rounds", "codes", "evidence", "missing_info", "used_tools", "retrieved")
_NAMES = {"user": "", "system": "", "assistant": "[called] ", "tool": "[returned] "}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def transcript(messages: Column) -> Column:
    """Messages as one text: a line for each, calls and results marked."""
    marks = F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(F.try_element_at(marks, m["role"]), F.lit("")), m["content"])), "\n")


def _observed(replies: DataFrame, tools: Mapping[str, Tool]) -> DataFrame | None:
    """(id, observation, ok, chunk_ids) of all calls in (id, call); only tools that are called run."""
    called = {r["name"] for r in replies.where("call.name is not null").groupBy("call.name").count().collect()}  # no more rows than tools
    found = None
    for name in tools:
        if name in called:
            own = tools[name](replies.where(F.col("call.name") == name).select("id", "call.arguments")).select("id", "observation", "ok", "chunk_ids")
            found = own if found is None else found.unionByName(own)
    return found


def run_rounds(requests: DataFrame, model: Model, tools: Mapping[str, Tool], max_rounds: int = 3, finalize: Model | None = None) -> DataFrame:
    """(id, transcript, messages, rounds, answer, used_tools, retrieved) of every request (id, question) or (id, messages).

    ``model(open, round)`` takes (id, messages, transcript) of those that wait
    and gives (id, reply).  A reply that calls one of ``tools`` is run: call and
    result become messages, and the request goes into the next round.  Another
    reply is the answer, and so is that of the round after the last call.  No
    reply is an empty answer.  With ``finalize``, answers are drafts: it is
    asked once, (id, messages, transcript, draft), and its reply is the answer.
    ``used_tools`` are the names in the order of their first use, ``retrieved``
    the chunks that tools returned.  The model is not asked when nobody waits.
    Lineage is cut after every round.
    """
    none = F.array().cast("array<string>")
    messages = F.col("messages") if "messages" in requests.columns else F.array(message("user", F.coalesce("question", F.lit(""))))
    state = requests.select("id", messages.cast(f"array<{MESSAGE}>").alias("messages"), F.lit(0).cast("long").alias("rounds"), F.lit(None).cast("string").alias("answer"), none.alias("used_tools"), none.alias("retrieved"))
    spark = requests.sparkSession
    with scratch(spark, "answers"):
        for turn in range(max_rounds + 1):
            waiting = state.where("answer is null")
            if turn and waiting.isEmpty():
                break
            asked = waiting.select("id", "messages", transcript(F.col("messages")).alias("transcript"))
            call = tool_column(F.col("reply"), tuple(tools)) if tools and turn < max_rounds else F.lit(None).cast("struct<name:string,arguments:string>")
            replies = stage(model(asked, turn).select("id", "reply").withColumn("call", call), "replies")
            observed = _observed(replies, tools) if turn < max_rounds else None
            moved = waiting.drop("answer").join(replies, "id", "left")
            if observed is None:
                moved = moved.withColumns({"observation": F.lit(None).cast("string"), "chunk_ids": none})
            else:
                moved = moved.join(observed, "id", "left")
            called = F.col("call.name").isNotNull()
            told = F.array(
                message("assistant", F.concat(F.lit("TOOL: "), "call.name", F.lit("\nARGS: "), "call.arguments")),
                message("tool", F.concat("call.name", F.lit(" 返回："), F.coalesce("observation", F.lit("")))),
            )
            moved = moved.select(
                "id", F.when(called, F.concat("messages", told)).otherwise(F.col("messages")).alias("messages"), (F.col("rounds") + called.cast("long")).alias("rounds"),
                F.when(~called, F.coalesce("reply", F.lit(""))).alias("answer"),
                F.when(called, F.array_distinct(F.concat("used_tools", F.array("call.name")))).otherwise(F.col("used_tools")).alias("used_tools"),
                F.when(called, F.array_union("retrieved", F.coalesce("chunk_ids", none))).otherwise(F.col("retrieved")).alias("retrieved"),
            )
            state = stage(state.where("answer is not null").unionByName(moved), "rounds")
        if finalize is not None and not state.isEmpty():
            last = finalize(state.select("id", "messages", transcript(F.col("messages")).alias("transcript"), F.col("answer").alias("draft")), max_rounds + 1)
            state = state.join(last.select("id", F.col("reply").alias("final")), "id", "left").withColumn("answer", F.coalesce("final", "answer")).drop("final")
        return stage(state.select("id", transcript(F.col("messages")).alias("transcript"), "messages", "rounds", "answer", "used_tools", "retrieved"), "answers")


def opening(requests: DataFrame, max_turns: int = 6, preinject: bool = False) -> DataFrame:
    """(id, messages) of (id, question, history, answered): the history, notes for a first and for a closing turn, the question.

    ``preinject`` tells the model beforehand what the red-flag tool says of the question.
    """
    first = F.coalesce("history", F.lit("")) == ""
    closing = F.coalesce("answered", F.lit(0)) >= max_turns
    parts = [F.when(~first, message("user", F.col("history"))), F.when(first, message("system", F.lit(FIRST_TURN_NOTE))), F.when(closing, message("system", F.lit(CLOSING_NOTE)))]
    if preinject:
        parts.append(message("system", F.concat(F.lit(PRELUDE), red_flag_report(F.col("question")), F.lit("\n\n" + PRELUDE_NOTE))))
    return requests.select("id", F.array_compact(F.array(*parts, message("user", F.col("question")))).alias("messages"))


def answer_turns(requests: DataFrame, model: Model, tools: Mapping[str, Tool], templates: Mapping[str, str], max_turns: int = 6, max_rounds: int = 3, finalize: Model | None = None, preinject: bool = False) -> DataFrame:
    """One row for every turn (id, question, history, answered), with the columns of ``TURN``.

    ``history`` is the conversation so far (empty or null at first) and
    ``answered`` the number of replies in it; from ``max_turns`` on the turn is
    a closing one.  What the pre-scan finds is answered from ``templates`` and
    never reaches the model.  The rest goes through ``run_rounds`` and
    ``rules.review``: evidence that cites a chunk which no tool of the turn
    returned is dropped, and red flags are those of the model's case card.  An
    answer without a JSON object gets a careful stock reply.  Blank questions
    have no row.
    """
    none, long = F.array().cast("array<string>"), lambda n: F.lit(n).cast("long")
    dialogue = lambda detail: F.array(F.struct(F.lit("dialogue").alias("source"), F.lit(THIS_TURN).alias("ref"), detail.alias("detail"))).cast(EVIDENCE)
    first = F.coalesce("history", F.lit("")) == ""
    scanned = stage(requests.where(rules.flat(F.col("question")) != "").withColumn("hit", rules.prescan(F.col("question"), first)), "scanned")
    way = scanned.where("hit is not null").withColumn("way", rules.route(F.col("hit.kind")))
    told = F.create_map(*(F.lit(x) for kv in templates.items() for x in kv)) if templates else F.create_map().cast("map<string,string>")
    steps = F.create_map(*(x for k, v in STEPS_OF.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    stopped = way.select(
        "id", F.coalesce(F.try_element_at(told, F.col("way.template")), F.lit(rules.ADVICE)).alias("reply"), "way.risk_level", "way.confidence",
        F.element_at(steps, F.col("way.template")).alias("next_steps"), "way.handled_as", long(0).alias("rounds"), F.array("hit.rule_id").alias("codes"),
        dialogue(F.concat(F.lit(PRESCANNED), "hit.rule_id")).alias("evidence"), none.alias("missing_info"), none.alias("used_tools"), none.alias("retrieved"),
    )
    going = scanned.where("hit is null")
    done = run_rounds(opening(going, max_turns, preinject), model, tools, max_rounds, finalize)
    output = F.when(F.col("answer").contains("{"), output_column(F.col("answer"), F.lit("")))
    read = stage(done.withColumn("o", F.from_json(output, OUTPUT)).select("id", "rounds", "o", "used_tools", "retrieved"), "outputs")
    lost = read.where("o is null").select(
        "id", F.lit(NO_ANSWER).alias("reply"), F.lit("medium").alias("risk_level"), F.lit("low").alias("confidence"), F.array(F.lit(NO_ANSWER_STEP)).alias("next_steps"),
        F.lit("review_modified").alias("handled_as"), "rounds", none.alias("codes"), dialogue(F.lit(NO_ANSWER_EVIDENCE)).alias("evidence"), none.alias("missing_info"), "used_tools", "retrieved",
    )
    rows = read.where("o is not null").join(going.select("id", "answered"), "id").select(
        "id", "o.reply", F.transform("o.hypotheses", lambda h: h["name"]).alias("hypotheses"), "o.evidence", "retrieved", "o.confidence", "o.red_flags", "o.risk_level", "o.next_steps",
        (F.coalesce("answered", F.lit(0)) >= max_turns).alias("closing"),
    )
    reviewed = rules.review(rows, templates).join(read.select("id", "rounds", "used_tools", "retrieved", "o.missing_info"), "id")
    return stopped.select(*TURN).unionByName(lost.select(*TURN)).unionByName(
        reviewed.withColumn("handled_as", F.when(F.col("action") == "pass", "normal").otherwise("review_modified")).select(*TURN)
    )
