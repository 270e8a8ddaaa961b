"""Messages with tool calls, and one chat completion for many requests at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.operators.bridge import objects_column, output_column, tool_column
from quillon.staging import scratch, stage

#: (id, messages, note, draft) to (id, reply, input_tokens, output_tokens).
Model = Callable[[DataFrame], DataFrame]

# The tool that answers take the form of, what a tool without a name is called, notes to the model, who says what.
STRUCTURED = "AgentTurnOutput"
UNNAMED = "工具"
REQUIRE_TOOL = "本轮必须先调用一个工具，再给出回答。"
RETRY = "上一次输出不是合法 JSON。这次务必只输出一个 JSON 对象，第一个字符是 {，不要输出解释、不要复读模板。"
SPEAKERS = {"user": "用户：", "assistant": "助手："}

CALLS = "array<struct<id:string,function:struct<name:string,arguments:string>>>"


def tool_calls(messages: DataFrame, by: Sequence[str] = ("conv_id",), order: str = "turn", message: str = "message") -> DataFrame:
    """(by, order, i, call_id, name) of every call in messages, which are JSON objects; what is no object has none.

    The message is parsed once into a variant; ``i`` numbers the calls of a message.
    """
    parsed = messages.select(*by, order, F.try_variant_get(F.try_parse_json(message), "$.tool_calls", CALLS).alias("calls"))
    return parsed.select(*by, order, F.posexplode("calls").alias("i", "call")).select(*by, order, "i", F.col("call.id").alias("call_id"), F.col("call.function.name").alias("name"))


def tool_names(messages: DataFrame, by: Sequence[str] = ("conv_id",), order: str = "turn", message: str = "message") -> DataFrame:
    """(by, order, name) of every tool message: the name of the call whose id it answers, or ``UNNAMED``.

    Of calls of one id in a conversation the last one with a name counts, wherever the answer stands.
    """
    calls = tool_calls(messages, by, order, message).where("call_id <> '' and name <> ''")
    known = calls.groupBy(*by, F.col("call_id").alias("of")).agg(F.max_by("name", F.struct(order, "i")).alias("name"))
    object_ = F.try_parse_json(message)
    text = lambda path: F.try_variant_get(object_, path, "string")
    answers = messages.where(text("$.role") == "tool").select(*by, order, text("$.tool_call_id").alias("of"))
    return answers.join(known, [*by, "of"], "left").select(*by, order, F.coalesce("name", F.lit(UNNAMED)).alias("name"))


def used_tools(messages: DataFrame, by: Sequence[str] = ("conv_id",), order: str = "turn", message: str = "message") -> DataFrame:
    """(by, rounds, used_tools): how many calls there were, and the distinct names in the order of their first use; conversations without calls have no row."""
    calls = tool_calls(messages, by, order, message)
    first = calls.groupBy(*by, "name").agg(F.min(F.struct(order, "i")).alias("first"), F.count("*").alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("first", "name")))), lambda x: x["name"])
    return first.groupBy(*by).agg(F.sum("n").alias("rounds"), names.alias("used_tools"))


def turn_requests(turns: DataFrame, most: int = 20) -> DataFrame:
    """(id, conv_id, turn, question, history, answered) of every user turn of (conv_id, turn, role, text).

    ``history`` has the ``most`` turns before as lines, ``answered`` counts all
    replies before.  Turns of other roles than user and assistant are no lines.
    """
    before = Window.partitionBy("conv_id").orderBy("turn")
    names = F.create_map(*(F.lit(x) for kv in SPEAKERS.items() for x in kv))
    told = turns.where(F.col("role").isin(*SPEAKERS)).withColumn("line", F.concat(F.element_at(names, F.col("role")), F.coalesce("text", F.lit(""))))
    rows = told.withColumns(
        {
            "history": F.array_join(F.collect_list("line").over(before.rowsBetween(-most, -1)), "\n"),
            "answered": F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"),
        }
    )
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return rows.where("role = 'user'").select(name.alias("id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), "history", "answered")


def complete(requests: DataFrame, tool_round: Model, finalize: Model, require_first: bool = True) -> DataFrame:
    """(id, finish, name, content, note, prompt_tokens, completion_tokens) of every request.

    Requests: id, messages (role, content, calls: how many tools the message
    called), tools (names that may be called), structured (whether an answer is
    to be an object), choice (``none``, the name of the structured tool, or
    else).  ``none`` is answered in text; a choice of the structured tool goes
    straight to ``finalize``.  The others get a tool round; if no tool is called
    and none was before, a second one with a note.  A call is returned as it is.
    Without one the words are the answer, or the draft of ``finalize``, which is
    asked again if it gives no object; if that fails too the draft is returned.
    Each model runs once for each step, over the requests that reach it.
    """
    blank, open_columns = F.lit(None).cast("string"), ("id", "messages", "note", "draft")
    usage = ("prompt_tokens", "completion_tokens")
    results: list[DataFrame] = []

    def ask(model: Model, rows: DataFrame, note: Column, name: str) -> DataFrame:
        said = model(rows.withColumn("note", note).select(*open_columns)).select("id", F.coalesce("reply", F.lit("")).alias("reply"), "input_tokens", "output_tokens")
        whole = rows.join(said, "id", "left").withColumns({u: F.col(u) + F.coalesce(F.col(c), F.lit(0)).cast("long") for u, c in zip(usage, ("input_tokens", "output_tokens"), strict=True)})
        return whole.withColumn("reply", F.coalesce("reply", F.lit(""))).drop("input_tokens", "output_tokens").transform(lambda d: stage(d, name))

    def give(rows: DataFrame, finish: str, name: Column, content: Column, note: Column) -> None:
        results.append(rows.select("id", F.lit(finish).alias("finish"), name.cast("string").alias("name"), content.alias("content"), note.alias("note"), *usage))

    def text(rows: DataFrame, note: Column) -> None:
        give(rows, "stop", blank, F.col("reply"), note)

    def answer(rows: DataFrame, note: Column) -> None:
        give(rows, "tool_calls", F.lit(STRUCTURED), output_column(F.coalesce("object", F.lit("{}")), F.coalesce("draft", F.lit(""))), note)

    def called(rows: DataFrame, suffix: str) -> DataFrame:
        """Hands out the calls and returns the rows without one."""
        parsed = stage(rows.withColumn("call", F.when(F.size("tools") > 0, tool_column(F.col("reply"), F.col("tools")))), "called")
        give(parsed.where("call.name is not null"), "tool_calls", F.col("call.name"), F.col("call.arguments"), F.concat(F.lit("tool:"), "call.name", F.lit(suffix)))
        return parsed.where("call.name is null").drop("call")

    def finished(rows: DataFrame, note: Column) -> DataFrame:
        return stage(ask(finalize, rows, note, "final").withColumn("object", F.get(objects_column(F.col("reply")), F.lit(0))), "objects")

    with scratch(requests.sparkSession, "completions"):
        state = stage(requests.select("id", "messages", "tools", "structured", F.coalesce("choice", F.lit("auto")).alias("choice"), blank.alias("draft"), *(F.lit(0).cast("long").alias(u) for u in usage)), "requests")
        text(ask(tool_round, state.where("choice = 'none'"), blank, "plain"), blank)
        answer(finished(state.where(F.col("choice") == STRUCTURED), blank), blank)
        left = called(ask(tool_round, state.where(~F.col("choice").isin("none", STRUCTURED)), blank, "first"), "")
        if require_first:
            before = F.aggregate("messages", F.lit(0), lambda n, m: n + F.when(m["role"] == "assistant", F.coalesce(m["calls"], F.lit(0)).cast("int")).otherwise(0))
            again = (F.size("tools") > 0) & (before == 0)
            nudged = called(ask(tool_round, left.where(again).drop("reply"), F.lit(REQUIRE_TOOL), "nudged"), "(nudged)")
            left = left.where(~again).unionByName(nudged)
        left = stage(left.withColumn("reply", F.trim("reply")), "left")
        text(left.where("not structured"), F.lit("text(no-structured-tool)"))
        first = finished(left.where("structured").drop("draft").withColumnRenamed("reply", "draft"), blank)
        answer(first.where("object is not null"), F.lit("finalize"))
        second = finished(first.where("object is null").drop("reply", "object"), F.lit(RETRY))
        answer(second.where("object is not null"), F.lit("finalize"))
        text(second.where("object is null").withColumn("reply", F.col("draft")), F.lit("finalize_failed"))
        return stage(reduce(DataFrame.unionByName, results), "completions")
