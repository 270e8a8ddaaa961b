"""The agent's tools, its rounds, whole turns, chat completions, and conversations as streams."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import agent, chat, rules, toolbox
from quillon.streaming import conversations as V, progress as P

TODAY = datetime.date(2026, 9, 18)


def observe(spark, tool, *arguments):
    rows = spark.createDataFrame([(i, json.dumps(a, ensure_ascii=False)) for i, a in enumerate(arguments)], "id long, arguments string")
    tools = toolbox.standard_tools(today=F.lit(TODAY))
    return [tuple(r) for r in tools[tool](rows).orderBy("id").select("observation", "ok").collect()]


def test_bmi_and_units_say_what_they_found_or_why_not(spark):
    told = observe(spark, "calculate_bmi", {"weight_kg": 70, "height_cm": "175"}, {"weight_kg": "x", "height_cm": 170}, {"weight_kg": 1, "height_cm": 170}, {"weight_kg": 70, "height_cm": 99}, {"weight_kg": 70})
    assert told[0] == ("BMI = 22.9，分级：正常" + toolbox.BMI_NOTE, True)
    assert [t[0] for t in told[1:]] == [toolbox.BMI_NOT_NUMBERS, toolbox.BMI_WEIGHT, toolbox.BMI_HEIGHT, toolbox.BAD_ARGUMENTS.format("height_cm")] and not any(t[1] for t in told[1:])
    ask = lambda v, a, b: {"value": v, "from_unit": a, "to_unit": b}
    told = observe(spark, "convert_units", ask(120, "斤", "kg"), ask(37.5, "℃", "华氏度"), ask(5, "CM", "cm"), ask(5, "mg", "ml"), ask(5, "g", "毫升"), ask("?", "m", "cm"), ask(1, "m", "kg"), ask(1, "km", "mm"))
    assert [t[0] for t in told] == [
        "120 斤 = 60 kg", "37.5 °C = 99.5 °F", "5 CM = 5 cm（来源与目标单位相同）。", f"错误：不支持「mg」→「ml」的换算。{toolbox.UNIT_SUPPORTED}", toolbox.UNIT_REFUSED, toolbox.UNIT_NOT_A_NUMBER,
        f"错误：不支持「m」→「kg」的换算。{toolbox.UNIT_SUPPORTED}", "1 km = 1e+06 mm",
    ]
    assert [t[1] for t in told] == [True, True, True, False, False, False, False, True]


def test_numbers_are_written_in_general_form(spark):
    xs = [0.0, 1.0, 60.0, 0.5, 1 / 24, 123456.0, 999999.5, 1234567.0, 0.0001, 0.00001234, -2.5, 1e300, 37.77777777, -0.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", toolbox.general(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [f"{x + 0:g}" for x in xs]


def test_red_flags_and_timelines_are_reported(spark):
    told = observe(spark, "check_red_flags", {"symptoms": ["胸口疼", "大汗", "体重下降"]}, {"symptoms": ["乏力"]}, {"symptoms": []}, {"symptoms": [" "]}, {})
    lines = told[0][0].split("\n")
    assert lines[0] == toolbox.FLAGS_URGENT and lines[1].startswith("- [心血管] ") and lines[2] == toolbox.FLAGS_SOON and "（命中：「体重下降」）" in lines[3] and lines[4] == toolbox.FLAGS_CLOSE
    assert [t[0] for t in told[1:]] == [toolbox.FLAGS_NONE, toolbox.FLAGS_EMPTY, toolbox.FLAGS_EMPTY, toolbox.BAD_ARGUMENTS.format("symptoms")] and [t[1] for t in told] == [True, True, False, False, False]
    told = observe(spark, "timeline_calc", {"events": ["昨天咳嗽", "3天前发热", "不记得", "2026-09-20复诊", "今天头疼", "12小时前吐"]}, {"events": ["以前"]}, {"events": []}, {"events": ["2周前"]})
    assert told[0][0].split("\n") == [
        "今天日期：2026-09-18", "时间线（由早到晚）：", "1. 约3天前（≈2026-09-15）：3天前发热", "2. 约1天前（≈2026-09-17）：昨天咳嗽", "3. 约0.5天前（≈2026-09-18）：12小时前吐", "4. 今天：今天头疼",
        "5. 日期在未来（≈2026-09-20），请与用户确认：2026-09-20复诊", "相邻事件间隔：", "- 事件1 → 事件2：约 2 天", "- 事件2 → 事件3：约 0.5 天", "- 事件3 → 事件4：约 0.5 天", "- 事件4 → 事件5：约 2 天", toolbox.TIMELINE_UNREAD + "不记得",
    ]
    assert told[1] == (toolbox.TIMELINE_NONE + "\n" + toolbox.TIMELINE_ASK + "以前", False) and told[2] == (toolbox.TIMELINE_EMPTY, False) and told[3][0].endswith("：2周前")


def test_evidence_is_found_for_all_calls_at_once(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", i, t, "手册") for i, t in enumerate(["lung pneumonia fever cough", "skin rash itch", "pneumonia of the lung", "broken bone leg"])], "chunk_id string, doc_id string, ord long, text string, source string")
    calls = [(1, {"query": "pneumonia lung", "k": 1}), (2, {"query": "zzz qqq"}), (3, {"query": " "}), (4, {"query": "rash itch", "k": 9}), (5, {"q": 1})]
    rows = spark.createDataFrame([(i, json.dumps(a)) for i, a in calls], "id long, arguments string")
    got = {r.id: r for r in toolbox.retrieval_tool(chunks, toolbox.SearchConfig(threshold=0.3))(rows).collect()}
    payload = json.loads(got[1].observation.removeprefix(toolbox.FOUND))
    assert len(payload) == 1 and payload[0]["chunk_id"] in ("c0", "c2") and payload[0]["source"] == "手册" and payload[0]["section"] == "" and got[1].chunk_ids == [payload[0]["chunk_id"]]
    assert got[3].observation == toolbox.NO_SEARCH and not got[3].ok and got[5].observation == toolbox.BAD_ARGUMENTS.format("query") and "c1" in got[4].chunk_ids
    assert got[2].ok and (got[2].chunk_ids or got[2].observation == "zzz qqq".join(toolbox.NOTHING_FOUND))


def scripted(spark, script, seen, default=""):
    def model(open_, turn):
        rows = open_.collect()
        seen.extend((r.id, turn, r.transcript) for r in rows)
        return spark.createDataFrame([(r.id, script.get((r.id, turn), default)) for r in rows if script.get((r.id, turn), default) is not None], "id long, reply string")

    return model


CALL = 'TOOL: calculate_bmi\nARGS: {"weight_kg": 70, "height_cm": 175}'


def test_rounds_run_tools_and_hand_their_results_back(spark):
    seen = []
    script = {(1, 0): CALL, (1, 1): 'TOOL: check_red_flags\nARGS: {"symptoms": ["胸痛"]}', (1, 2): "完", (2, 0): "直接答", (4, 0): None, (5, 0): 'TOOL: no_such_tool\nARGS: {}'} | {(3, t): CALL for t in range(9)}
    asked = spark.createDataFrame([(i, f"q{i}") for i in range(1, 6)], "id long, question string")
    done = {r.id: r for r in agent.run_rounds(asked, scripted(spark, script, seen), toolbox.standard_tools(), 3).collect()}
    assert (done[1].rounds, done[1].answer, done[1].used_tools) == (2, "完", ["calculate_bmi", "check_red_flags"])
    told = [(m.role, m.content) for m in done[1].messages]
    assert [r for r, _ in told] == ["user", "assistant", "tool", "assistant", "tool"] and told[2][1].startswith("calculate_bmi 返回：BMI = 22.9") and told[4][1].startswith("check_red_flags 返回：")
    assert "BMI = 22.9" in next(t for i, turn, t in seen if (i, turn) == (1, 1))
    assert (done[2].rounds, done[2].answer, done[2].used_tools) == (0, "直接答", []) and (done[3].rounds, done[3].answer, done[3].used_tools) == (3, CALL, ["calculate_bmi"])
    assert done[4].answer == "" and done[5].answer.startswith("TOOL: no_such_tool")
    assert sorted(turn for i, turn, _ in seen if i == 3) == [0, 1, 2, 3] and all(turn == 0 for i, turn, _ in seen if i in (2, 4, 5))
    seen.clear()
    last = agent.run_rounds(asked.where("id = 2"), scripted(spark, script, seen), toolbox.standard_tools(), 3, finalize=lambda rows, turn: rows.select("id", F.concat(F.lit("终："), "draft").alias("reply"))).collect()
    assert last[0].answer == "终：直接答" and len(seen) == 1  # nobody waited after the first round


def output(reply="多休息", evidence=(), confidence="low", steps=("休息",), flags=(), risk="low"):
    return json.dumps({"reply": reply, "risk_level": risk, "case_card": {"red_flags_found": list(flags)}, "assessment": {"hypotheses": [{"name": "感冒", "likelihood": "low"}], "evidence": list(evidence), "confidence": confidence, "next_steps": list(steps), "missing_info": ["体温", "未提供"]}}, ensure_ascii=False)


def test_turns_are_scanned_answered_and_reviewed(spark):
    """A turn in danger never reaches the model; evidence that no tool returned is dropped and told."""
    chunks = spark.createDataFrame([("chunk-001", "d", 0, "common cold rest")], "chunk_id string, doc_id string, ord long, text string")
    kb = lambda ref: {"source": "kb", "ref": ref, "detail": "x"}
    asked = spark.createDataFrame(
        [(1, "我想自杀", None, 0), (2, "有点感冒", None, 0), (3, "还是头疼", "用户：头疼\n助手：多久了", 1), (4, "有点困", None, 0), (5, " ", None, 0), (6, "怎么办", "用户：累", 7), (7, "感冒了", None, 0), (8, "感冒了", None, 0), (9, "乏力", None, 0)],
        "id long, question string, history string, answered int",
    )
    look = 'TOOL: retrieve_evidence\nARGS: {"query": "cold rest"}'
    script = {
        (2, 0): look, (2, 1): output(evidence=[kb("chunk-001")]), (3, 0): output("您肯定没事"), (4, 0): "说不好", (6, 0): output(confidence="high", steps=["就医"]),
        (7, 0): look, (7, 1): output(evidence=[kb("chunk-999"), kb("chunk-001"), {"source": "dialogue", "ref": "", "detail": "说过"}]), (8, 0): output(evidence=[kb("chunk-001")]), (9, 0): output(flags=["胸痛"]),
    }
    seen = []
    tools = toolbox.standard_tools(chunks, config=toolbox.SearchConfig(threshold=0.0, strategy="vector"))
    found = {r.id: r for r in agent.answer_turns(asked, scripted(spark, script, seen), tools, {"self_harm": "求助热线"}).collect()}
    assert set(found) == {1, 2, 3, 4, 6, 7, 8, 9} and 1 not in {i for i, _, _ in seen}
    first = {i: t for i, turn, t in seen if turn == 0}
    assert first[3] == "用户：头疼\n助手：多久了\n还是头疼" and first[2] == agent.FIRST_TURN_NOTE + "\n有点感冒" and first[6] == "用户：累\n" + agent.CLOSING_NOTE + "\n怎么办"
    assert (found[1].reply, found[1].risk_level, found[1].handled_as, found[1].rounds, found[1].next_steps) == ("求助热线", "emergency", "emergency", 0, list(agent.STEPS_OF["self_harm"]))
    assert [tuple(e) for e in found[1].evidence] == [("dialogue", "本轮输入", "前置安全扫描命中：self_harm:自伤相关表达")]
    assert (found[2].reply, found[2].handled_as, found[2].rounds, found[2].used_tools, found[2].retrieved, found[2].missing_info) == ("多休息", "normal", 1, ["retrieve_evidence"], ["chunk-001"], ["体温"])
    assert [tuple(e) for e in found[2].evidence] == [("kb", "chunk-001", "x")]
    assert found[3].handled_as == "review_modified" and "absolutist_claim" in found[3].codes and "肯定" not in found[3].reply
    assert (found[4].reply, found[4].risk_level, found[4].next_steps, found[4].evidence[0].detail) == (agent.NO_ANSWER, "medium", [agent.NO_ANSWER_STEP], agent.NO_ANSWER_EVIDENCE)
    assert found[6].confidence == "medium" and "closing_confidence_cap" in found[6].codes
    assert found[7].handled_as == "review_modified" and found[7].codes == ["fabricated_citation"] and [tuple(e) for e in found[7].evidence] == [("kb", "chunk-001", "x"), ("dialogue", "本轮对话", "说过")]
    assert found[8].codes == ["fabricated_citation"] and found[8].evidence == [] and found[8].retrieved == []
    assert found[9].codes == ["red_flag_escalation"] and found[9].risk_level == "high"
    assert agent.answer_turns(asked.where("id = 0"), scripted(spark, {}, []), {}, {}).collect() == [] and rules.ADVICE


def test_opening_tells_red_flags_beforehand(spark):
    asked = spark.createDataFrame([(1, "一直咳嗽三周", "", 9)], "id long, question string, history string, answered int")
    told = [(m.role, m.content) for m in agent.opening(asked, preinject=True).first().messages]
    assert [r for r, _ in told] == ["system", "system", "system", "user"] and told[1][1] == agent.CLOSING_NOTE and "持续咳嗽超过 3 周" in told[2][1] and told[3][1] == "一直咳嗽三周"


def test_names_of_tools_come_from_call_ids(spark):
    call = lambda *ids: json.dumps({"role": "assistant", "tool_calls": [{"id": i, "function": {"name": n}} for i, n in ids]})
    answer = lambda i: json.dumps({"role": "tool", "tool_call_id": i})
    rows = [
        (1, 0, call(("a", "x"), ("b", "y"))), (1, 1, answer("b")), (1, 2, answer("a")), (1, 3, answer("zz")), (1, 4, call(("a", "later"))), (1, 5, '{"role": "tool"}'), (1, 6, "no json {"), (1, 7, '{"role": "user", "tool_calls": "x"}'),
        (2, 0, answer("a")), (2, 1, call(("a", None), ("", "n"), (None, "x"))), (3, 0, None),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, message string")
    assert sorted(map(tuple, chat.tool_names(messages).collect())) == [(1, 1, "y"), (1, 2, "later"), (1, 3, chat.UNNAMED), (1, 5, chat.UNNAMED), (2, 0, chat.UNNAMED)]
    assert sorted(map(tuple, chat.used_tools(messages).collect())) == [(1, 3, ["x", "y", "later"]), (2, 3, ["n", "x"])]


def test_completions_take_the_way_that_the_request_asks_for(spark):
    whole = output("好")
    cases = [  # id, tools, structured, choice, calls before; replies by (step, note); expected finish, name, note
        (1, ["a"], True, "none", 0, {"tool": "文"}, ("stop", None, None)),
        (2, ["a"], True, chat.STRUCTURED, 0, {"final": whole}, ("tool_calls", chat.STRUCTURED, None)),
        (3, ["a"], True, None, 0, {"tool": "TOOL: a\nARGS: {}"}, ("tool_calls", "a", "tool:a")),
        (4, ["a"], True, "auto", 0, {"tool": "抢答", "nudged": "TOOL: a\nARGS: {}"}, ("tool_calls", "a", "tool:a(nudged)")),
        (5, ["a"], True, "auto", 1, {"tool": "草稿", "final": "{}"}, ("tool_calls", chat.STRUCTURED, "finalize")),
        (6, ["a"], False, "auto", 0, {"tool": "x", "nudged": " 文 "}, ("stop", None, "text(no-structured-tool)")),
        (7, [], True, "auto", 0, {"tool": "草稿", "final": "非", "retry": whole}, ("tool_calls", chat.STRUCTURED, "finalize")),
        (8, [], True, "auto", 0, {"tool": "草稿", "final": "非", "retry": "又非"}, ("stop", None, "finalize_failed")),
        (9, ["b"], False, "auto", 0, {"tool": "TOOL: a\nARGS: {}", "nudged": "TOOL: a\nARGS: {}"}, ("stop", None, "text(no-structured-tool)")),
    ]
    script = {c[0]: c[5] for c in cases}
    asked = []

    def model(first, second, note):
        def run(rows):
            held = rows.collect()
            asked.extend((r.id, second if r.note == note else first) for r in held)
            return spark.createDataFrame([(r.id, script[r.id].get(second if r.note == note else first), 10, 1) for r in held], "id long, reply string, input_tokens long, output_tokens long")

        return run

    rows = [(c[0], [("user", "q", 0), ("assistant", "", c[4])], c[1], c[2], c[3]) for c in cases]
    requests = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string,calls:int>>, tools array<string>, structured boolean, choice string")
    got = {r.id: r for r in chat.complete(requests, model("tool", "nudged", chat.REQUIRE_TOOL), model("final", "retry", chat.RETRY)).collect()}
    for c in cases:
        r = got[c[0]]
        assert (r.finish, r.name, r.note) == c[6], c
        assert r.prompt_tokens == 10 * len(c[5]) and r.completion_tokens == len(c[5]) and {k for i, k in asked if i == c[0]} == set(c[5])
    assert got[1].content == "文" and json.loads(got[5].content)["reply"] == "草稿" and got[6].content == "文" and json.loads(got[7].content)["reply"] == "好" and got[8].content == "草稿"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*V.STORE)
    yield
    spark.conf.unset(V.STORE[0])


TURNS = "conv_id long, turn long, role string, text string"


def test_a_stream_of_turns_gives_the_replies_of_the_batch(spark, small, tmp_path, rocks):
    turns = spark.read.parquet(f"{small}/conversations.parquet").where("conv_id < 12")
    schema = turns.schema
    for k in range(3):
        turns.where(f"turn % 1000 >= {2 * k} and (turn < {2 * k + 2} or {k} = 2)").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    bmi = F.concat(F.lit('TOOL: calculate_bmi\nARGS: {"weight_kg": '), (40 + F.length("transcript") % 60).cast("string"), F.lit(', "height_cm": 170}'))
    said = F.concat(F.lit('{"reply": "第'), F.length("transcript").cast("string"), F.lit('字", "assessment": {"confidence": "low"}}'))
    model = lambda rows, turn: rows.select("id", (bmi if turn == 0 else said).alias("reply"))
    answer = lambda requests: agent.answer_turns(requests, model, toolbox.standard_tools(), {}, max_turns=1, max_rounds=1).select("id", "reply", "handled_as", F.array_join("used_tools", ",").alias("used"), "rounds")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second run finds nothing new
        V.answer_stream(stream, answer, f"{tmp_path}/out", f"{tmp_path}/check", most=3).awaitTermination()
    got = P.read_json(spark, f"{tmp_path}/out", "id string, reply string, handled_as string, used string, rounds long")
    want = answer(chat.turn_requests(turns, most=3))
    columns = ["id", "reply", "handled_as", "used", "rounds"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())) and got.count() == turns.where("role = 'user'").count()


def test_idle_conversations_are_closed(spark, tmp_path, rocks):
    for k, rows in enumerate([[(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", None)], [(3, 0, "user", "c")], [(1, 5, "user", "d")]]):
        spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = V.stream_requests(stream, idle_ms=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/c").start()
    want = {("1:closed", 1, None, None, "用户：a\n助手：b", 1, True), ("2:closed", 2, None, None, "用户：", 0, True), ("1:5", 1, 5, "d", "", 0, False)}  # the first one begins anew
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and not want <= {tuple(r) for r in spark.table("idle").collect()}:
            assert query.exception() is None
            time.sleep(1)
    finally:
        query.stop()
    assert want <= {tuple(r) for r in spark.table("idle").collect()}
