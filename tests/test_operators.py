"""Properties of rewrites whose equality to the plain loops is not obvious, and of sources and streams."""

import difflib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import bridge, chunking, evaluation, maintenance as M
from quillon.sources import files
from quillon.streaming import buckets as B, progress as P


def test_longest_common_substring_is_that_of_difflib(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 9))), "".join(rng.choices("abc", k=rng.randint(0, 12)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.longest_common_substring(F.col("a"), F.col("b")).alias("n")).collect()
    for r in rows:
        assert r.n == difflib.SequenceMatcher(None, r.a, r.b, autojunk=False).find_longest_match(0, len(r.a), 0, len(r.b)).size


def test_heading_paths_are_those_of_a_stack(spark):
    rng = random.Random(2)
    docs = [(d, "\n".join(rng.choice(["# A", "## B", "### C", "#### D", "text"]) + str(i) for i in range(12))) for d in range(60)]
    want = set()
    for d, text in docs:
        stack, section, seen = [], 0, {}
        for line in text.split("\n"):
            if line.startswith("#"):
                marks, title = line.split(" ", 1)
                stack = [x for x in stack if x[0] < len(marks)] + [(len(marks), title)]
                section += 1
            else:
                seen.setdefault(section, (" / ".join(t for _, t in stack), []))[1].append(line)
        want |= {(d, s, p, "\n".join(b)) for s, (p, b) in seen.items()}
    rows = chunking.heading_sections(chunking.lines_of(spark.createDataFrame(docs, "doc long, text string"), "doc", "text"), "doc")
    assert {(r.doc, r.section, r.path, r.body) for r in rows.collect()} == want


def test_recursive_split_keeps_the_size():
    text = "\n\n".join("句子一。句子二，" * n for n in (3, 90, 200))
    pieces = chunking.recursive_split(text)
    assert len(pieces) > 3 and max(map(len, pieces)) <= 600
    assert chunking.recursive_split("") == [] and chunking.recursive_split("短") == ["短"]


def test_wilson_interval_without_trials(spark):
    row = spark.range(1).select(evaluation.wilson_interval(F.lit(0), F.lit(0)).alias("c")).first()
    assert (row.c.low, row.c.high) == (0.0, 0.0)


def test_equal_texts_get_their_own_chunk_ids(spark):
    rows = spark.createDataFrame([("d", "x", 1), ("d", "x", 2), ("e", "x", 1)], "doc string, text string, ord long")
    ids = [r.chunk_id for r in M.with_chunk_ids(rows, "doc", "text", "ord").collect()]
    assert len(set(ids)) == 3 and all(i.startswith("kb::") for i in ids)


@pytest.mark.parametrize(
    ("text", "value"),
    [('{"a": [1, {"b": tr', {"a": [1, {}]}), ('{"a": "x\\', {"a": "x"}), ("[1, 2", [1, 2]), ("prose", None), ('{"a" 1}', None), ("", None), (None, None), ('{"a": 1} tail }', {"a": 1})],
)
def test_tolerant_json(text, value):
    assert bridge.tolerant_json(text) == value


def test_first_of_two_calls_and_strings_with_braces():
    assert bridge.tool_call('{"name": "a", "arguments": "{\\"x\\": 1"} {"name": "b", "arguments": {}}') == {"name": "a", "arguments": {"x": 1}}
    assert [o for o in bridge.json_objects('x {"k": "}{"} y')] == [{"k": "}{"}]


def test_docx_and_xml():
    box = io.BytesIO()
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(box, "w") as out:
        out.writestr("word/document.xml", f"<w:document {space}><w:body><w:p><w:r><w:t>一</w:t></w:r></w:p><w:tbl><w:tr>{cell.format('a')}{cell.format('b')}</w:tr></w:tbl></w:body></w:document>")
    assert files.docx_text(box.getvalue()) == "一\na | b"
    xml = "<article><article-title>T <i>x</i></article-title><body><sec><title>S</title><p>p</p><sec><title>U</title><p>q</p></sec></sec></body></article>"
    assert files.article_markdown(xml) == ("T x", "# T x\n\n## S\n\np\n\n### U\n\nq")
    assert files.article_markdown("<broken") == (None, None)


def test_registry_reads_and_refuses(spark):
    rows = files.read_registry(spark, "", "files:\n  - {file: a/b.md, doc_id: ' d1 '}\n").collect()
    assert (rows[0].doc_id, rows[0].name, rows[0].tier) == ("d1", "b", "")
    with pytest.raises(ValueError):
        files.read_registry(spark, "", "files: []")


def test_strict_lines_fail_with_their_number(spark):
    rows = spark.createDataFrame([('{"id": 1}', 1), ("{bad", 7)], "value string, line long")
    with pytest.raises(Exception, match="line 7"):
        files.strict(rows, "id long").collect()


def test_texts_are_read_from_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"caf\xe9")
    (tmp_path / "b.txt").write_text(" \n", encoding="utf-8")
    (tmp_path / "c.bin").write_text("x", encoding="utf-8")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "b.txt"} and rows["a.md"].text == "caf�" and rows["b.txt"].error == "empty file"


def test_stream_of_events_is_replayed_and_watched(spark, tmp_path):
    source = tmp_path / "in"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = spark.createDataFrame([(1, 7, "view", 1.0), (2, 7, "error", None), (3, 8, "view", 20.0)], "event_id long, user_id long, event_type string, value double")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60)).select("event_id", "ts", "user_id", "event_type", "value")
    rows.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    P.watch(stream, "watched", str(tmp_path / "c1")).awaitTermination()
    assert {(r.dimension, r.done, r.scored, r.correct) for r in spark.table("watched").collect()} == {("view", 2, 2, 1), ("error", 1, 0, 0)}
    target = str(tmp_path / "table")
    for _ in range(2):  # the second run finds nothing new
        B.replay(stream, target, "user_id", "event_id", str(tmp_path / "c2")).awaitTermination()
    assert {(r.user_id, r.event_id) for r in B.read_table(spark, target).collect()} == {(7, 2), (8, 3)}
    assert P.current(spark, str(tmp_path / "none")) is None


def test_index_is_built_step_by_step(spark, tmp_path):
    from quillon import index as X

    path = str(tmp_path / "index")
    a, b = "# 心血管\n## 高血压\n【高血压】限盐。", "# 总论\n内容一。"
    with pytest.raises(X.IndexMissingError):
        X.load_index(spark, path)
    one = X.build_index(spark.createDataFrame([("a.md", a), ("b.md", b)], "doc_id string, text string"), path)
    assert (one.n_chunks, one.embedded, one.reused, one.file_status) == (2, 2, 0, {"new": 2})
    two = X.build_index(spark.createDataFrame([("a.md", a), ("b.md", b)], "doc_id string, text string"), path)
    assert (two.embedded, two.reused, two.file_status) == (0, 2, {"unchanged": 2})
    three = X.build_index(spark.createDataFrame([("a.md", a + "多运动。")], "doc_id string, text string"), path)
    assert (three.embedded, three.reused, three.removed, three.file_status) == (1, 0, 2, {"changed": 1, "removed": 1})
    other = X.build_index(spark.createDataFrame([("a.md", a + "多运动。")], "doc_id string, text string"), path, model="other")
    assert other.embedded == 1
    index = X.load_index(spark, path)
    assert index.first().section == "心血管 / 高血压"
    hits = X.retrieve(index, spark.createDataFrame([(1, "高血压 限盐")], "query_id long, question string"), threshold=0.0).collect()
    assert hits[0].doc_id == "a.md" and "限盐" in hits[0].text
    with pytest.raises(ValueError):
        X.retrieve(index, spark.createDataFrame([(1, " ")], "query_id long, question string"))


def test_settings_and_reports(tmp_path):
    from datetime import datetime

    from quillon.sources import settings as C

    assert C.read_env("A=1\n# x\nB='2'\n", {"A": "0"}) == {"B": "2"}
    assert C.Experiment.read({"name": "x", "engine": "agent"}).layer == "AGENT"
    for wrong in ({}, {"name": "x", "y": 1}, {"name": "x", "engine": "z"}, {"name": "x", "batch_size": 0}):
        with pytest.raises(ValueError):
            C.Experiment.read(wrong)
    early, late = (C.run_name("n", {"b": 1, "a": 2}, datetime(2026, 1, d)) for d in (1, 2))
    assert early != late and early[-8:] == late[-8:] == C.run_name("n", {"a": 2, "b": 1}, datetime(2026, 1, 1))[-8:]
    C.new_run(tmp_path, "r")
    with pytest.raises(FileExistsError):
        C.new_run(tmp_path, "r")
    (tmp_path / "report.md").write_text("1")
    assert C.archive(tmp_path / "report.md", tmp_path / "kept", "row") and not C.archive(tmp_path / "report.md", tmp_path / "kept", "row")
    assert (tmp_path / "kept" / "INDEX.md").read_text() == "row\n"
    assert C.width("a中") == 3 and C.padded("中", 3) == "中 " and C.bar(1, 2, 4) == "██░░" and C.size_text(2048) == "2.0 KB"
    assert C.markdown_table(["a", "b"], [[1, None]]).splitlines()[-1] == "| 1 | — |"
    tool = {"name": "check", "description": "核对。再说。", "parameters": {"properties": {"s": {"type": "array", "items": {"type": "string"}}, "n": {"type": "integer"}}, "required": ["s"]}}
    assert C.tool_catalog([tool]) == "- check(s: string[], n: integer（可选）)：核对"
    assert C.content_text([{"type": "text", "text": "a"}, {"type": "image"}, "b"]) == "a\nb"


EMPTY = {"question": None, "context": None, "options": None, "answer": None, "reference_answer": None, "key_points": None, "output": None, "thinking": None, "hypotheses": None}
ITEM = "id long, task_type string, question string, context string, options map<string,string>, answer string, reference_answer string, key_points array<string>, output string, thinking string, hypotheses array<struct<name:string,likelihood:string>>"


def scored(spark, *items):
    from quillon.operators.scoring import score_items

    rows = spark.createDataFrame([{"id": i, **EMPTY, **x} for i, x in enumerate(items)], ITEM)
    return [r.asDict() for r in score_items(rows).orderBy("id").collect()]


def test_every_task_is_scored_by_its_rule(spark):
    inline = "首选检查？ A. 胸片  B. CT\nC. 心电图"
    cases = [
        ({"task_type": "mcq_single", "answer": " b ", "options": {"A": "甲", "B": "乙"}, "output": "答案：B"}, {"score": 1.0, "choice": "B"}),
        ({"task_type": "mcq_single", "answer": "C", "options": {"A": "甲", "B": "乙"}, "output": "选 C"}, {"score": 0.0, "choice": None}),
        ({"task_type": "mcq_single", "answer": "A", "options": {"A": "肺炎", "B": "急性阑尾炎"}, "output": "考虑肺炎", "hypotheses": []}, {"score": 1.0, "choice": "A"}),
        ({"task_type": "mcq_single", "answer": "A", "options": {"A": "肺炎", "B": "急性阑尾炎"}, "output": "考虑肺炎"}, {"score": 0.0, "choice": None}),
        ({"task_type": "calculation", "reference_answer": "答案：12.5", "output": "无", "thinking": "x = 12.45"}, {"score": 1.0, "value": 12.45}),
        ({"task_type": "calculation", "reference_answer": "答案：0", "output": "答案：0"}, {"score": 1.0, "value": 0.0}),
        ({"task_type": "calculation", "reference_answer": "3", "output": "答案：0", "thinking": "答案：3"}, {"score": 1.0, "value": 3.0}),
        ({"task_type": "evidence_qa", "answer": "YES", "context": "[摘要1] a [摘要 2] b", "output": "答案：是 [摘要2]"}, {"score": 1.0, "citation_traceable": True}),
        ({"task_type": "evidence_qa", "answer": "no", "context": "[摘要1]", "output": "答案：可能 [摘要3]"}, {"score": 0.0, "verdict": "maybe", "citation_traceable": False}),
        ({"task_type": "evidence_qa", "answer": "", "output": "不知道"}, {"score": 0.0, "verdict": None}),
        ({"task_type": "open_diagnosis", "reference_answer": "诊断：肺炎", "output": "", "thinking": "考虑肺炎", "key_points": ["胸片", "血常规"]}, {"score": 1.0, "diagnosis": "肺炎", "diagnosis_similarity": 1.0, "key_point_coverage": 0.0}),
        ({"task_type": "dialogue_diagnosis", "output": "肺炎"}, {"score": 0.0, "diagnosis": None, "key_point_coverage": None}),
        ({"task_type": "open_ddx", "key_points": ["肺炎", "哮喘"], "output": "肺炎"}, {"score": 0.5, "correct": None, "mrr": None}),
        ({"task_type": "open_ranked_ddx", "key_points": ["肺炎", "哮喘"], "output": "胃痛\n\n哮喘"}, {"score": 0.5, "mrr": 0.5}),
        ({"task_type": "open_ranked_ddx", "output": "肺炎"}, {"score": None, "mrr": 0.0}),
        ({"task_type": "open_workup", "question": inline, "reference_answer": "答案是B", "output": "答案：B"}, {"score": 1.0, "correct": True}),
        ({"task_type": "open_workup", "question": inline, "reference_answer": "答案是B", "output": "心电图 C"}, {"score": 0.0, "choice": "C"}),
        ({"task_type": "open_workup", "question": "下一步？", "key_points": ["完善胸部CT检查；短句；立即给予吸氧治疗"], "output": "应当完善胸部CT检查"}, {"score": 0.5, "correct": None}),
        ({"task_type": "rubric_scored", "output": "x"}, {"score": None, "correct": None}),
        ({"task_type": "retrieval", "output": "x"}, {"score": None, "correct": None}),
    ]
    for got, (item, want) in zip(scored(spark, *(x for x, _ in cases)), cases, strict=True):
        assert {k: got[k] for k in want} == want, item


REVIEW = "id long, reply string, hypotheses array<string>, evidence array<struct<source:string,ref:string,detail:string>>, retrieved array<string>, confidence string, red_flags array<string>, risk_level string, next_steps array<string>, closing boolean"


def test_review_mends_degrades_and_replaces(spark):
    from quillon.operators import rules as R

    base = {"reply": "好的", "hypotheses": ["x"], "evidence": [], "retrieved": ["c1"], "confidence": "low", "red_flags": [], "risk_level": "low", "next_steps": ["休息"], "closing": False}
    cases = [
        ({}, {"action": "pass", "reply": "好的"}),
        ({"confidence": "medium", "next_steps": ["必要时呼叫急救"]}, {"action": "degrade", "next_steps": [R.ADVICE, "必要时呼叫急救"], "codes": ["closing_advice_missing"]}),
        ({"red_flags": ["胸痛"]}, {"action": "degrade", "risk_level": "high", "next_steps": [R.ADVICE, "休息"]}),
        ({"red_flags": ["胸痛"], "risk_level": "emergency", "reply": "请呼叫急救"}, {"action": "pass", "codes": []}),
        ({"evidence": [("kb", "c1", "a"), ("kb", "c9", "b"), ("dialogue", "c9", "c")]}, {"action": "degrade", "evidence": [("kb", "c1", "a"), ("dialogue", "c9", "c")]}),
        ({"confidence": "high", "closing": True, "next_steps": ["就医"]}, {"action": "degrade", "confidence": "medium"}),
        ({"reply": "自杀的念头 "}, {"action": "degrade", "reply": "自杀的念头\n\n求助"}),
        ({"reply": "您得了肺癌"}, {"action": "replace", "reply": "拒答", "next_steps": [R.ADVICE, "休息"]}),
        ({"reply": " "}, {"action": "replace", "reply": R.CONTINUE}),
        ({"reply": "您肯定没事"}, {"action": "degrade", "reply": "您暂时没有发现需要紧急处理的信号（但无法完全排除其他可能）"}),
        ({"reply": "根据相关研究，多喝水", "retrieved": []}, {"action": "degrade", "reply": "结合您描述的情况，多喝水"}),
        ({"hypotheses": [], "confidence": "medium", "next_steps": ["就医"]}, {"action": "degrade", "confidence": "low"}),
    ]
    rows = spark.createDataFrame([{"id": i, **base, **x} for i, (x, _) in enumerate(cases)], REVIEW)
    templates = {"refuse": "拒答", "self_harm_suffix": "求助"}
    for got, (given, want) in zip(R.review(rows, templates).orderBy("id").collect(), cases, strict=True):
        found = {k: [tuple(x) for x in got[k]] if k == "evidence" else got[k] for k in want}
        assert found == want, given
    mend = lambda bad: bad.where("id = 7").withColumn("reply", F.lit("建议检查"))
    also = lambda all_: all_.where("id = 0").select("id", F.array(F.lit("tone")).alias("more"))
    told = {r.id: r for r in R.review(rows, templates, mend, also).collect()}
    assert (told[7].action, told[7].reply, told[7].codes) == ("fix", "建议检查", ["diagnosis_language"]) and told[8].action == "replace" and told[0].codes == ["tone"]


def test_json_sinks_state_and_throttle(spark, tmp_path):
    one, two = spark.range(3), spark.range(3, 5)
    P.append_json(one, f"{tmp_path}/log")
    P.append_json(two, f"{tmp_path}/log")
    assert sorted(r.id for r in P.read_json(spark, f"{tmp_path}/log", "id long").collect()) == [0, 1, 2, 3, 4]
    P.overwrite_json(one, f"{tmp_path}/out")
    held = P.read_json(spark, f"{tmp_path}/out", "id long")
    P.overwrite_json(two, f"{tmp_path}/out")
    assert sorted(r.id for r in P.read_json(spark, f"{tmp_path}/out", "id long").collect()) == [3, 4]
    assert sorted(r.id for r in held.collect()) == [0, 1, 2]  # a reader of the old version goes on
    state = P.merge_state({"status": "running", "done": 1}, {"status": "done", "done": 2, "note": None}, "t1")
    assert state == {"status": "done", "done": 2, "updated_at": "t1"}
    assert P.merge_state(state, {"status": "running", "done": 3}, "t2") == {"status": "done", "done": 3, "updated_at": "t2"}
    assert P.rate_and_eta(0, 5, 1.0) == (0.0, None) and P.rate_and_eta(2, 6, 4.0) == (0.5, 8.0)
    now, seen = [0.0], []
    tell = P.throttled(seen.append, 2.0, lambda: now[0])
    for at in (0.0, 1.0, 2.0, 3.5, 4.0):
        now[0] = at
        tell(at)
    tell(9, force=True)
    assert seen == [0.0, 2.0, 4.0, 9]


def test_a_version_is_replaced_without_a_gap(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert P.current(spark, path) is None
    P.publish_all({"a": spark.range(1), "b": spark.range(2)}, path, "v1")
    P.publish_all({"a": spark.range(3), "b": spark.range(4)}, path, "v2")
    assert (P.current(spark, path, "a").count(), P.current(spark, path, "b").count()) == (3, 4)
    assert sorted(x.name[:2] for x in (tmp_path / "t").iterdir() if not x.name.endswith(".crc")) == ["_C", "v1", "v2"]
    held = P.current(spark, path, "a")
    P.publish_all({"a": spark.range(9), "b": spark.range(9)}, path, "v2")  # a version that is written again
    assert held.count() == 3 and P.current(spark, path, "a").count() == 9
    P.publish_all({"a": spark.range(1), "b": spark.range(1)}, path, "v3")
    assert sorted(x.name[:2] for x in (tmp_path / "t").iterdir() if x.is_dir()) == ["v2", "v2", "v3"]


def test_budget_passes_over_what_does_not_fit(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(0, 60)])) for i in range(300)]
    want, taken = set(), {}
    for g, i, n in rows:
        if n is not None and taken.get(g, 0) + n <= 500:
            taken[g] = taken.get(g, 0) + n
            want.add((g, i, taken[g]))
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(5)
    assert {tuple(r) for r in M.fit_within_budget(df, ["g"], ["i"], "n", 500).select("g", "i", "total").collect()} == want
    assert M.fit_within_budget(df.where("i < 0"), ["g"], ["i"], "n", 500).collect() == []


@pytest.mark.parametrize(("n", "most"), [(0, 3), (3, 3), (10, 3), (101, 40)])
def test_spread_sample_takes_even_steps(spark, n, most):
    import hashlib

    order = sorted(range(n), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    want = set(order) if n <= most else {order[i * n // most] for i in range(most)}
    assert {r.id for r in M.spread_sample(spark.range(n), F.md5(F.col("id").cast("string")), ["id"], most, parts=7).collect()} == want


def test_converted_texts_are_those_of_the_first_adapter(spark):
    from quillon.operators import curation as C
    from quillon.sources.settings import duration_text

    one = spark.createDataFrame([(2, "same"), (1, "same"), (3, " "), (4, None)], "id long, text string")
    two = spark.createDataFrame([(1, "same"), (9, "other")], "id long, text string")
    assert sorted(map(tuple, C.convert({"one": lambda: one, "two": lambda: two}).collect())) == [("one", 1, "same"), ("two", 9, "other")]
    assert [duration_text(x) for x in (-1, 59.9, 61, 3600, 7325)] == ["0s", "59s", "1m01s", "1h00m", "2h02m"]


def test_half_even_rounding_is_that_of_exact_decimals(spark):
    """Half to even is decided on the shortest decimal form; Python's rounding sees the binary value, and differs where that is just off a half."""
    got = spark.createDataFrame([(0.125,), (0.375,), (2.5,), (-0.125,)], "x double").select(F.bround("x", 2).alias("b"), "x").collect()
    assert all(r.b == round(r.x, 2) for r in got)
