"""Worked examples: parsers, tools, rules, chunking, model outputs.

The tables that come with the data hold no text of this kind, so each example
carries its rows; the SQL beside it is the result that each row must have.
``plans.parsing`` has most of them over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import bridge as J
from quillon.operators import chunking as K
from quillon.operators import curation as C
from quillon.operators import evaluation as E
from quillon.operators import rules as R
from quillon.operators import tools as L
from quillon.operators.scoring import choice_from_conclusion as choose, score_items as score_items_by_rule
from quillon.plans.registry import example


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    return "'" + value.replace("'", "''") + "'"


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """SQL for literal rows; ``columns`` as in 'id, name'."""
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def _frame(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ tokens and similarity

TOKENS = [(1, "高血压", "高血|血压"), (2, "川崎病", "川崎|崎病"), (3, "痛", "痛"), (4, "CT 检查", "ct|检查"), (5, "", ""), (6, "Été 3D", "t|3d")]


@example(rows_sql("id, tokens", [(i, t) for i, _, t in TOKENS]))
def tokenize(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in TOKENS]).select("id", F.array_join(T.tokenize("text"), "|").alias("tokens"))


PAIRS = [
    (1, "嵌顿性腹股沟斜疝", "考虑嵌顿性腹股沟疝可能"),
    (2, "肺炎", "诊断：肺炎。"),
    (3, "急性阑尾炎", "胆囊炎"),
    (4, "", "x"),
    (5, "A-B c", "abc"),
    (6, "a", "b"),
    (7, "冠状动脉粥样硬化", "冠状动脉粥样硬化性心脏病"),
]
NORMAL = [(1, "嵌顿性腹股沟斜疝"), (2, "肺炎"), (3, "急性阑尾炎"), (4, ""), (5, "abc"), (6, "a"), (7, "冠状动脉粥样硬化")]
#: Dice, longest common substring and similarity of the pairs, worked out by hand.
WORKED = [(1, 10 / 17, 6, 0.75), (2, 2 / 4, 2, 1.0), (3, 0.0, 1, 0.2), (4, 0.0, 0, 0.0), (5, 1.0, 3, 1.0), (6, 0.0, 0, 0.0), (7, 14 / 18, 8, 1.0)]


def _pairs(spark):
    return _frame(spark, "id long, a string, b string", PAIRS)


@example(rows_sql("id, plain", NORMAL))
def normalize_text(spark, table):
    return _pairs(spark).select("id", T.normalize("a").alias("plain"))


@example(rows_sql("id, dice", [(i, round(d, 6)) for i, d, _, _ in WORKED]))
def bigram_dice(spark, table):
    return _pairs(spark).select("id", F.round(T.bigram_dice(F.col("a"), F.col("b")), 6).alias("dice"))


@example(rows_sql("id, n", [(i, n) for i, _, n, _ in WORKED]))
def lcs_length(spark, table):
    return _pairs(spark).select("id", T.longest_common_substring(T.normalize("a"), T.normalize("b")).cast("long").alias("n"))


@example(rows_sql("id, similarity", [(i, round(s, 6)) for i, _, _, s in WORKED]))
def similarity(spark, table):
    return _pairs(spark).select("id", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@example(rows_sql("id, found", [(i, s >= 0.5) for i, _, _, s in WORKED]))
def fuzzy_contains(spark, table):
    return _pairs(spark).select("id", T.fuzzy_contains(F.col("a"), F.col("b")).alias("found"))


# ------------------------------------------------------------------ answers

CHOICES = [(1, "分析…… 答案：B", "B"), (2, "答案：A。更正，答案：(C)", "C"), (3, "应选 D。", "D"), (4, "没有结论", None), (5, "the answer is E", "E"), (6, "答案: b", "B")]


@example(rows_sql("id, choice", [(i, c) for i, _, c in CHOICES]))
def parse_mcq(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in CHOICES]).select("id", T.parse_choice(F.col("text")).alias("choice"))


NUMBERS = [(1, "答案：12.5 mg", 12.5), (2, "x = 3\n结果≈-4.25", -4.25), (3, "第1步\n共 30 片，每次 2 片\n完", 2.0), (4, "无", None), (5, "答案：0", 0.0)]


@example(rows_sql("id, value", [(i, v) for i, _, v in NUMBERS]))
def extract_number(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in NUMBERS]).select("id", T.extract_number(F.col("text")).alias("value"))


MATCHES = [(1, 10.0, 10.05, True), (2, 0.0, 0.005, True), (3, 0.5, 0.0, False), (4, None, 1.0, False), (5, 98.0, 100.0, False), (6, 99.5, 100.0, True)]


@example(rows_sql("id, same", [(i, m) for i, _, _, m in MATCHES]))
def numbers_match(spark, table):
    return _frame(spark, "id long, got double, want double", [x[:3] for x in MATCHES]).select("id", T.numbers_match(F.col("got"), F.col("want")).alias("same"))


OPTIONS = [(1, "首选检查？ A. 胸片  B. CT\nC. 心电图", "A=胸片;B=CT;C=心电图"), (2, "只有 A. 一个", ""), (3, "没有选项", "")]


@example(rows_sql("id, options", [(i, o) for i, _, o in OPTIONS]))
def inline_options(spark, table):
    entries = F.map_entries(T.inline_options(F.col("q")))
    return _frame(spark, "id long, q string", [x[:2] for x in OPTIONS]).select("id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("options"))


LETTERS = [(1, "答案是B，因为", "B"), (2, "答案：C", "C"), (3, "答案 D", "D"), (4, "无", None)]


@example(rows_sql("id, letter", [(i, x) for i, _, x in LETTERS]))
def reference_letter(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in LETTERS]).select("id", T.reference_letter(F.col("text")).alias("letter"))


PHRASES = [(1, "①肺炎：需要胸片", "肺炎"), (2, "(1)急性阑尾炎，右下腹痛", "急性阑尾炎"), (3, "心绞痛", "心绞痛"), (4, "", "")]


@example(rows_sql("id, phrase", [(i, p) for i, _, p in PHRASES]))
def core_phrase(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in PHRASES]).select("id", T.core_phrase(F.col("text")).alias("phrase"))


POINTS = [(1, "①胸片；②血常规。③心电图", "胸片|血常规。|心电图"), (2, "一\n- 二三 ; 四", "二三"), (3, "", "")]


@example(rows_sql("id, points", [(i, p) for i, _, p in POINTS]))
def split_key_points(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in POINTS]).select("id", F.array_join(T.split_key_points(F.col("text")), "|").alias("points"))


DIAGNOSES = [(1, ["诊断：急性心肌梗死（前壁）", "治疗"], "", "急性心肌梗死"), (2, ["治疗"], "诊断：肺炎，需抗感染。随访", "肺炎"), (3, [], "", None)]


@example(rows_sql("id, diagnosis", [(i, d) for i, _, _, d in DIAGNOSES]))
def extract_diagnosis(spark, table):
    return _frame(spark, "id long, kp array<string>, ref string", [x[:3] for x in DIAGNOSES]).select("id", T.expected_diagnosis(F.col("kp"), F.col("ref")).alias("diagnosis"))


LISTS = [(1, ["①肺炎：发热；②肺结核，如粟粒性结核"], "肺炎|肺结核|粟粒性结核"), (2, ["肺炎", "肺炎"], "肺炎"), (3, [], "")]


@example(rows_sql("id, expected", [(i, x) for i, _, x in LISTS]))
def extract_ddx(spark, table):
    return _frame(spark, "id long, kp array<string>", [x[:2] for x in LISTS]).select("id", F.array_join(T.expected_list(F.col("kp")), "|").alias("expected"))


COVERED = [(1, ["胸片", "血常规", "肝功能"], "做了胸片和血常规", 0.666667), (2, [], "x", None)]


@example(rows_sql("id, coverage", [(i, c) for i, _, _, c in COVERED]))
def key_point_coverage(spark, table):
    hit = F.size(F.filter("kp", lambda k: T.fuzzy_contains(k, F.col("text"))))
    return _frame(spark, "id long, kp array<string>, text string", [x[:3] for x in COVERED]).select("id", F.when(F.size("kp") > 0, F.round(hit / F.size("kp"), 6)).alias("coverage"))


RANKS = [(1, ["肺炎"], "1. 哮喘\n2. 肺炎\n3. 支气管炎", 0.5), (2, ["肺炎"], "肺炎", 1.0), (3, ["肺炎"], "哮喘", 0.0)]


@example(rows_sql("id, mrr", [(i, m) for i, _, _, m in RANKS]))
def mrr(spark, table):
    lines = F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "")
    at = F.filter(F.transform(lines, lambda x, i: F.when(F.exists("want", lambda w: T.fuzzy_contains(w, x)), i + 1)), lambda x: x.isNotNull())
    return _frame(spark, "id long, want array<string>, text string", [x[:3] for x in RANKS]).select("id", F.coalesce(F.round(1.0 / F.get(at, F.lit(0)), 6), F.lit(0.0)).alias("mrr"))


EVIDENCE = [(1, "答案：是 [摘要1][摘要2]", 2, "yes", True), (2, "答案：No [摘要3]", 2, "no", False), (3, "答案：可能", 1, "maybe", False), (4, "不知道", 1, None, False)]


@example(rows_sql("id, choice, traceable", [(i, c, t) for i, _, _, c, t in EVIDENCE]))
def evidence_qa(spark, table):
    told = F.lower(F.nullif(F.regexp_extract("text", "(?i)答案\\s*[:：]?\\s*(yes|no|maybe|是|否|可能)", 1), F.lit("")))
    choice = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("是", "yes", "否", "no", "可能", "maybe"))), told), told)
    cited = F.regexp_extract_all("text", F.lit("\\[摘要\\s*([0-9]+)\\]"), F.lit(1))
    traceable = (F.size(cited) > 0) & F.forall(cited, lambda c: c.cast("int") <= F.greatest(F.col("n"), F.lit(1)))
    return _frame(spark, "id long, text string, n int", [x[:3] for x in EVIDENCE]).select("id", choice.alias("choice"), traceable.alias("traceable"))


CITED = [
    (1, "见 [chunk_id: kb::baike-38::3badd7513c40]。", [], "kb::baike-38::3badd7513c40"),
    (2, "见 kb::baike-38::3badd7513c40 和 kb::baike-38::3badd7513c40", [], "kb::baike-38::3badd7513c40"),
    (3, "见 [1]", ["kb::a::1"], "kb::a::1"),
    (4, "见 [9]", ["kb::a::1"], ""),
    (5, None, [], ""),
]


@example(rows_sql("id, citations", [(i, c) for i, _, _, c in CITED]))
def extract_citations(spark, table):
    return _frame(spark, "id long, text string, evidence array<string>", [x[:3] for x in CITED]).select("id", F.array_join(T.extract_citations(F.col("text"), F.col("evidence")), "|").alias("citations"))


ANSWERS = [("见 [1]", ["kb::a::1"]), ("见 kb::a::9", ["kb::a::1"]), ("没有引用", ["kb::a::1"]), ("x", []), ("见 [1][2]", ["kb::a::1", "kb::b::2"])]


@example("SELECT CAST(4 AS BIGINT) AS n, 0.5::DOUBLE AS locatable_rate")
def traceability_rate(spark, table):
    """Over the answers that have evidence: the share all of whose citations are found."""
    rows = _frame(spark, "text string, evidence array<string>", ANSWERS).where(F.size("evidence") > 0)
    rate = T.locatable_rate(T.extract_citations(F.col("text"), F.col("evidence")), F.col("evidence"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(rate >= 1.0, F.lit(False)).cast("int")), 4).alias("locatable_rate"))


@example(rows_sql("id, bad", [(1, "chunk-999"), (2, "")]))
def citation_fabricated(spark, table):
    rows = _frame(spark, "id long, refs array<string>, retrieved array<string>", [(1, ["chunk-001", "chunk-999"], ["chunk-001"]), (2, ["chunk-001"], ["chunk-001"])])
    return rows.select("id", F.array_join(F.array_except("refs", "retrieved"), "|").alias("bad"))


FAST = [(1, "肺炎", "考虑肺炎，建议胸片", True), (2, "肺炎", "哮喘", False)]


@example(rows_sql("id, correct", [(i, x) for i, _, _, x in FAST]))
def rule_fast_path(spark, table):
    """An answer that plainly contains the reference needs no judge."""
    return _frame(spark, "id long, want string, answer string", [x[:3] for x in FAST]).select("id", F.contains(T.normalize("answer"), T.normalize("want")).alias("correct"))


CONCLUSIONS = [
    (1, {"A": "肺炎", "B": "急性阑尾炎"}, "考虑肺炎", [], "A"),
    (2, {"A": "肺炎", "B": "急性阑尾炎"}, "需要检查", [("哮喘", "low"), ("急性阑尾炎", "high")], "B"),
    (3, {"A": "肺炎", "B": "哮喘"}, "肺炎或哮喘", [], None),
]


@example(rows_sql("id, choice", [(x[0], x[4]) for x in CONCLUSIONS]))
def choice_from_conclusion(spark, table):
    """The only option that the reply holds, else the option nearest to the likeliest hypothesis."""
    rows = _frame(spark, "id long, options map<string,string>, reply string, hyps array<struct<name:string,likelihood:string>>", [x[:4] for x in CONCLUSIONS])
    return rows.select("id", choose(F.col("options"), F.col("reply"), F.col("hyps")).alias("choice"))


ITEMS = [
    (1, "mcq_single", "B", "", "答案：B", [], 1.0, True),
    (2, "mcq_single", "A", "", "答案：B", [], 0.0, False),
    (3, "calculation", "", "答案：12.5", "约 = 12.5 mg", [], 1.0, True),
    (4, "evidence_qa", "yes", "", "答案：是", [], 1.0, True),
    (5, "open_diagnosis", "", "诊断：肺炎", "考虑肺炎", [], 1.0, True),
    (6, "open_ddx", "", "", "肺炎", ["肺炎", "哮喘"], 0.5, None),
    (7, "rubric_scored", "", "", "x", [], None, None),
    (8, "retrieval", "", "", "x", [], None, None),
]


def _scored(spark):
    rows = _frame(spark, "id long, task_type string, answer string, reference_answer string, output string, key_points array<string>", [x[:6] for x in ITEMS])
    absent = {"question": "string", "context": "string", "thinking": "string", "options": "map<string,string>", "hypotheses": "array<struct<name:string,likelihood:string>>"}
    scores = score_items_by_rule(rows.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()}))
    return scores.select("id", F.col("task_type").alias("task"), "score", "correct")


@example(rows_sql("id, task, score, correct", [(x[0], x[1], x[6], x[7]) for x in ITEMS]))
def score_items(spark, table):
    return _scored(spark)


@example(rows_sql("task, n, scored, correct", [("calculation", 1, 1, 1), ("evidence_qa", 1, 1, 1), ("mcq_single", 2, 2, 1), ("open_ddx", 1, 1, 1), ("open_diagnosis", 1, 1, 1), ("retrieval", 1, 0, 0), ("rubric_scored", 1, 0, 0)]))
def stage_score(spark, table):
    """Rule scores, overridden by a judgment of one item, summarised."""
    scores = _scored(spark)
    judged = E.override(scores.select("id", "score", "correct"), _frame(spark, "id long, score double", [(6, 1.0)]))
    whole = judged.join(scores.select("id", "task"), "id").withColumn("truncated", F.lit(False))
    return E.summarize(whole, ["task"]).select("task", "n", "scored", "correct")


# ------------------------------------------------------------------ tools

BODIES = [(1, 70.0, 175.0, 22.9, "正常"), (2, 45.0, 170.0, 15.6, "偏瘦"), (3, 74.0, 200.0, 18.5, "正常"), (4, 96.0, 200.0, 24.0, "超重"), (5, 112.0, 200.0, 28.0, "肥胖"), (6, 600.0, 175.0, None, None), (7, 70.0, 90.0, None, None)]


@example(rows_sql("id, bmi, class", [(x[0], x[3], x[4]) for x in BODIES]))
def bmi_class(spark, table):
    return _frame(spark, "id long, kg double, cm double", [x[:3] for x in BODIES]).select("id", L.bmi(F.col("kg"), F.col("cm")).alias("b")).select("id", "b.bmi", "b.class")


UNITS = [
    (1, 1.0, "斤", "kg", 0.5, "ok"), (2, 2.54, "厘米", "英寸", 1.0, "ok"), (3, 37.0, "摄氏度", "°F", 98.6, "ok"), (4, 98.6, "f", "°C", 37.0, "ok"),
    (5, 5.0, "g", "ml", None, "refused"), (6, 5.0, "mg", "ml", None, "unsupported"), (7, 1.0, "斤", "厘米", None, "unsupported"), (8, 3.0, " KG ", "kg", 3.0, "same"),
]


@example(rows_sql("id, result, status", [(x[0], x[4], x[5]) for x in UNITS]))
def convert_units(spark, table):
    rows = _frame(spark, "id long, v double, a string, b string", [x[:4] for x in UNITS]).select("id", L.convert(F.col("v"), F.col("a"), F.col("b")).alias("c"))
    return rows.select("id", F.round("c.result", 6).alias("result"), "c.status")


TODAY = "2026-09-20"
TIMES = [
    (1, "3天前开始发热", 3.0), (2, "昨天咳嗽", 1.0), (3, "2026-09-15 就诊", 5.0), (4, "前段时间不舒服", None), (5, "很久以前", None), (6, "大前天", 2.0), (7, "12小时前", 0.5), (8, "2026-13-40", None), (9, "2周前", 14.0),
]


def _times(spark):
    return _frame(spark, "id long, event string", [x[:2] for x in TIMES]).select("id", "event", L.days_ago(F.col("event"), F.lit(TODAY).cast("date")).alias("days"))


@example(rows_sql("id, days", [(x[0], x[2]) for x in TIMES]))
def timeline_parse(spark, table):
    """Note that 大前天 holds 前天 and so counts two days."""
    return _times(spark).select("id", "days")


@example("SELECT id, CAST(rank AS BIGINT) AS rank, on_date FROM (VALUES (9, 1, DATE '2026-09-06'), (3, 2, DATE '2026-09-15'), (1, 3, DATE '2026-09-17'), (6, 4, DATE '2026-09-18'), (2, 5, DATE '2026-09-19'), (7, 6, DATE '2026-09-20')) t(id0, rank, on_date), LATERAL (SELECT CAST(id0 AS BIGINT) AS id)")
def timeline_sorted(spark, table):
    from pyspark.sql import Window

    known = _times(spark).where("days is not null")
    rank = F.row_number().over(Window.orderBy(F.desc("days"), "id"))
    return known.select("id", rank.cast("long").alias("rank"), F.date_sub(F.lit(TODAY).cast("date"), F.bround("days").cast("int")).alias("on_date"))


@example(rows_sql("id, gap", [(9, None), (3, 9.0), (1, 2.0), (6, 1.0), (2, 1.0), (7, 0.5)]))
def timeline_gaps(spark, table):
    from pyspark.sql import Window

    known = _times(spark).where("days is not null")
    return known.select("id", (F.lag("days").over(Window.orderBy(F.desc("days"), "id")) - F.col("days")).alias("gap"))


# ------------------------------------------------------------------ rules

TURNS = [
    (1, "胸口压榨性疼了20分钟，还一直出汗", True, "emergency", "chest_pain"),
    (2, "现在没有压榨感了", True, None, None),
    (3, "我觉得活着没意思", True, "self_harm", "self_harm:自伤念头表达"),
    (4, "我不再想死了", True, None, None),
    (5, "孩子发烧了", True, "child", "child:儿童症状"),
    (6, "孩子发烧了", False, None, None),
    (7, "我有抑郁症", True, "psych", "psych:精神心理专项"),
    (8, "最近有点鼻塞", True, None, None),
]


def _turns(spark):
    rows = _frame(spark, "id long, text string, first boolean", [x[:3] for x in TURNS])
    return rows.select("id", R.prescan(F.col("text"), F.col("first")).alias("hit")).select("id", "hit.kind", "hit.rule_id")


@example(rows_sql("id, kind, rule_id", [(x[0], x[3], x[4]) for x in TURNS]))
def prescan_first_hit(spark, table):
    return _turns(spark)


ROUTES = {"emergency": ("emergency", "emergency", "emergency"), "self_harm": ("emergency", "emergency", "self_harm"), "child": ("medium", "out_of_scope", "out_of_scope"), "psych": ("medium", "out_of_scope", "out_of_scope")}


@example(rows_sql("id, risk_level, handled_as, template", [(x[0], *ROUTES.get(x[3], (None, None, None))) for x in TURNS]))
def prescan_route(spark, table):
    return _turns(spark).select("id", R.route(F.col("kind")).alias("r")).select("id", "r.risk_level", "r.handled_as", "r.template")


SYMPTOMS = [(1, "胸口压榨性疼；大汗", "chest_pain"), (2, "小腿肿胀疼痛", "leg_swelling"), (3, "打喷嚏；鼻塞", ""), (4, "高烧三天，咳嗽一个月", "fever_duration|cough_long")]


@example(rows_sql("id, rules", [(i, r) for i, _, r in SYMPTOMS]))
def rule_scan(spark, table):
    hits = R.rule_hits(F.col("text"))
    return _frame(spark, "id long, text string", [x[:2] for x in SYMPTOMS]).select("id", F.array_join(F.transform(hits, lambda h: h["rule_id"]), "|").alias("rules"))


@example(rows_sql("level, n_texts, rules", [("emergency", 1, "chest_pain"), ("high", 2, "cough_long|fever_duration|leg_swelling")]))
def red_flag_report(spark, table):
    hits = _frame(spark, "id long, text string", [x[:2] for x in SYMPTOMS]).select("id", F.explode(R.rule_hits(F.col("text"))).alias("h"))
    return hits.groupBy("h.level").agg(F.count_distinct("id").alias("n_texts"), F.array_join(F.array_sort(F.collect_set("h.rule_id")), "|").alias("rules"))


GUARDED = [(1, "您得了肺癌", "您得了"), (2, "您说您得了肺癌", None), (3, "不能确诊为肺炎", None), (4, "已确诊为肺炎", "确诊为")]


@example(rows_sql("id, matched", [(i, m) for i, _, m in GUARDED]))
def guarded_match(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in GUARDED]).select("id", R.guarded(F.col("text"), R.DIAGNOSIS).alias("matched"))


@example(rows_sql("id, text", [(1, "暂时没有发现需要紧急处理的信号（但无法完全排除其他可能）。"), (2, "配合规范治疗有机会好转"), (3, "照常")]))
def absolutist_rewrite(spark, table):
    return _frame(spark, "id long, text string", [(1, "肯定没事。"), (2, "一定能治好"), (3, "照常")]).select("id", R.soften(F.col("text")).alias("text"))


# id, reply, hypotheses, confidence, bad refs, retrieved, red flags, risk, next steps, closing; codes; action
REPLIES = [
    (1, "您得了肺癌", ["肺癌"], "low", [], ["c"], [], "low", [], False, "diagnosis_language", "replace"),
    (2, "您说您得了肺癌", ["肺癌"], "low", [], ["c"], [], "low", [], False, "", "pass"),
    (3, "建议您吃布洛芬", ["x"], "low", [], ["c"], [], "low", [], False, "medication_recommendation", "replace"),
    (4, "请不要自行服用布洛芬", ["x"], "low", [], ["c"], [], "low", [], False, "", "pass"),
    (5, "您肯定没事", ["x"], "low", [], ["c"], [], "low", [], False, "absolutist_claim", "degrade"),
    (6, "好的", ["x"], "low", ["chunk-999"], ["chunk-001"], [], "low", [], False, "fabricated_citation", "degrade"),
    (7, "根据相关研究", ["x"], "low", [], [], [], "low", [], False, "unsupported_reference", "degrade"),
    (8, "多喝水", ["x"], "low", [], ["c"], ["胸痛"], "low", ["休息"], False, "red_flag_escalation", "degrade"),
    (9, "好的", ["x"], "high", [], ["c"], [], "low", ["就医"], True, "closing_confidence_cap", "degrade"),
    (10, "好的", ["x"], "medium", [], ["c"], [], "low", ["休息"], False, "closing_advice_missing", "degrade"),
    (11, "自杀的念头", ["x"], "low", [], ["c"], [], "low", [], False, "self_harm_echo", "degrade"),
    (12, " ", ["x"], "low", [], ["c"], [], "low", [], False, "empty_reply", "replace"),
    (13, "好的", [], "medium", [], ["c"], [], "low", ["就医"], False, "empty_hypotheses", "degrade"),
]


def _reviewed(spark):
    schema = "id long, reply string, hyps array<string>, confidence string, bad array<string>, retrieved array<string>, flags array<string>, risk string, steps array<string>, closing boolean"
    return _frame(spark, schema, [x[:10] for x in REPLIES]).withColumn("codes", R.violations(*(F.col(c) for c in ("reply", "hyps", "confidence", "bad", "retrieved", "flags", "risk", "steps", "closing"))))


@example(rows_sql("id, codes", [(x[0], x[10]) for x in REPLIES]))
def review_violations(spark, table):
    return _reviewed(spark).select("id", F.array_join("codes", "|").alias("codes"))


@example(rows_sql("id, action", [(x[0], x[11]) for x in REPLIES]))
def review_actions(spark, table):
    return _reviewed(spark).select("id", R.action(F.col("codes")).alias("action"))


OUTPUTS = [(1, "ok", "low", "medium", ["就医"], ""), (2, None, "critical", "very_high", [], "reply|risk_level|confidence|next_steps"), (3, "ok", "emergency", "high", [], "next_steps")]


@example(rows_sql("id, errors", [(x[0], x[5]) for x in OUTPUTS]))
def schema_validate(spark, table):
    rows = _frame(spark, "id long, reply string, risk string, confidence string, steps array<string>", [x[:5] for x in OUTPUTS])
    return rows.select("id", F.array_join(J.output_errors(F.col("reply"), F.col("risk"), F.col("confidence"), F.col("steps")), "|").alias("errors"))


# ------------------------------------------------------------------ chunking

BOOKS = [
    (1, "# 心血管内科\n## 高血压\n【高血压】限盐\n## 冠心病\n【冠心病】阿司匹林"),
    (2, "前言\n# 总论\n内容一\n### 细则\n内容二\n## 诊断\n内容三"),
    (3, "# 只有标题"),
]


def _books(spark):
    return K.lines_of(_frame(spark, "doc long, text string", BOOKS), "doc", "text")


@example(rows_sql("doc, section, path, body", [(1, 2, "心血管内科 / 高血压", "【高血压】限盐"), (1, 3, "心血管内科 / 冠心病", "【冠心病】阿司匹林"), (2, 0, "", "前言"), (2, 1, "总论", "内容一"), (2, 2, "总论 / 细则", "内容二"), (2, 3, "总论 / 诊断", "内容三")]))
def heading_path(spark, table):
    return K.heading_sections(_books(spark), "doc")


ENTRIES = [(1, "【高血压】限盐\n多运动\n【冠心病】随访"), (2, "概述\n【概述】总")]


@example(rows_sql("doc, block, entry, body", [(1, 1, "高血压", "【高血压】限盐\n多运动"), (1, 2, "冠心病", "【冠心病】随访"), (2, 0, "", "概述"), (2, 1, "概述", "【概述】总")]))
def entry_blocks(spark, table):
    return K.entry_blocks(K.lines_of(_frame(spark, "doc long, text string", ENTRIES), "doc", "text"), "doc")


@example(rows_sql("path, entry, body", [("心血管内科 / 高血压", "高血压", "【高血压】限盐"), ("心血管内科 / 冠心病", "冠心病", "【冠心病】阿司匹林"), ("", "", "前言"), ("总论", "", "内容一"), ("总论 / 细则", "", "内容二"), ("总论 / 诊断", "", "内容三")]))
def chunk_structured(spark, table):
    """Headings first, then entries within each section."""
    sections = K.heading_sections(_books(spark), "doc")
    within = K.entry_blocks(K.lines_of(sections.withColumn("key", F.concat_ws(":", "doc", "section")), "key", "body"), "key")
    return sections.withColumn("key", F.concat_ws(":", "doc", "section")).select("key", "path").join(within, "key").select("path", "entry", "body")


@example(rows_sql("head, n", [("一", 210), ("二", 214)]))
def section_merge(spark, table):
    """Short sections are folded into the one before."""
    rows = _frame(spark, "s array<struct<head:string,body:string>>", [([("一", "x" * 210), ("二", "y" * 100), ("三", "z" * 107), ("空", "")],)])
    return rows.select(F.explode(C.merge_sections(F.col("s"))).alias("m")).select("m.head", F.length("m.body").cast("long").alias("n"))


@example(rows_sql("doc, block, line", [(1, 1, "第一章 总则这是一句被换行打断的话。"), (1, 2, "下一句。")]))
def line_rejoin(spark, table):
    """A line goes on with the one before it unless that ends a sentence, be it a heading."""
    lines = K.lines_of(_frame(spark, "doc long, text string", [(1, "第一章 总则\n这是一句被\n- 12 -\n换行打断的话。\n\n下一句。")]), "doc", "text")
    return C.rejoin_lines(lines, "doc", "pos", "line")


@example(rows_sql("doc, name, body", [(1, "refuse", "抱歉\n请就医"), (1, "emergency", "拨打 120")]))
def template_sections(spark, table):
    return K.template_sections(K.lines_of(_frame(spark, "doc long, text string", [(1, "说明\n## refuse\n抱歉\n请就医\n\n## emergency\n拨打 120")]), "doc", "text"), "doc")


HEADS = [(1, "第一章 总则", "第一章"), (2, "一、目的", "一、"), (3, "（二）范围", "（二）"), (4, "普通一行", None), (5, "第三条 定义", "第三条")]


@example(rows_sql("id, marker, level", [(1, "第一章", 2), (2, "一、", 2), (3, "（二）", 4), (4, None, None), (5, "第三条", 3)]))
def clause_heading(spark, table):
    return _frame(spark, "id long, line string", [x[:2] for x in HEADS]).select("id", C.clause_heading(F.col("line")).alias("h")).select("id", "h.marker", "h.level")


TITLED = [(1, "附件1：关于加强管理的通知\n正文", "关于加强管理的通知"), (2, "12\n目录\n全国高血压防治管理办法\n正文", "全国高血压防治管理办法"), (3, "abc", "默认")]


@example(rows_sql("id, title", [(i, t) for i, _, t in TITLED]))
def derive_title(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in TITLED]).select("id", C.derive_title(F.col("text")).alias("title"))


LICENCES = [
    (1, "", "CC BY（Europe PMC 仅取开放获取）"),
    (2, "https://creativecommons.org/licenses/by-nc/4.0/", "CC BY-NC（不可商用）"),
    (3, "Creative Commons Attribution 4.0 International", "CC BY 4.0"),
    (4, "CC BY-SA 3.0", "CC BY-SA"),
    (5, "cc-by", "CC BY"),
    (6, "All rights reserved", "All rights reserved"),
]


@example(rows_sql("id, license", [(i, x) for i, _, x in LICENCES]))
def normalize_license(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in LICENCES]).select("id", C.normalize_license(F.col("text")).alias("license"))


# ------------------------------------------------------------------ model outputs

TEXTS = [(1, '{"a": {"b": [1, 2', '{"a": {"b": [1, 2]}}'), (2, '{"a": 1}}', '{"a": 1}'), (3, '{"a": 1} 以上。', '{"a": 1}'), (4, "没有 JSON", None), (5, '{{"a": 1}}', '{"a": 1}'), (6, '{"a": "x", "b":', '{"a": "x"}'), (7, '{"a": "未完', '{"a": "未完"}')]


@example(rows_sql("id, json", [(i, j) for i, _, j in TEXTS]))
def json_tolerant(spark, table):
    return _frame(spark, "id long, text string", [x[:2] for x in TEXTS]).select("id", J.json_column(F.col("text")).alias("json"))


@example(rows_sql("id, nth, json", [(1, 0, '{"a": 1}'), (1, 1, '{"b": "}"}')]))
def json_objects(spark, table):
    rows = _frame(spark, "id long, text string", [(1, '先 {"a": 1} 后 {"b": "}"} 完'), (2, "无")])
    return rows.select("id", F.posexplode(J.objects_column(F.col("text"))).alias("nth", "json")).select("id", F.col("nth").cast("long").alias("nth"), "json")


CALLS = [
    (1, 'TOOL: check_red_flags\nARGS: {"symptoms": ["胸痛"]}}', "check_red_flags", '{"symptoms": ["胸痛"]}'),
    (2, '```json\n{"tool_call": {"name": "retrieve_evidence", "arguments": {"query": "肺炎"}}}\n```', "retrieve_evidence", '{"query": "肺炎"}'),
    (3, 'TOOL: rm\nARGS: {"x": 1}', None, None),
    (4, "你好", None, None),
]


@example(rows_sql("id, name, arguments", [(x[0], x[2], x[3]) for x in CALLS]))
def parse_tool_call(spark, table):
    rows = _frame(spark, "id long, text string", [x[:2] for x in CALLS])
    return rows.select("id", J.tool_column(F.col("text"), ("check_red_flags", "retrieve_evidence")).alias("t")).select("id", "t.name", "t.arguments")


DRAFTS = [
    (1, '{"reply": "好", "risk_level": "急诊", "assessment": {"hypotheses": ["上呼吸道感染", {"likelihood": "high"}, 123, null], "confidence": "中等", "missing_info": ["未提供", "体温"], "next_steps": ["就医"]}}', "", "好", "emergency", "medium", 1, 1, 1),
    (2, "{}", "草稿", "草稿", "medium", "low", 0, 0, 1),
]


@example(rows_sql("id, reply, risk_level, confidence, n_hypotheses, n_missing, n_steps", [(x[0], *x[3:]) for x in DRAFTS]))
def normalize_output(spark, table):
    schema = "reply string, risk_level string, confidence string, hypotheses array<struct<name:string,likelihood:string>>, missing_info array<string>, next_steps array<string>"
    rows = _frame(spark, "id long, text string, draft string", [x[:3] for x in DRAFTS]).select("id", F.from_json(J.output_column(F.col("text"), F.col("draft")), schema).alias("o"))
    size = lambda c: F.size(f"o.{c}").cast("long")
    return rows.select("id", "o.reply", "o.risk_level", "o.confidence", size("hypotheses").alias("n_hypotheses"), size("missing_info").alias("n_missing"), size("next_steps").alias("n_steps"))


@example(rows_sql("value, likelihood, risk, source", [("中等", "medium", "medium", "dialogue"), ("知识库", "low", "low", "kb"), ("急诊", "low", "emergency", "dialogue"), ("high", "high", "high", "dialogue")]))
def enum_normalize(spark, table):
    v = F.col("value")
    rows = _frame(spark, "value string", [("中等",), ("知识库",), ("急诊",), ("high",)])
    return rows.select("value", J.enum(v, J.LIKELIHOODS, "low").alias("likelihood"), J.enum(v, J.RISKS, "low").alias("risk"), J.enum(v, J.SOURCES, "dialogue").alias("source"))


END = 45982
BLOCK = list(range(100, 124))
STREAMS = [
    (1, list(range(1000)), 1536, None),
    (2, list(range(1536)), 1536, "think_cap"),
    (3, [1, END, *range(600)], 600, None),
    (4, [*range(10), *BLOCK, *BLOCK, *BLOCK], None, "repeat"),
    (5, [*BLOCK, *range(500, 530), *BLOCK, *range(600, 630), *BLOCK], None, "repeat"),
    (6, [*BLOCK, *range(500, 600), *BLOCK], None, None),
    (7, [END, *BLOCK, *BLOCK, *BLOCK], None, None),
    (8, [1, 2, 3], None, None),
]


@example(rows_sql("id, reason", [(x[0], x[3]) for x in STREAMS]))
def stop_reason(spark, table):
    return _frame(spark, "id long, tokens array<int>, budget int", [x[:3] for x in STREAMS]).select("id", J.stop_reason(F.col("tokens"), END, F.col("budget")).alias("reason"))


@example(rows_sql("id, thinking, content", [(1, "想", "答"), (2, "", "只有答")]))
def split_thinking(spark, table):
    rows = _frame(spark, "id long, text string", [(1, f"{J.THINK_START}想{J.THINK_END}\n答{J.TEXT_END}尾"), (2, f"只有答{J.TEXT_END}")])
    return rows.select("id", J.split_thinking(F.col("text")).alias("s")).select("id", "s.thinking", "s.content")


@example(rows_sql("conv, rounds", [(1, 3), (2, 0)]))
def tool_rounds(spark, table):
    rows = _frame(spark, "conv long, tool_calls array<string>", [(1, ["a", "b"]), (1, ["c"]), (1, None), (2, None)])
    return rows.groupBy("conv").agg(F.sum(F.size(F.coalesce("tool_calls", F.array().cast("array<string>")))).alias("rounds"))


@example(rows_sql("id, business, structured", [(1, "check_red_flags|retrieve_evidence", "AgentTurnOutput")]))
def tools_split(spark, table):
    rows = _frame(spark, "id long, tools array<string>", [(1, ["check_red_flags", "AgentTurnOutput", "retrieve_evidence"])])
    structured = lambda x: x == "AgentTurnOutput"
    return rows.select("id", F.array_join(F.filter("tools", lambda x: ~structured(x)), "|").alias("business"), F.array_join(F.filter("tools", structured), "|").alias("structured"))


@example(rows_sql("name, likelihood", [("肺炎", "high"), ("哮喘", "low")]))
def hypothesis_lookup(spark, table):
    """A card's hypotheses with the assessment's levels, by name."""
    rows = _frame(spark, "card array<string>, known map<string,string>", [(["肺炎", "哮喘"], {"肺炎": "high"})])
    return rows.select(F.explode("card").alias("name"), "known").select("name", F.coalesce(F.try_element_at("known", F.col("name")), F.lit("low")).alias("likelihood"))


@example(rows_sql("id, names", [(1, "b|a|c")]))
def ordered_distinct(spark, table):
    return _frame(spark, "id long, x array<string>", [(1, ["b", "a", "b", "c", "a"])]).select("id", F.array_join(F.array_distinct("x"), "|").alias("names"))


@example(rows_sql("latest", [("health_topics_2026-09-10.xml",)]))
def latest_by_pattern(spark, table):
    rows = _frame(spark, "name string", [("health_topics_2025-01-02.xml",), ("health_topics_2026-09-10.xml",), ("other.xml",)])
    return rows.where(F.col("name").rlike(r"_[0-9]{4}-[0-9]{2}-[0-9]{2}\.xml$")).agg(F.max("name").alias("latest"))


@example(rows_sql("id, prompt", [(1, "题目：X\n选项：\nA. 甲\nB. 乙\n资料：\n[1] 证据"), (2, "题目：Y")]))
def build_prompt(spark, table):
    rows = _frame(spark, "id long, question string, options map<string,string>, evidence array<string>", [(1, "X", {"B": "乙", "A": "甲"}, ["证据"]), (2, "Y", {}, [])])
    letters = F.array_sort(F.map_keys("options"))
    options = F.array_join(F.transform(letters, lambda k: F.concat(k, F.lit(". "), F.element_at("options", k))), "\n")
    evidence = F.array_join(F.transform("evidence", lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e)), "\n")
    parts = [F.concat(F.lit("题目："), "question"), F.when(F.size("options") > 0, F.concat(F.lit("选项：\n"), options)), F.when(F.size("evidence") > 0, F.concat(F.lit("资料：\n"), evidence))]
    return rows.select("id", F.concat_ws("\n", *parts).alias("prompt"))


@example(rows_sql("id, n, points", [(1, 4007, "1;2;3;4;5;6;7;8")]))
def judge_prompt(spark, table):
    rows = _frame(spark, "id long, answer string, points array<string>", [(1, "x" * 9000, [str(i) for i in range(1, 12)])])
    return rows.select("id", F.length(F.concat(F.lit("answer:"), F.substring("answer", 1, 4000))).cast("long").alias("n"), F.array_join(F.slice("points", 1, 8), ";").alias("points"))


@example(rows_sql("name, run_id", [("smoke", "20260914T080000-smoke-" + __import__("hashlib").sha1(b'{"k": 5, "layer": "L3"}').hexdigest()[:8])]))
def run_id(spark, table):
    rows = _frame(spark, "name string, at timestamp, config string", [("smoke", __import__("datetime").datetime(2026, 9, 14, 8), '{"k": 5, "layer": "L3"}')])
    return rows.select("name", F.concat_ws("-", F.date_format("at", "yyyyMMdd'T'HHmmss"), "name", F.substring(F.sha1("config"), 1, 8)).alias("run_id"))


REGISTRY = [("a.md", "d1"), ("b.md", "d1"), ("", "d2"), ("a.md", "d3"), ("c.md", "")]


@example(rows_sql("error, value, n", [("duplicate doc_id", "d1", 2), ("duplicate file", "a.md", 2), ("blank field", "", 2)]))
def registry_validate(spark, table):
    from quillon.sources.files import registry_errors

    return registry_errors(_frame(spark, "file string, doc_id string", REGISTRY))


@example(rows_sql("n_good, n_bad", [(2, 1)]))
def jsonl_lenient(spark, table):
    """Bad lines are skipped; blank lines and comments are none."""
    from quillon.sources.files import json_lines

    rows = json_lines(_frame(spark, "value string", [('{"id": 1}',), ("",), ("# note",), ("{bad",), ('{"id": 2}',)]), "id long")
    return rows.agg(F.count("record").alias("n_good"), F.count(F.when(F.col("record").isNull(), 1)).alias("n_bad"))


@example(rows_sql("id, line", [(1, 1), (2, 4)]))
def jsonl_strict(spark, table):
    """A bad line would raise; these are all good."""
    from quillon.sources.files import strict

    rows = _frame(spark, "value string, line long", [('{"id": 1}', 1), ("", 2), ("# note", 3), ('{"id": 2}', 4)])
    return strict(rows, "id long").select("record.id", "line")
