"""Parsers, tools, rules and chunking over whole tables.

The tables hold no questions, answers or symptoms, so what an operator looks
for is added to each row's text by its id, alike in both engines; the whole
text of the row stays around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import text as T
from quillon.operators import bridge as J
from quillon.operators import chunking as K
from quillon.operators import evaluation as E
from quillon.operators import rules as R
from quillon.operators import tools as L
from quillon.operators.scoring import score_items as score
from quillon.plans.registry import query

_QUOTED_PUNCTUATION = T.PUNCTUATION.replace("'", "''")


def by_case(n: Column, *options: Column | str) -> Column:
    """The option of that number; the last one for all others."""
    options = [F.lit(x) if isinstance(x, str) else x for x in options]
    out = F.when(n == 0, options[0])
    for i, x in enumerate(options[1:-1], 1):
        out = out.when(n == i, x)
    return out.otherwise(options[-1])


def sql_case(n: str, *options: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options[:-1]))
    return f"CASE {n} {whens} ELSE {options[-1]} END"


def quoted(*texts: str | None) -> list[str]:
    return ["NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts]


def _last(pattern: str, of: str = "t", group: int = 1) -> str:
    return f"regexp_extract_all({of}, '{pattern}', {group})[-1]"


# ------------------------------------------------------------------ tokens and similarity


@query(f"SELECT doc_id, md5(p) AS digest, CAST(length(p) AS BIGINT) AS n_chars FROM (SELECT doc_id, translate(lower(coalesce(text, '')), '{_QUOTED_PUNCTUATION}', '') AS p FROM documents)")
def normalize_text(spark, table):
    plain = T.normalize("text")
    return table("documents").select("doc_id", F.md5(plain).alias("digest"), F.length(plain).cast("long").alias("n_chars"))


def _neighbours(table) -> DataFrame:
    """Each benchmark item with the next; every fourth is compared with a text that holds it."""
    items = table("benchmark")
    after = items.select((F.col("item_id") - 1).alias("at"), F.col("text").alias("b"))
    pairs = items.join(after, F.col("item_id") == F.col("at")).select("item_id", F.col("text").alias("a"), "b")
    return pairs.withColumn("b", F.when(F.col("item_id") % 4 == 0, F.concat("b", F.lit(" "), F.replace("a", F.lit(" "), F.lit(", ")))).otherwise(F.col("b")))


PAIRS_SQL = f"""WITH pairs AS (
  SELECT i.item_id, translate(lower(i.text), '{_QUOTED_PUNCTUATION}', '') AS a,
         translate(lower(CASE WHEN i.item_id % 4 = 0 THEN n.text || ' ' || replace(i.text, ' ', ', ') ELSE n.text END), '{_QUOTED_PUNCTUATION}', '') AS b
  FROM benchmark i JOIN benchmark n ON n.item_id = i.item_id + 1),
grams AS (
  SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS y FROM pairs),
runs AS (
  SELECT item_id, max(l) AS n FROM (SELECT item_id, a, b, i, unnest(range(1, length(a) - i + 2)) AS l FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM pairs))
  WHERE contains(b, substr(a, i, l)) GROUP BY item_id),
told AS (
  SELECT item_id, 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) AS dice, coalesce(n, 0) AS n, a, b FROM grams LEFT JOIN runs USING (item_id)),
likened AS (SELECT *, CASE WHEN contains(b, a) THEN 1.0 WHEN dice >= 0.75 THEN dice ELSE greatest(dice, n::DOUBLE / length(a)) END AS similarity FROM told)
"""


@query(PAIRS_SQL + "SELECT item_id, round(dice, 6) AS dice FROM likened")
def bigram_dice(spark, table):
    return _neighbours(table).select("item_id", F.round(T.bigram_dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query(PAIRS_SQL + "SELECT item_id, CAST(n AS BIGINT) AS n FROM likened")
def lcs_length(spark, table):
    return _neighbours(table).select("item_id", T.longest_common_substring(T.normalize("a"), T.normalize("b")).cast("long").alias("n"))


@query(PAIRS_SQL + "SELECT item_id, round(similarity, 6) AS similarity FROM likened")
def similarity(spark, table):
    return _neighbours(table).select("item_id", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(PAIRS_SQL + "SELECT item_id, similarity >= 0.5 AS found FROM likened")
def fuzzy_contains(spark, table):
    return _neighbours(table).select("item_id", T.fuzzy_contains(F.col("a"), F.col("b")).alias("found"))


# ------------------------------------------------------------------ answers

ANSWERED = f"""SELECT doc_id, coalesce(text, '') || {sql_case('doc_id % 3', "' 答案：' || chr(CAST(65 + doc_id % 10 AS INTEGER))", "' 答案: (' || chr(CAST(97 + doc_id % 10 AS INTEGER)) || ')'", "''")} AS t FROM documents"""
CHOICE = (
    "upper(coalesce(" + _last("(?i)答案\\s*[:：]?\\s*[（(]?\\s*([A-J])\\s*[)）]?") + ", "
    + _last("(?:^|[^A-Za-z])([A-J])(?:$|[^A-Za-z])", "regexp_replace(CASE WHEN length(t) > 300 THEN right(t, 300) ELSE t END, '([^A-Za-z])', '\\1\\1', 'g')") + "))"
)


def _answered(table) -> DataFrame:
    letter = lambda base: F.char((F.lit(base) + F.col("doc_id") % 10).cast("int"))
    mark = by_case(F.col("doc_id") % 3, F.concat(F.lit(" 答案："), letter(65)), F.concat(F.lit(" 答案: ("), letter(97), F.lit(")")), "")
    return table("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), mark).alias("t"))


@query(f"SELECT doc_id, {CHOICE} AS choice FROM ({ANSWERED})")
def parse_mcq(spark, table):
    return _answered(table).select("doc_id", T.parse_choice(F.col("t")).alias("choice"))


NUMBER = "(-?[0-9]+(?:\\.[0-9]+)?)"
NUMBERED = f"""SELECT doc_id, coalesce(text, '') || {sql_case('doc_id % 4', "' 答案：' || doc_id || '.5'", "' x = -' || doc_id || chr(10) || 'end'", "''")} AS t FROM documents"""


def _numbered(table) -> DataFrame:
    mark = by_case(F.col("doc_id") % 4, F.concat(F.lit(" 答案："), F.col("doc_id").cast("string"), F.lit(".5")), F.concat(F.lit(" x = -"), F.col("doc_id").cast("string"), F.lit("\nend")), "")
    return table("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), mark).alias("t"))


@query(f"SELECT doc_id, TRY_CAST(coalesce({_last('答案\\s*[:：]?\\s*' + NUMBER)}, {_last('[≈=]\\s*' + NUMBER)}, {_last(NUMBER)}) AS DOUBLE) AS value FROM ({NUMBERED})")
def extract_number(spark, table):
    return _numbered(table).select("doc_id", T.extract_number(F.col("t")).alias("value"))


@query(
    """SELECT l_returnflag, same, count(*) AS n FROM (SELECT l_returnflag, coalesce(abs(got - want) <= 0.01 OR (want <> 0 AND abs(got - want) <= 0.01 * abs(want)), false) AS same
FROM (SELECT l_returnflag, l_extendedprice AS got, floor(l_extendedprice / 500) * 500 AS want FROM lineitem)) GROUP BY ALL"""
)
def numbers_match(spark, table):
    want = (F.floor(F.col("l_extendedprice") / 500) * 500).cast("double")
    return table("lineitem").select("l_returnflag", T.numbers_match(F.col("l_extendedprice"), want).alias("same")).groupBy("l_returnflag", "same").agg(F.count("*").alias("n"))


@query("SELECT item_id, 'A=' || w[1] || ';B=' || w[2] || ' ' || w[3] AS options FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS w FROM benchmark) WHERE len(w) >= 3")
def inline_options(spark, table):
    w = table("benchmark").select("item_id", "text", F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)).alias("w")).where(F.size("w") >= 3)
    asked = F.concat("text", F.lit("\nA. "), F.col("w")[0], F.lit("  B. "), F.col("w")[1], F.lit(" "), F.col("w")[2], F.lit("\n"))
    entries = F.map_entries(T.inline_options(asked))
    return w.select("item_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("options"))


@query("SELECT doc_id, nullif(regexp_extract(t, '答案\\s*(?:是|为|[:：])?\\s*([A-J])', 1), '') AS letter FROM (" + ANSWERED + ")")
def reference_letter(spark, table):
    return _answered(table).select("doc_id", T.reference_letter(F.col("t")).alias("letter"))


@query(
    """SELECT doc_id, substr(regexp_replace(regexp_extract(b, '^[^:：，,。；;（(]*'), '^\\s+|\\s+$', '', 'g'), 1, 30) AS phrase
FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[（(]?[0-9]+[）)]?|[①-⑩]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS b FROM documents)"""
)
def core_phrase(spark, table):
    return table("documents").select("doc_id", T.core_phrase(F.col("text")).alias("phrase"))


@query(
    """SELECT doc_id, CAST(len(p) AS BIGINT) AS n, md5(array_to_string(p, '|')) AS digest FROM (
SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\n；;]'), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 2), lambda x: regexp_replace(x, '^[ \\-·•\\t]+|[ \\-·•\\t]+$', '', 'g')) AS p FROM documents)"""
)
def split_key_points(spark, table):
    points = T.split_key_points(F.col("text"))
    return table("documents").select("doc_id", F.size(points).cast("long").alias("n"), F.md5(F.array_join(points, "|")).alias("digest"))


TASKS = ("mcq_single", "calculation", "evidence_qa")


def _scored(table) -> DataFrame:
    n = F.col("doc_id")
    verdict = by_case(n % 2, "是", "maybe")
    mark = by_case(n % 3, F.concat(F.lit(" 答案："), F.char((F.lit(65) + n % 4).cast("int"))), F.concat(F.lit(" 答案："), (n % 7).cast("string")), F.concat(F.lit(" 答案："), verdict, F.lit(" [摘要"), (n % 4).cast("string"), F.lit("]")))
    want = by_case(n % 3, F.char((F.lit(65) + n % 5).cast("int")), "", "yes")
    nothing = {"question": "string", "thinking": "string", "options": "map<string,string>", "key_points": "array<string>", "hypotheses": "array<struct<name:string,likelihood:string>>"}
    rows = table("documents").select(
        n.alias("id"), "source", by_case(n % 3, *TASKS).alias("task_type"), F.concat(F.coalesce("text", F.lit("")), mark).alias("output"), want.alias("answer"), (n % 5).cast("string").alias("reference_answer"),
        F.lit("[摘要1] a [摘要2] b").alias("context"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()),
    )
    return score(rows).join(rows.select("id", "source"), "id")


SCORED = f"""SELECT doc_id AS id, source, {sql_case('doc_id % 3', *quoted(*TASKS))} AS task_type,
{sql_case('doc_id % 3', '(doc_id % 4 = doc_id % 5)', 'abs(doc_id % 7 - doc_id % 5) <= 0.01', '(doc_id % 2 = 0)')} AS correct,
CASE WHEN doc_id % 3 = 2 THEN doc_id % 4 <= 2 END AS citation_traceable FROM documents"""


@query(f"SELECT id, task_type, correct::INT::DOUBLE AS score, correct, citation_traceable FROM ({SCORED})")
def score_items(spark, table):
    """Answers added to every document, one task in three."""
    return _scored(table).select("id", "task_type", "score", "correct", "citation_traceable")


@query(f"SELECT source, task_type, count(*) AS n, count(*) AS scored, count(*) FILTER (correct) AS correct FROM (SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN true ELSE correct END AS correct) FROM ({SCORED})) GROUP BY ALL")
def stage_score(spark, table):
    """Rule scores, overridden by a judge for every tenth document, summarised by source and task."""
    scores = _scored(table)
    judged = E.override(scores.select("id", "score", "correct"), scores.where("id % 10 = 0").select("id", F.lit(1.0).alias("score")))
    return E.summarize(judged.join(scores.select("id", "source", "task_type"), "id").withColumn("truncated", F.lit(False)), ["source", "task_type"]).select("source", "task_type", "n", "scored", "correct")


@query(f"SELECT doc_id, {sql_case('doc_id % 3', quoted('yes')[0], quoted('maybe')[0], 'NULL')} AS choice, doc_id % 3 <> 2 AND doc_id % 4 <= 2 AS traceable FROM documents")
def evidence_qa(spark, table):
    n = F.col("doc_id")
    mark = by_case(n % 3, F.concat(F.lit(" 答案：是 [摘要 "), (n % 4).cast("string"), F.lit("]")), F.concat(F.lit("答案 Maybe[摘要"), (n % 4).cast("string"), F.lit("]")), "")
    nothing = {"question": "string", "thinking": "string", "reference_answer": "string", "options": "map<string,string>", "key_points": "array<string>", "hypotheses": "array<struct<name:string,likelihood:string>>"}
    rows = table("documents").select(n.alias("id"), F.lit("evidence_qa").alias("task_type"), F.lit("[摘要1][摘要2]").alias("context"), F.lit("yes").alias("answer"), F.concat(F.coalesce("text", F.lit("")), mark).alias("output"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    return score(rows).select(F.col("id").alias("doc_id"), F.col("verdict").alias("choice"), F.col("citation_traceable").alias("traceable"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END), 4) AS locatable_rate FROM documents WHERE doc_id % 3 <> 0")
def traceability_rate(spark, table):
    """Answers by document, of those that have evidence: the share all of whose citations are found."""
    n = F.col("doc_id")
    rows = table("documents").select(F.concat(F.coalesce(F.translate("text", "[]", ""), F.lit("")), F.when(n % 4 == 0, " [1] kb::none::9").otherwise(" [1]")).alias("t"), F.when(n % 3 != 0, F.array(F.concat(F.lit("kb::d"), n.cast("string"), F.lit("::1")))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    rate = T.locatable_rate(T.extract_citations(F.col("t"), F.col("evidence")), F.col("evidence"))
    return rows.where(F.size("evidence") > 0).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(rate >= 1.0, F.lit(False)).cast("int")), 4).alias("locatable_rate"))


@query("SELECT conv_id, coalesce(string_agg('c' || turn, '|' ORDER BY turn) FILTER (turn % 2 = 1), '') AS bad FROM conversations GROUP BY conv_id")
def citation_fabricated(spark, table):
    """Each conversation cites all its turns, of which the even ones were retrieved."""
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.lit("c"), t.cast("string")))
    found = F.transform(F.collect_list(F.when(F.col("turn") % 2 == 0, F.col("turn"))), lambda t: F.concat(F.lit("c"), t.cast("string")))
    return table("conversations").groupBy("conv_id").agg(F.array_join(F.array_except(turns, found), "|").alias("bad"))


# ------------------------------------------------------------------ tools


@query(
    """SELECT c_custkey, CASE WHEN fits THEN round(b, 1) END AS bmi, CASE WHEN NOT fits THEN NULL WHEN b < 18.5 THEN '偏瘦' WHEN b < 24 THEN '正常' WHEN b < 28 THEN '超重' ELSE '肥胖' END AS class
FROM (SELECT *, kg / pow(cm / 100, 2) AS b, kg BETWEEN 2 AND 500 AND cm BETWEEN 100 AND 250 AS fits
FROM (SELECT c_custkey, (30 + c_custkey % 97)::DOUBLE AS kg, (90 + c_custkey % 110)::DOUBLE AS cm FROM customer))"""
)
def bmi_class(spark, table):
    kg, cm = (F.lit(30) + F.col("c_custkey") % 97).cast("double"), (F.lit(90) + F.col("c_custkey") % 110).cast("double")
    return table("customer").select("c_custkey", L.bmi(kg, cm).alias("b")).select("c_custkey", "b.bmi", "b.class")


UNITS = (("斤", "kg"), ("厘米", "英寸"), ("摄氏度", "°F"), ("f", "°C"), ("g", "ml"), ("mg", "ml"), (" KG ", "kg"), ("m", "厘米"))


@query(
    f"""SELECT event_id, round({sql_case('event_id % 8', 'value * 0.5', 'value * 0.01 / 0.0254', 'round(value * 9 / 5 + 32, 1)', 'round((value - 32) * 5 / 9, 1)', 'NULL', 'NULL', 'value', 'value * 100')}, 6) + 0.0 AS result,
{sql_case('event_id % 8', *quoted('ok', 'ok', 'ok', 'ok', 'refused', 'unsupported', 'same', 'ok'))} AS status FROM (SELECT event_id, floor(value) AS value FROM events)"""
)
def convert_units(spark, table):
    n = F.col("event_id") % 8
    told = table("events").select("event_id", L.convert(F.floor("value").cast("double"), by_case(n, *(a for a, _ in UNITS)), by_case(n, *(b for _, b in UNITS))).alias("c"))
    return told.select("event_id", (F.round("c.result", 6) + 0.0).alias("result"), "c.status")


TODAY = "2024-12-31"
TIMES = f"""SELECT event_id, user_id, {sql_case('event_id % 7', '(event_id % 50 + 1)::DOUBLE', '1.0::DOUBLE', f"date_diff('day', ts::DATE, DATE '{TODAY}')::DOUBLE", '(event_id % 9 + 1) * 7.0::DOUBLE', '(event_id % 30) * (1::DOUBLE / 24)', 'NULL', '2.0::DOUBLE')} AS days FROM events"""


def _times(table) -> DataFrame:
    n, number = F.col("event_id"), lambda m, plus=1: (F.col("event_id") % m + plus).cast("string")
    said = by_case(n % 7, F.concat(number(50), F.lit("天前开始发热")), "昨天咳嗽", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 就诊")), F.concat(number(9), F.lit(" 周 前")), F.concat(number(30, 0), F.lit("小时前")), "前段时间不舒服", "大前天")
    return table("events").select("event_id", "user_id", L.days_ago(said, F.lit(TODAY).cast("date")).alias("days"))


@query(f"SELECT event_id, round(days, 6) AS days FROM ({TIMES})")
def timeline_parse(spark, table):
    """Note that 大前天 holds 前天 and so counts two days."""
    return _times(table).select("event_id", F.round("days", 6).alias("days"))


@query(f"SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, event_id) AS rank, DATE '{TODAY}' - CAST(round_even(days, 0) AS INTEGER) AS on_date FROM ({TIMES}) WHERE days IS NOT NULL")
def timeline_sorted(spark, table):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("days"), "event_id"))
    return _times(table).where("days is not null").select("event_id", "user_id", rank.cast("long").alias("rank"), F.date_sub(F.lit(TODAY).cast("date"), F.bround("days").cast("int")).alias("on_date"))


@query(f"SELECT event_id, round(lag(days) OVER (PARTITION BY user_id ORDER BY days DESC, event_id) - days, 6) AS gap FROM ({TIMES}) WHERE days IS NOT NULL")
def timeline_gaps(spark, table):
    before = F.lag("days").over(Window.partitionBy("user_id").orderBy(F.desc("days"), "event_id"))
    return _times(table).where("days is not null").select("event_id", F.round(before - F.col("days"), 6).alias("gap"))


# ------------------------------------------------------------------ rules

TURNS = (
    ("胸口压榨性疼了20分钟，还一直出汗", "emergency", "chest_pain"),
    ("现在没有压榨感了", None, None),
    ("我觉得活着没意思", "self_harm", "self_harm:自伤念头表达"),
    ("我不再想死了", None, None),
    ("孩子发烧了", "child", "child:儿童症状"),
    ("我有抑郁症", "psych", "psych:精神心理专项"),
    ("最近有点鼻塞", None, None),
)
_NEGATED = "|".join(R.NEGATIONS)


def _stands(pattern: str) -> str:
    """In SQL: the pattern fits the text ``t``, and no negation touches its first match or the four characters before."""
    found = f"regexp_extract(t, '{pattern}', 0)"
    at = f"instr(t, {found})"
    return f"{found} <> '' AND NOT regexp_matches(substr(t, greatest(1, {at} - 4), length({found}) + least(4, {at} - 1)), '{_NEGATED}')"


def _flat(text: str, options: tuple[str, ...], gap: str) -> str:
    """In SQL: a text with an option by its length, without white space."""
    return f"regexp_replace(coalesce({text}, '') || '{gap}' || {sql_case(f'length(coalesce({text}, chr(0)))  % {len(options)}', *quoted(*options))}, '\\s+', '', 'g')"


def _said(options: tuple[str, ...], gap: str) -> Column:
    return F.concat(F.coalesce("text", F.lit("")), F.lit(gap), by_case(F.length(F.coalesce("text", F.lit("\0"))) % len(options), *options))


_WHENS = [(_stands(p), "self_harm", f"self_harm:{label}") for p, label in R.SELF_HARM]
_WHENS += [(_stands(p), "emergency", r.rule_id) for r in R.RED_FLAGS if r.level == "emergency" for p in r.patterns]
_WHENS += [(f"turn = 0 AND {_stands(p)}", kind, f"{kind}:{label}") for kind, label, p in R.FIRST_TURN]
HITS = f"""SELECT conv_id, turn, string_split(CASE {" ".join(f"WHEN {w} THEN '{kind}|{rule}'" for w, kind, rule in _WHENS)} END, '|') AS hit
  FROM (SELECT conv_id, turn, {_flat("text", tuple(t for t, *_ in TURNS), "。")} AS t FROM conversations)"""


def _turns(table) -> DataFrame:
    said = _said(tuple(t for t, *_ in TURNS), "。")
    return table("conversations").select("conv_id", "turn", R.prescan(said, F.col("turn") == 0).alias("hit")).select("conv_id", "turn", "hit.kind", "hit.rule_id")


@query(f"SELECT conv_id, turn, hit[1] AS kind, hit[2] AS rule_id FROM ({HITS})")
def prescan_first_hit(spark, table):
    """A sentence by its length after the text of every turn; some rules hold for the first turn alone."""
    return _turns(table)


@query(
    f"""SELECT conv_id, turn, CASE WHEN kind IN ('emergency', 'self_harm') THEN 'emergency' WHEN kind IS NOT NULL THEN 'medium' END AS risk_level,
CASE WHEN kind IN ('emergency', 'self_harm') THEN 'emergency' WHEN kind IS NOT NULL THEN 'out_of_scope' END AS handled_as,
CASE WHEN kind IN ('emergency', 'self_harm') THEN kind WHEN kind IS NOT NULL THEN 'out_of_scope' END AS template FROM (SELECT conv_id, turn, hit[1] AS kind FROM ({HITS}))"""
)
def prescan_route(spark, table):
    return _turns(table).select("conv_id", "turn", R.route(F.col("kind")).alias("r")).select("conv_id", "turn", "r.risk_level", "r.handled_as", "r.template")


SYMPTOMS = ("胸口压榨性疼；大汗", "小腿肿胀疼痛", "打喷嚏；鼻塞", "高烧三天，咳嗽一个月", "头疼 欲裂，嘴角 歪斜", "体重明显下降，便血")
RULES_SQL = f"""SELECT doc_id, list_filter([{", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(t, '{p}')" for p in r.patterns) + f" THEN '{r.level}:{r.rule_id}' END" for r in R.RED_FLAGS)}], lambda x: x IS NOT NULL) AS hits
  FROM (SELECT doc_id, {_flat("text", SYMPTOMS, " ")} AS t FROM documents)"""


def _symptoms(table) -> DataFrame:
    return table("documents").select("doc_id", R.rule_hits(_said(SYMPTOMS, " ")).alias("hits"))


@query(f"SELECT doc_id, array_to_string(list_transform(hits, lambda x: string_split(x, ':')[2]), '|') AS rules FROM ({RULES_SQL})")
def rule_scan(spark, table):
    return _symptoms(table).select("doc_id", F.array_join(F.transform("hits", lambda h: h["rule_id"]), "|").alias("rules"))


@query(
    f"""WITH h AS (SELECT doc_id, string_split(unnest(hits), ':') AS h FROM ({RULES_SQL}))
SELECT h[1] AS level, count(DISTINCT doc_id) AS n_texts, string_agg(DISTINCT h[2], '|' ORDER BY h[2]) AS rules FROM h GROUP BY h[1]"""
)
def red_flag_report(spark, table):
    hits = table("documents").select("doc_id", F.explode(R.rule_hits(_said(SYMPTOMS, " "))).alias("h"))  # of a column, Spark would ask for its size first and scan each text twice
    return hits.groupBy("h.level").agg(F.count_distinct("doc_id").alias("n_texts"), F.array_join(F.array_sort(F.collect_set("h.rule_id")), "|").alias("rules"))


GUARDED = (("您得了肺癌", "您得了"), ("您说您得了肺癌", None), ("不能确诊为肺炎", None), ("已确诊为肺炎", "确诊为"))


@query(f"SELECT doc_id, {sql_case('doc_id % 4', *quoted(*(m for _, m in GUARDED)))} AS matched FROM documents")
def guarded_match(spark, table):
    said = F.concat(F.coalesce("text", F.lit("")), F.lit("。"), by_case(F.col("doc_id") % 4, *(t for t, _ in GUARDED)))
    return table("documents").select("doc_id", R.guarded(said, R.DIAGNOSIS).alias("matched"))


def _replaced(sql: str) -> str:
    for old, new in R.REWRITES:
        sql = f"replace({sql}, '{old}', '{new}')"
    return sql


PROMISES = ("肯定没事。", "一定能治好", "绝对不会有事，百分之百", "照常")


@query("SELECT doc_id, md5(" + _replaced(f"coalesce(text, '') || {sql_case('doc_id % 4', *quoted(*PROMISES))}") + ") AS digest FROM documents")
def absolutist_rewrite(spark, table):
    return table("documents").select("doc_id", F.md5(R.soften(F.concat(F.coalesce("text", F.lit("")), by_case(F.col("doc_id") % 4, *PROMISES)))).alias("digest"))


# ------------------------------------------------------------------ chunking

LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(
    f"""SELECT doc_id, CAST(len(string_split(packs, chr(1))) AS BIGINT) AS n_packs, md5(packs) AS digest FROM (
SELECT doc_id, list_reduce({LINES}, lambda acc, p: CASE WHEN length(string_split(acc, chr(1))[-1]) + 2 + length(p) <= 500 THEN acc || chr(10) || chr(10) || p ELSE acc || chr(1) || p END) AS packs
FROM documents WHERE len({LINES}) > 0)"""
)
def paragraph_pack(spark, table):
    """Lines of all documents, packed greedily to 500 characters."""
    packs = table("documents").select("doc_id", K.pack_paragraphs(F.split("text", "\n"), 500, "\n\n").alias("p")).where(F.size("p") > 0)
    return packs.select("doc_id", F.size("p").cast("long").alias("n_packs"), F.md5(F.array_join("p", "\u0001")).alias("digest"))


@query(
    """SELECT doc_id, CAST(n AS BIGINT) AS n_pieces, md5(array_to_string(list_transform(range(n), lambda i: substr(text, i * 520 + 1, 600)), chr(1))) AS digest
FROM (SELECT doc_id, text, CAST(greatest(1, ceil((length(text) - 80) / 520.0)) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL)"""
)
def chunk_long_split(spark, table):
    """Windows of 600 with 80 shared, over all documents."""
    pieces = table("documents").where("text is not null").select("doc_id", K.long_split(F.col("text")).alias("p"))
    return pieces.select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.md5(F.array_join("p", "\u0001")).alias("digest"))


@query()
def chunk_recursive_split(spark, table):
    """Recursive splitting of all documents; a test compares the pieces with a plain restatement by offsets."""
    pieces = K.split_blocks(table("documents").select("doc_id", "text"), "doc_id", "text")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"])
    return pieces.groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.max(F.length("piece")).cast("long").alias("longest"), F.md5(F.array_join(in_order, "\u0001")).alias("digest"))


BARE = "regexp_replace(regexp_replace(coalesce(text, ''), '[#【】]', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def _marked(table, head: Column) -> DataFrame:
    return table("documents").select("doc_id", F.concat(head, F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[#【】]", "")).alias("t"))


@query(f"SELECT doc_id, CAST(3 AS BIGINT) AS section, coalesce(source, 'none') || ' / ' || coalesce(lang, 'none') AS path, md5({BARE}) AS digest FROM documents WHERE {BARE} <> ''")
def heading_path(spark, table):
    """Every document under a title by source and one by language, after a title that a higher one ends."""
    named = lambda c: F.coalesce(c, F.lit("none"))
    docs = _marked(table, F.concat(F.lit("## old\n# "), named("source"), F.lit("\n### "), named("lang")))
    return K.sections_of(docs, "doc_id", "t").select("doc_id", "section", "path", F.md5("body").alias("digest"))


@query(f"SELECT doc_id, CAST(b AS BIGINT) AS block, coalesce(source, 'none') AS entry, md5('【' || coalesce(source, 'none') || '】' || CASE b WHEN 1 THEN 'x' ELSE regexp_replace('y' || chr(10) || {BARE}, '\\s+$', '') END) AS digest FROM documents, (VALUES (1), (2)) v(b)")
def entry_blocks(spark, table):
    """Two entries before the text of every document, which belongs to the second."""
    mark = F.concat(F.lit("【"), F.coalesce("source", F.lit("none")), F.lit("】"))
    text = T.strip(F.regexp_replace(F.coalesce("text", F.lit("")), "[#【】]", ""))
    docs = table("documents").select("doc_id", F.concat(mark, F.lit("x\n"), mark, F.lit("y\n"), text).alias("t"))
    return K.entries_of(docs, "doc_id", "t").select("doc_id", "block", "entry", F.md5("body").alias("digest"))


# ------------------------------------------------------------------ model outputs


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS json FROM events")
def json_tolerant(spark, table):
    """Whole, followed by more, and cut before the last bracket."""
    props = F.col("props")
    said = by_case(F.col("event_id") % 4, props, F.concat(props, F.lit("} 以上。")), F.expr("substr(props, 1, length(props) - 1)"), F.concat(F.lit("没有 "), props))
    return table("events").select("event_id", J.json_column(said).alias("json"))


@query("SELECT event_id, CAST(nth AS BIGINT) AS nth, CASE WHEN nth = 0 THEN props ELSE '{\"b\": \"}\"}' END AS json FROM events, (VALUES (0), (1)) v(nth)")
def json_objects(spark, table):
    said = F.concat(F.lit("先 "), "props", F.lit(' 后 {"b": "}"} 完'))
    return table("events").select("event_id", F.posexplode(J.objects_column(said)).alias("nth", "json")).select("event_id", F.col("nth").cast("long").alias("nth"), "json")


@query(f"SELECT event_id, {sql_case('event_id % 4', *quoted('check_red_flags', 'retrieve_evidence', None, None))} AS name, CASE WHEN event_id % 4 < 2 THEN props END AS arguments FROM events")
def parse_tool_call(spark, table):
    said = by_case(
        F.col("event_id") % 4,
        F.concat(F.lit("TOOL: check_red_flags\nARGS: "), "props", F.lit("}")),
        F.concat(F.lit('```json\n{"tool_call": {"name": "retrieve_evidence", "arguments": '), "props", F.lit("}}\n```")),
        F.concat(F.lit("TOOL: rm\nARGS: "), "props"),
        "你好",
    )
    return table("events").select("event_id", J.tool_column(said, ("check_red_flags", "retrieve_evidence")).alias("t")).select("event_id", "t.name", "t.arguments")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS likelihood FROM events")
def enum_normalize(spark, table):
    name = F.when(F.col("event_type") == "error", "高").when(F.col("event_type") == "click", "中等").otherwise(F.col("event_type"))
    return table("events").select("event_id", J.enum(name, J.LIKELIHOODS, "low").alias("likelihood"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END AS thinking, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def split_thinking(spark, table):
    thought = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(J.THINK_START), F.coalesce("lang", F.lit("")), F.lit(J.THINK_END + "\n"))).otherwise("")
    said = F.concat(thought, F.coalesce("text", F.lit("")), F.lit(J.TEXT_END))
    told = table("documents").select("doc_id", J.split_thinking(said).alias("s"))
    return told.select("doc_id", "s.thinking", F.md5(T.strip(F.col("s.content"))).alias("digest"))


@query("SELECT conv_id, string_agg(role, '|' ORDER BY first) AS names FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_distinct(spark, table):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role)
    return table("conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(roles), "|").alias("names"))


@query("SELECT event_type, max(event_type || '_' || strftime(ts, '%Y-%m-%d') || '.xml') FILTER (event_id % 3 <> 0) AS latest FROM events GROUP BY event_type")
def latest_by_pattern(spark, table):
    name = F.when(F.col("event_id") % 3 == 0, "zz_other.xml").otherwise(F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".xml")))
    dated = table("events").select("event_type", name.alias("name")).where(F.col("name").rlike(r"_[0-9]{4}-[0-9]{2}-[0-9]{2}\.xml$"))
    return dated.groupBy("event_type").agg(F.max("name").alias("latest"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') || '-' || event_type || '-' || substr(sha1(props), 1, 8) AS run_id FROM events")
def run_id(spark, table):
    return table("events").select("event_id", F.concat_ws("-", F.date_format("ts", "yyyyMMdd'T'HHmmss"), "event_type", F.substring(F.sha1("props"), 1, 8)).alias("run_id"))


@query("SELECT count(*) FILTER (event_id % 5 > 2) AS n_good, count(*) FILTER (event_id % 5 = 2) AS n_bad FROM events")
def jsonl_lenient(spark, table):
    """Bad lines are skipped; blank lines and comments are none."""
    from quillon.sources.files import json_lines

    line = by_case(F.col("event_id") % 5, "", F.concat(F.lit("# "), "props"), F.expr("substr(props, 1, length(props) - 1)"), F.col("props"))
    return json_lines(table("events").select(line.alias("value")), "k long").agg(F.count("record").alias("n_good"), F.count(F.when(F.col("record").isNull(), 1)).alias("n_bad"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS line FROM events WHERE event_id % 3 = 2")
def jsonl_strict(spark, table):
    """A bad line would raise; these are all good."""
    from quillon.sources.files import strict

    line = by_case(F.col("event_id") % 3, "", "# note", F.col("props"))
    return strict(table("events").select(line.alias("value"), F.col("event_id").alias("line")), "k long").select("record.k", "line")


@query(
    """WITH r AS (SELECT coalesce(md5(text), '') AS file, CASE WHEN doc_id % 50 = 0 THEN '' ELSE coalesce(source, '') END AS doc_id FROM documents)
SELECT 'duplicate file' AS error, file AS value, count(*) AS n FROM r WHERE file <> '' GROUP BY file HAVING count(*) > 1
UNION ALL SELECT 'duplicate doc_id', doc_id, count(*) FROM r WHERE doc_id <> '' GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'blank field', '', count(*) FROM r WHERE file = '' OR doc_id = '' HAVING count(*) > 0"""
)
def registry_validate(spark, table):
    from quillon.sources.files import registry_errors

    rows = table("documents").select(F.coalesce(F.md5("text"), F.lit("")).alias("file"), F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.coalesce("source", F.lit(""))).alias("doc_id"))
    return registry_errors(rows)
