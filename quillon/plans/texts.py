"""Operators on Chinese prose, clauses, licences and model outputs over whole tables.

The tables' texts are of Latin letters, so letters are mapped to ideographs or
numerals first; the SQL maps the same text and applies the patterns to it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import bridge as J, chunking as K, curation as C, rules as R
from quillon.operators.chat import STRUCTURED
from quillon.plans.registry import query

LETTERS, IDEOGRAPHS = "aeiou", "中文高血压"
TEXT = "coalesce(text, '')"
WORDS = "list_filter(string_split_regex(t, '[^A-Za-z]+'), lambda x: x <> '')"


def _words(text):
    return F.filter(F.split(text, "[^A-Za-z]+"), lambda x: x != "")


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


@query(
    f"""WITH r AS (SELECT doc_id, regexp_extract_all(translate({TEXT}, '{LETTERS}', '{IDEOGRAPHS}'), '[一-鿿]+|[A-Za-z0-9]+') AS runs FROM documents),
t AS (SELECT doc_id, flatten(list_transform(runs, lambda r: CASE WHEN NOT regexp_matches(r, '^[一-鿿]') THEN [lower(r)] WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)) AS tokens FROM r)
SELECT doc_id, len(tokens) AS n, md5(array_to_string(tokens, '|')) AS digest FROM t"""
)
def tokenize(spark, table):
    """Bigrams of ideographs and Latin words of mixed texts."""
    tokens = table("documents").select("doc_id", T.tokenize(F.translate(_text(), LETTERS, IDEOGRAPHS)).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("digest"))


#: Full stops become the ideographic ones that end sentences; a line of three digits at most is a page number.
LINES_SQL = """SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS pos FROM (SELECT doc_id, replace(coalesce(text, ''), '.', '。') AS t FROM documents))"""


@query(
    f"""WITH l AS ({LINES_SQL}), k AS (SELECT * FROM l WHERE line <> '' AND NOT regexp_matches(line, '^[—\\-–\\s]*[0-9]{{1,3}}[—\\-–\\s]*$')),
b AS (SELECT *, CASE WHEN length(line) <= 40 AND regexp_matches(line, '^(附件|第|一、|二、)') THEN 1
  WHEN coalesce(lag(regexp_matches(line, '[。；！？：）」』”"'']$')) OVER (PARTITION BY doc_id ORDER BY pos), true) THEN 1 ELSE 0 END AS begins FROM k),
n AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block FROM b)
SELECT doc_id, block, md5(string_agg(line, '' ORDER BY pos)) AS digest FROM n GROUP BY doc_id, block"""
)
def line_rejoin(spark, table):
    """Lines broken within sentences put together."""
    docs = table("documents").select("doc_id", F.replace(_text(), F.lit("."), F.lit("。")).alias("t"))
    return C.rejoin_lines(K.lines_of(docs, "doc_id", "t"), "doc_id", "pos", "line").select("doc_id", "block", F.md5("line").alias("digest"))


@query(
    """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: [{'head': substr(x, 1, 5), 'body': substr(x, 6)}]), lambda s: s[1].body <> '') AS s FROM documents),
m AS (SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN length(a[-1].body) < 200
  THEN list_concat(a[1:len(a) - 1], [{'head': a[-1].head, 'body': a[-1].body || chr(10) || '**' || x[1].head || '** ' || x[1].body}]) ELSE list_concat(a, x) END) AS m FROM s WHERE len(s) > 0)
SELECT doc_id, len(m) AS n, md5(array_to_string(list_transform(m, lambda x: x.head || '=' || x.body), '|')) AS digest FROM m"""
)
def section_merge(spark, table):
    """Lines as sections, short ones folded into the one before."""
    sections = F.transform(F.split(_text(), "\n"), lambda x: F.struct(F.substring(x, 1, 5).alias("head"), F.substr(x, F.lit(6)).alias("body")))
    merged = table("documents").select("doc_id", C.merge_sections(sections).alias("m")).where(F.size("m") > 0)
    return merged.select("doc_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["head"], F.lit("="), x["body"])), "|")).alias("digest"))


WORDINGS = ("https://creativecommons.org/licenses/by-nc/4.0/", "Creative Commons Attribution 4.0 International", "CC BY-SA 3.0", "cc-by", "", "Creative Commons Attribution", "All rights reserved", "see https://x/by/4x0/")
RAW_SQL = "CASE WHEN w = '' THEN '' ELSE substr(coalesce(text, ''), 1, 6) || ' ' || w END"
WORDING_SQL = "list_value(" + ", ".join(f"'{w}'" for w in WORDINGS) + ")[length(coalesce(text, '')) % 8 + 1]"


@query(
    f"""WITH r AS (SELECT doc_id, {RAW_SQL} AS raw FROM (SELECT doc_id, text, {WORDING_SQL} AS w FROM documents))
SELECT doc_id, CASE WHEN raw = '' THEN '{C.NO_LICENSE}' {" ".join("WHEN " + " OR ".join(f"contains(lower(raw), '{w}')" for w in words) + f" THEN '{label}'" for words, label in C.LICENSE_LABELS)}
  ELSE substr(regexp_replace(regexp_replace(regexp_replace(raw, '[ \\t　 ]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 1, 60) END AS license FROM r"""
)
def normalize_license(spark, table):
    """The beginnings of texts followed by one of several wordings of licences."""
    wording = F.element_at(F.array(*map(F.lit, WORDINGS)), F.length(_text()) % 8 + 1)
    raw = F.when(wording == "", "").otherwise(F.concat(F.substring(_text(), 1, 6), F.lit(" "), wording))
    return table("documents").select("doc_id", C.normalize_license(raw).alias("license"))


NUMERALS = ("etaoinshrd", "一二三四五六七八九十")
CLAUSE_SQL = f"""SELECT doc_id, pos, CASE length(line) % 5 WHEN 0 THEN '第' || m || '章 ' WHEN 1 THEN m || '、' WHEN 2 THEN '（' || m || '）' WHEN 3 THEN '第' || m || '条' ELSE m END || line AS line
  FROM (SELECT *, translate(lower(substr(line, 1, 2)), '{NUMERALS[0]}', '{NUMERALS[1]}') AS m FROM ({LINES_SQL}) WHERE line <> '')"""


@query(
    f"""WITH l AS ({CLAUSE_SQL}), m AS (SELECT *, coalesce(nullif(regexp_extract(line, '^(第{C.NUMERALS}[章节条]|{C.NUMERALS}、|（{C.NUMERALS}）)', 1), ''), '') AS marker FROM l)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, marker, CAST(CASE WHEN regexp_matches(marker, '[章、]$') THEN 2 WHEN regexp_matches(marker, '[节条]$') THEN 3 ELSE 4 END AS BIGINT) AS level FROM m WHERE marker <> ''"""
)
def clause_heading(spark, table):
    """Lines that begin clauses, by their first letters read as numerals."""
    def named(line):
        m, n = F.translate(F.lower(F.substring(line, 1, 2)), *NUMERALS), F.length(line) % 5
        mark = F.when(n == 0, F.concat(F.lit("第"), m, F.lit("章 "))).when(n == 1, F.concat(m, F.lit("、"))).when(n == 2, F.concat(F.lit("（"), m, F.lit("）"))).when(n == 3, F.concat(F.lit("第"), m, F.lit("条"))).otherwise(m)
        return F.concat(mark, line)

    def headings(text):
        """Within each row, where every line is looked at once: a condition on what is found would be pushed below it and find it again."""
        lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.cast("long").alias("pos"), T.strip(x).alias("line")))
        found = F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(x["pos"].alias("pos"), C.clause_heading(named(x["line"])).alias("h")))
        return F.filter(found, lambda x: x["h"]["marker"].isNotNull())

    docs = table("documents").select("doc_id", F.explode(headings(F.replace(_text(), F.lit("."), F.lit("。")))).alias("x"))
    return docs.select("doc_id", "x.pos", "x.h.marker", "x.h.level")


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(translate({TEXT}, '{LETTERS}', '{IDEOGRAPHS}'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:30] AS l FROM documents),
c AS (SELECT doc_id, list_filter(l, lambda x: length(x) >= 6 AND length(regexp_replace(x, '[^一-鿿]', '', 'g')) >= 5 AND NOT regexp_matches(x, '[：:。]$') AND NOT regexp_matches(x, '^(目录|目次)')) AS c FROM l)
SELECT doc_id, substr(coalesce(c[1], '{C.NO_TITLE}'), 1, 80) AS title FROM c"""
)
def derive_title(spark, table):
    """The first line with five ideographs that ends no sentence."""
    return table("documents").select("doc_id", C.derive_title(F.translate(_text(), LETTERS, IDEOGRAPHS)).alias("title"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS pos FROM (SELECT doc_id, {TEXT} AS t FROM documents)),
m AS (SELECT doc_id, pos, CASE WHEN length(line) % 4 = 0 AND regexp_matches(line, '^[A-Za-z]') THEN '## ' || substr(line, 1, 3) ELSE line END AS line FROM l),
n AS (SELECT *, regexp_extract(line, '^##\\s+(\\S.*)$', 1) AS own FROM m),
h AS (SELECT *, last_value(nullif(regexp_replace(own, '^\\s+|\\s+$', '', 'g'), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS name FROM n)
SELECT doc_id, name, md5(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g')) AS digest FROM h WHERE own = '' AND name IS NOT NULL GROUP BY doc_id, name"""
)
def template_sections(spark, table):
    """Texts whose lines of certain lengths are made headings, in sections by them."""
    lines = K.lines_of(table("documents").select("doc_id", _text().alias("t")), "doc_id", "t")
    heading = (F.length("line") % 4 == 0) & F.col("line").rlike("^[A-Za-z]")
    lines = lines.withColumn("line", F.when(heading, F.concat(F.lit("## "), F.substring("line", 1, 3))).otherwise(F.col("line")))
    return K.template_sections(lines, "doc_id").select("doc_id", "name", F.md5("body").alias("digest"))


# ------------------------------------------------------------------ model outputs


DRAFT_SQL = """SELECT conv_id, turn, text, length(text) AS n, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM conversations"""


@query(
    f"""WITH d AS ({DRAFT_SQL})
SELECT conv_id, turn, CASE WHEN n % 3 = 0 THEN coalesce(nullif(regexp_replace(substr(text, 1, 20), '^\\s+|\\s+$', '', 'g'), ''), '{J.DEFAULT_REPLY}') ELSE '答' || n END AS reply,
  CASE n % 4 WHEN 0 THEN 'emergency' WHEN 1 THEN 'high' ELSE 'medium' END AS risk_level,
  CASE WHEN n % 5 = 0 THEN 'high' WHEN len(w) > 0 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(w[1:2], '|') AS hypotheses, CASE WHEN n % 2 = 0 THEN 'kb:c' || n ELSE '' END AS evidence,
  CASE WHEN n % 7 = 0 THEN '{J.DEFAULT_STEPS[0]}' ELSE '就医' END AS steps FROM d"""
)
def normalize_output(spark, table):
    """Turns as what a model might write, brought into shape."""
    n, t = F.length("text"), F.col("text")
    words = F.slice(_words(t), 1, 2)
    assessment = F.struct(
        F.transform(words, lambda w: F.struct(w.alias("name"), F.lit("高").alias("likelihood"))).alias("hypotheses"), F.when(n % 5 == 0, "高").alias("confidence"),
        F.when(n % 2 == 0, F.array(F.struct(F.lit("知识库").alias("source"), F.concat(F.lit("c"), n.cast("string")).alias("ref"), F.lit("依据").alias("detail")))).alias("evidence"),
        F.when(n % 7 == 0, F.array(F.lit("无"))).otherwise(F.array(F.lit("就医"))).alias("next_steps"),
    )
    said = F.to_json(F.struct(F.when(n % 3 != 0, F.concat(F.lit("答"), n.cast("string"))).alias("reply"), F.when(n % 4 == 0, "急诊").when(n % 4 == 1, "HIGH").alias("risk_level"), assessment.alias("assessment")))
    schema = "reply string, risk_level string, confidence string, hypotheses array<struct<name:string>>, evidence array<struct<source:string,ref:string>>, next_steps array<string>"
    read = table("conversations").select("conv_id", "turn", F.from_json(J.output_column(said, F.substring("text", 1, 20)), schema).alias("o"))
    joined = lambda c, f: F.array_join(F.transform(f"o.{c}", f), "|")
    return read.select("conv_id", "turn", "o.reply", "o.risk_level", "o.confidence", joined("hypotheses", lambda h: h["name"]).alias("hypotheses"), joined("evidence", lambda e: F.concat(e["source"], F.lit(":"), e["ref"])).alias("evidence"), F.array_join("o.next_steps", "|").alias("steps"))


#: Tokens are lengths of words; a word of 13 letters ends the thinking.
TOKENS_SQL = f"SELECT doc_id, list_transform({WORDS}, lambda x: length(x)) AS k FROM (SELECT doc_id, {TEXT} AS t FROM documents)"


@query(
    f"""WITH t AS ({TOKENS_SQL}), s AS (SELECT doc_id, k, CASE WHEN len(k) > 512 THEN k[len(k) - 511:len(k)] ELSE k END AS seen FROM t),
r AS (SELECT doc_id, len(k) AS n, NOT list_contains(k, 13) AS thinking, len(k) >= 72 AND (seen[len(seen) - 47:len(seen) - 24] = seen[len(seen) - 23:len(seen)] OR
  len(list_filter(range(1, len(seen) - 22), lambda i: seen[i:i + 23] = seen[len(seen) - 23:len(seen)])) >= 3) AS repeats FROM s)
SELECT doc_id, CASE WHEN thinking AND n >= 400 THEN 'think_cap' WHEN thinking AND repeats THEN 'repeat' END AS reason FROM r"""
)
def stop_reason(spark, table):
    """When the words of a text, read as tokens, would be stopped."""
    tokens = table("documents").select("doc_id", F.transform(_words(_text()), F.length).alias("k"))
    return tokens.select("doc_id", J.stop_reason(F.col("k"), 13, F.lit(400)).alias("reason"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, list_distinct({WORDS}) AS w, list_filter({WORDS}, lambda x: length(x) = 4) AS four FROM (SELECT conv_id, turn, text AS t FROM conversations))
SELECT conv_id, turn, len(list_filter(w, lambda x: x <> four[1] OR four[1] IS NULL)) AS business, CASE WHEN len(four) > 0 THEN '{STRUCTURED}' ELSE '' END AS structured FROM w"""
)
def tools_split(spark, table):
    """The words of a turn as tools; the first of four letters stands for the structured one."""
    words = table("conversations").select("conv_id", "turn", F.array_distinct(_words(F.col("text"))).alias("w"))
    named = F.get(F.filter("w", lambda x: F.length(x) == 4), F.lit(0))
    tools = F.transform("w", lambda x: F.when(x == named, STRUCTURED).otherwise(x))
    split = words.withColumn("tools", tools)
    return split.select("conv_id", "turn", F.size(F.filter("tools", lambda x: x != STRUCTURED)).cast("long").alias("business"), F.array_join(F.filter("tools", lambda x: x == STRUCTURED), "|").alias("structured"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_transform({WORDS}, lambda x: lower(x))) AS w FROM (SELECT conv_id, turn, text AS t FROM conversations)), e AS (SELECT conv_id, turn, unnest(w) AS name FROM w)
SELECT conv_id, turn, name, CASE WHEN length(name) % 3 = 0 THEN 'high' WHEN length(name) % 3 = 1 THEN 'medium' ELSE 'low' END AS likelihood FROM e"""
)
def hypothesis_lookup(spark, table):
    """A card's hypotheses (the words of a turn) with the assessment's levels, by name; those that it lacks are low."""
    words = table("conversations").select("conv_id", "turn", F.array_distinct(F.transform(_words(F.col("text")), F.lower)).alias("card"))
    told = F.filter("card", lambda x: F.length(x) % 3 != 2)
    known = F.map_from_arrays(told, F.transform(told, lambda x: F.when(F.length(x) % 3 == 0, "high").otherwise("medium")))
    return words.withColumn("known", known).select("conv_id", "turn", F.explode("card").alias("name"), "known").select("conv_id", "turn", "name", F.coalesce(F.try_element_at("known", F.col("name")), F.lit("low")).alias("likelihood"))


@query(
    f"""WITH p AS (SELECT doc_id, {TEXT} AS t, list_filter(string_split({TEXT}, chr(10)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(length('answer:' || substr(t, 1, 4000)) AS BIGINT) AS n, md5(array_to_string(l[1:8], ';')) AS points FROM p"""
)
def judge_prompt(spark, table):
    """Answers cut to 4,000 characters, with eight points at most."""
    points = F.filter(F.split(_text(), "\n"), lambda x: x != "")
    return table("documents").select("doc_id", F.length(F.concat(F.lit("answer:"), F.substring(_text(), 1, 4000))).cast("long").alias("n"), F.md5(F.array_join(F.slice(points, 1, 8), ";")).alias("points"))


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(string_split({TEXT}, chr(10)), lambda x: x <> '') AS l FROM documents), q AS (SELECT doc_id, coalesce(l[1], '') AS q, l[2:4] AS o, l[5:6] AS e FROM p)
SELECT doc_id, md5(concat_ws(chr(10), '题目：' || q,
  CASE WHEN len(o) > 0 THEN '选项：' || chr(10) || array_to_string(list_transform(range(1, len(o) + 1), lambda i: chr(CAST(64 + i AS INTEGER)) || '. ' || o[i]), chr(10)) END,
  CASE WHEN len(e) > 0 THEN '资料：' || chr(10) || array_to_string(list_transform(range(1, len(e) + 1), lambda i: '[' || i || '] ' || e[i]), chr(10)) END)) AS digest FROM q"""
)
def build_prompt(spark, table):
    """The lines of a text as a question, its options and its evidence."""
    lines = F.filter(F.split(_text(), "\n"), lambda x: x != "")
    rows = table("documents").select("doc_id", lines.alias("l")).select("doc_id", F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("q"), F.slice("l", 2, 3).alias("o"), F.slice("l", 5, 2).alias("e"))
    options = F.array_join(F.transform("o", lambda x, i: F.concat(F.chr(i + 65), F.lit(". "), x)), "\n")
    evidence = F.array_join(F.transform("e", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    parts = [F.concat(F.lit("题目："), "q"), F.when(F.size("o") > 0, F.concat(F.lit("选项：\n"), options)), F.when(F.size("e") > 0, F.concat(F.lit("资料：\n"), evidence))]
    return rows.select("doc_id", F.md5(F.concat_ws("\n", *parts)).alias("digest"))


_PLAIN = "translate(lower({0}), '" + T.PUNCTUATION.replace("'", "''") + "', '')"


@query(
    f"""WITH p AS (SELECT doc_id, {TEXT} AS t, CASE WHEN length({TEXT}) % 2 = 0 THEN substr({TEXT}, 5, 12) ELSE 'zzz ' || substr({TEXT}, 1, 3) END AS want FROM documents)
SELECT doc_id, contains({_PLAIN.format('t')}, {_PLAIN.format('want')}) AS correct FROM p"""
)
def rule_fast_path(spark, table):
    """An answer that plainly contains the reference needs no judge."""
    t = _text()
    want = F.when(F.length(t) % 2 == 0, F.substring(t, 5, 12)).otherwise(F.concat(F.lit("zzz "), F.substring(t, 1, 3)))
    return table("documents").select("doc_id", F.contains(T.normalize(t), T.normalize(want)).alias("correct"))


@query(
    f"""WITH p AS (SELECT conv_id, turn, nullif(trim(substr(text, 1, length(text) % 9)), '') AS reply, list_value('low', 'critical', 'emergency', NULL)[length(text) % 4 + 1] AS risk,
  CASE WHEN length(text) % 5 = 0 THEN 'very_high' ELSE 'high' END AS confidence, {WORDS.replace('(t,', '(text,')}[1:length(text) % 3] AS steps FROM conversations)
SELECT conv_id, turn, concat_ws('|', CASE WHEN reply IS NULL THEN 'reply' END, CASE WHEN risk NOT IN ('low', 'medium', 'high', 'emergency') OR risk IS NULL THEN 'risk_level' END,
  CASE WHEN confidence NOT IN ('low', 'medium', 'high') THEN 'confidence' END, CASE WHEN len(steps) < 1 THEN 'next_steps' END) AS errors FROM p"""
)
def schema_validate(spark, table):
    """Outputs made of turns, and which of their fields are wrong."""
    n = F.length("text")
    rows = table("conversations").select(
        "conv_id", "turn", F.nullif(F.trim(F.substring("text", F.lit(1), n % 9)), F.lit("")).alias("reply"), F.element_at(F.array(F.lit("low"), F.lit("critical"), F.lit("emergency"), F.lit(None)), n % 4 + 1).alias("risk_level"),
        F.when(n % 5 == 0, "very_high").otherwise("high").alias("confidence"), F.slice(_words(F.col("text")), F.lit(1), n % 3).alias("next_steps"),
    )
    return rows.select("conv_id", "turn", F.array_join(J.output_errors(F.col("reply"), F.col("risk_level"), F.col("confidence"), F.col("next_steps")), "|").alias("errors"))


# ------------------------------------------------------------------ review


PHRASES = ("您得了感冒", "建议吃点布洛芬", "肯定没事", "根据相关研究", "自杀的念头", "请就医", "多休息")
_any = "|".join
REVIEW_SQL = f"""SELECT *, concat_ws('|', CASE WHEN regexp_replace(reply, '\\s+', '', 'g') = '' THEN 'empty_reply' END,
  CASE WHEN n % 5 = 0 AND confidence <> 'low' THEN 'empty_hypotheses' END, CASE WHEN regexp_matches(reply, '{_any(R.DIAGNOSIS)}') THEN 'diagnosis_language' END,
  CASE WHEN regexp_matches(reply, '{_any(R.MEDICATION)}') THEN 'medication_recommendation' END, CASE WHEN regexp_matches(reply, '{_any(R.ABSOLUTES)}') THEN 'absolutist_claim' END,
  CASE WHEN n % 6 = 0 THEN 'fabricated_citation' END, CASE WHEN n % 6 <> 0 AND n % 2 = 1 AND regexp_matches(reply, '{R.UNSUPPORTED}') THEN 'unsupported_reference' END,
  CASE WHEN n % 3 = 0 AND NOT (n % 4 < 2 AND regexp_matches(reply || '；' || step, '{_any(R.CARE_WORDS + R.URGENT_WORDS)}')) THEN 'red_flag_escalation' END,
  CASE WHEN n % 13 > 6 AND confidence = 'high' THEN 'closing_confidence_cap' END, CASE WHEN confidence <> 'low' AND NOT regexp_matches(step, '{_any(R.CARE_WORDS)}') THEN 'closing_advice_missing' END,
  CASE WHEN regexp_matches(reply, '{_any(R.SELF_HARM_ECHO)}') THEN 'self_harm_echo' END) AS codes
FROM (SELECT conv_id, turn, n, CASE WHEN n % 11 = 0 THEN ' ' ELSE text || list_value({", ".join(f"'{p}'" for p in PHRASES)})[n % 7 + 1] END AS reply,
  list_value('low', 'medium', 'high')[n % 3 + 1] AS confidence, CASE WHEN n % 4 = 1 THEN '到医院复查' ELSE '休息' END AS step FROM (SELECT *, length(text) AS n FROM conversations))"""


def _reviewed(table):
    """Turns as replies, with what a model adds to them by their lengths, and the codes of what is found in them."""
    n = F.length("text")
    reply = F.when(n % 11 == 0, " ").otherwise(F.concat("text", F.element_at(F.array(*map(F.lit, PHRASES)), n % 7 + 1)))
    none = F.array().cast("array<string>")
    codes = lambda reply: R.violations(
        reply, F.when(n % 5 == 0, none).otherwise(F.array(F.lit("感冒"))), F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), n % 3 + 1), F.when(n % 6 == 0, F.array(F.lit("c9"))).otherwise(none),
        F.when(n % 2 == 0, F.array(F.lit("c1"))).otherwise(none), F.when(n % 3 == 0, F.array(F.lit("胸痛"))).otherwise(none), F.when(n % 4 < 2, "high").otherwise("low"),
        F.array(F.when(n % 4 == 1, "到医院复查").otherwise("休息")), n % 13 > 6,
    )
    return table("conversations").select("conv_id", "turn", T.let(reply, codes).alias("codes"))


@query(f"SELECT conv_id, turn, codes FROM ({REVIEW_SQL})")
def review_violations(spark, table):
    return _reviewed(table).select("conv_id", "turn", F.array_join("codes", "|").alias("codes"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(codes, 'empty_reply|diagnosis_language|medication_recommendation') THEN 'replace' WHEN codes <> '' THEN 'degrade' ELSE 'pass' END AS action FROM ({REVIEW_SQL})")
def review_actions(spark, table):
    return _reviewed(table).select("conv_id", "turn", R.action(F.col("codes")).alias("action"))


# ------------------------------------------------------------------ chunks


BARE = "regexp_replace(regexp_replace(coalesce(text, ''), '[#【】]', '', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(
    f"""SELECT doc_id, coalesce(source, 'none') || CASE s WHEN 1 THEN '' ELSE ' / ' || coalesce(lang, 'none') END AS path, CASE b WHEN 0 THEN '' ELSE 'e' || b END AS entry,
  md5(CASE b WHEN 0 THEN 'before' WHEN 1 THEN '【e1】x' ELSE regexp_replace('【e2】' || {BARE}, '\\s+$', '') END) AS digest FROM documents, (VALUES (1, 0), (2, 1), (2, 2)) v(s, b)"""
)
def chunk_structured(spark, table):
    """Headings first, then entries within each section."""
    named = lambda c: F.coalesce(c, F.lit("none"))
    text = T.strip(F.regexp_replace(_text(), "[#【】]", ""))
    docs = table("documents").select("doc_id", F.concat(F.lit("# "), named("source"), F.lit("\nbefore\n## "), named("lang"), F.lit("\n【e1】x\n【e2】"), text).alias("t"))
    within = K.entries_of(K.sections_of(docs, "doc_id", "t").select(F.struct("doc_id", "path").alias("of"), "body"), "of", "body")
    return within.select("of.doc_id", "of.path", "entry", F.md5("body").alias("digest"))


CITED_SQL = f"""SELECT doc_id, coalesce(text, '') || '。见 [chunk_id: kb::a-' || n || '::' || (n % 7) || ']，' || CASE WHEN n % 2 = 0 THEN 'kb::b::' || (n % 5) || '。' ELSE '来源：c_' || n || '；' END || '[' || (n % 4) || '][' || (n % 4) || ']' AS t,
  [substr(coalesce(text, 'none') || 'xxxx', 1, 4), 'kb::b::' || (n % 5)] AS e FROM (SELECT *, length(coalesce(text, '')) AS n FROM documents)"""
_patterns = ", ".join(f"regexp_extract_all(t, '{p}', 1)" for p in T.CITATION_PATTERNS)


@query(
    f"""WITH c AS (SELECT doc_id, e, t, list_filter(list_transform(flatten([{_patterns}]), lambda x: regexp_replace(x, '[。，,.;；:：）)\\]】]+$', '')), lambda x: x <> '') AS bare,
  list_filter(list_transform(regexp_extract_all(t, '{T.CITATION_NUMBER}', 1), lambda x: CASE WHEN CAST(x AS INTEGER) > 0 THEN e[CAST(x AS INTEGER)] END), lambda x: x IS NOT NULL) AS numbered FROM ({CITED_SQL})),
x AS (SELECT doc_id, unnest(list_concat(bare, numbered)) AS c, unnest(range(0, len(bare) + len(numbered))) AS i FROM c)
SELECT doc_id, string_agg(c, '|' ORDER BY i) AS citations FROM (SELECT doc_id, c, min(i) AS i FROM x GROUP BY doc_id, c) GROUP BY doc_id"""
)
def extract_citations(spark, table):
    """Chunks cited after the texts, by id and by number, each named once."""
    t = _text()
    n = F.length(t)
    number = lambda k: (n % k).cast("string")
    said = F.concat(
        t, F.lit("。见 [chunk_id: kb::a-"), n.cast("string"), F.lit("::"), number(7), F.lit("]，"),
        F.when(n % 2 == 0, F.concat(F.lit("kb::b::"), number(5), F.lit("。"))).otherwise(F.concat(F.lit("来源：c_"), n.cast("string"), F.lit("；"))), F.lit("["), number(4), F.lit("]["), number(4), F.lit("]"),
    )
    evidence = F.array(F.substring(F.concat(F.coalesce("text", F.lit("none")), F.lit("xxxx")), 1, 4), F.concat(F.lit("kb::b::"), number(5)))
    return table("documents").select("doc_id", F.array_join(T.extract_citations(said, evidence), "|").alias("citations"))
