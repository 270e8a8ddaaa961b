"""The tools of the agent: calls in, observations out.

A tool takes a table of calls (id, arguments), the arguments being a JSON
object, and returns (id, observation, ok, chunk_ids) for each.  Those that need
no other table are columns over the arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.text import let
from quillon.operators import rules, tools
from quillon.operators.search import Embed, SearchConfig, hashed_vectors, search

Tool = Callable[[DataFrame], DataFrame]
RESULT = "struct<observation:string,ok:boolean,chunk_ids:array<string>>"

# What the tools say to the model.
BMI_NOT_NUMBERS = "错误：体重与身高必须是数字（体重单位千克、身高单位厘米），请核对后重试。"
BMI_WEIGHT = "错误：体重数值超出合理范围（2~500 千克）。请先与用户核对数值与单位，不要基于该数值继续计算。"
BMI_HEIGHT = "错误：身高数值超出合理范围（100~250 厘米）。请先与用户核对数值与单位，不要基于该数值继续计算。"
BMI_NOTE = "（依据中国成人标准：<18.5 偏瘦；18.5~23.9 正常；24~27.9 超重；≥28 肥胖）。注意：仅适用于成人；该分级不能替代整体医学评估。"
UNIT_NOT_A_NUMBER = "错误：value 必须是数字，请核对后重试。"
UNIT_REFUSED = "错误：不支持质量与体积之间的换算（常见于药物剂量场景）。药物剂量请咨询医生或药师，不要自行换算。"
UNIT_SUPPORTED = "当前支持：长度（mm/cm/m/km/英寸/英尺）、重量（kg/克/斤/磅）、温度（摄氏度℃ / 华氏度℉）。"
FLAGS_EMPTY = "错误：症状列表为空。请先收集症状再核对清单。"
FLAGS_NONE = "未命中危险信号清单中的条目。注意：这不代表安全——清单不完整，需结合完整情况判断；如症状加重或出现新的不适，请提醒用户及时就医。"
FLAGS_URGENT, FLAGS_SOON = "【立即急诊 / 拨打 120】命中信号：", "【尽快就医】命中信号："
FLAGS_CLOSE = "请在回复中明确给出上述建议；不要解释「可能是什么病」，不要让用户等待观察。"
TIMELINE_EMPTY = "错误：事件列表为空。请先向用户收集关键事件与时间，再调用本工具。"
TIMELINE_NONE = "无法解析任何事件的日期。支持格式：2026-09-10、3天前、2周前、1个月前、昨天、前天。"
TIMELINE_ASK, TIMELINE_UNREAD = "以下条目需要向用户确认时间：", "以下条目无法解析，请向用户确认具体时间："
FOUND = "检索结果（引用时 chunk_id 必须原样使用）：\n"
NOTHING_FOUND = ("未找到与「", "」相关的资料。请如实告知用户没有查到相关资料（这不代表相关说法不成立），不要编造资料内容或出处。")
NO_SEARCH = "检索服务暂不可用（ValueError）。请如实向用户说明暂时查不到资料，不要编造任何资料内容或出处。"
BAD_ARGUMENTS = "错误：参数不对（缺少 {}）。请检查后的参数重新调用。"
GO_120, SEE_DOCTOR, SEE_SOON = "立即拨打 120 或前往最近的急诊科", "建议尽快就医", "建议近期就医检查"
FLAG_TEXTS = {
    "chest_pain": ("心血管", "胸痛/胸闷持续不缓解，或伴大汗、恶心、放射痛等", GO_120),
    "breathing": ("呼吸", "严重呼吸困难、口唇发紫等缺氧表现", GO_120),
    "stroke": ("神经（卒中）", "突发面歪、言语不清、单侧肢体无力等卒中征象", GO_120),
    "consciousness": ("神经（意识）", "意识障碍、抽搐、晕厥，或突发剧烈头痛", GO_120),
    "bleeding": ("出血", "呕血、咯血、黑便/血便、大出血等", GO_120),
    "anaphylaxis": ("过敏", "严重过敏反应（喉部发紧、皮疹伴呼吸困难等）", GO_120),
    "abdominal": ("腹部", "剧烈持续腹痛（腹部拒按/板硬）", GO_120),
    "sepsis_meningitis": ("感染/全身", "高热伴意识改变、颈硬、皮疹等（脑膜炎/脓毒症征象）", GO_120),
    "pregnancy_emergency": ("孕产", "孕期/产后：剧烈腹痛、出血、剧烈头痛或胎动异常", GO_120),
    "trauma_poison": ("外伤/中毒", "头部外伤后意识改变、骨折畸形、误服中毒等", GO_120),
    "fever_duration": ("发热", "发热持续多日不退（>3 天）", SEE_DOCTOR),
    "weight_loss": ("全身", "不明原因体重明显下降", SEE_SOON),
    "cough_long": ("呼吸", "持续咳嗽超过 3 周，或痰中带血", SEE_DOCTOR),
    "leg_swelling": ("循环", "单侧小腿肿胀疼痛（血栓可能）", SEE_DOCTOR),
    "mass": ("全身", "新出现或增大的肿块/淋巴结", SEE_SOON),
    "dehydration": ("消化", "呕吐/腹泻伴脱水表现", SEE_DOCTOR),
}


def general(x: Column) -> Column:
    """A number as ``%g`` writes it: six significant digits, no trailing zeros, an exponent below 1e-4 and from 1e6 on."""

    def written(n: Column) -> Column:  # the number, and its digits and power of ten
        value, digits, power = n["x"], F.substring_index(n["e"], "e", 1), F.substring_index(n["e"], "e", -1)
        tens = power.cast("int")
        plain = F.coalesce(*(F.when(tens == p, F.format_string(f"%.{5 - p}f", value)) for p in range(-4, 6)))
        short = lambda s: F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1")
        whole = F.when(tens.between(-4, 5), short(plain)).otherwise(F.concat(F.regexp_replace(short(digits), r"\.$", ""), F.lit("e"), power))
        return F.when(value.isNotNull(), F.when(value == 0, "0").otherwise(F.regexp_replace(whole, r"\.$", "")))

    return let(F.struct(x.cast("double").alias("x"), F.format_string("%.5e", x.cast("double")).alias("e")), written)


def _result(observation: Column, ok: Column, chunk_ids: Column | None = None) -> Column:
    return F.struct(observation.alias("observation"), ok.alias("ok"), (F.array().cast("array<string>") if chunk_ids is None else chunk_ids).alias("chunk_ids"))


def _text(arguments: Column, name: str) -> Column:
    return F.get_json_object(arguments, f"$.{name}")


def _needs(arguments: Column, names: tuple[str, ...], otherwise: Column) -> Column:
    """A missing argument is answered with its name."""
    out = otherwise
    for name in reversed(names):
        told = F.coalesce(F.array_contains(F.json_object_keys(arguments), name), F.lit(False))
        out = F.when(~told, _result(F.lit(BAD_ARGUMENTS.format(name)), F.lit(False))).otherwise(out)
    return out


def calculate_bmi(arguments: Column) -> Column:
    weight, height = (_text(arguments, n).try_cast("double") for n in ("weight_kg", "height_cm"))
    found = tools.bmi(weight, height)
    exact = F.format_string("%.1f", weight / F.pow(height / 100, F.lit(2)))
    said = F.concat(F.lit("BMI = "), exact, F.lit("，分级："), found["class"], F.lit(BMI_NOTE))
    bad = [(weight.isNull() | height.isNull(), BMI_NOT_NUMBERS), (~weight.between(2, 500), BMI_WEIGHT), (~height.between(100, 250), BMI_HEIGHT)]
    wrong = F.coalesce(*(F.when(when, F.lit(text)) for when, text in bad))
    return _needs(arguments, ("weight_kg", "height_cm"), _result(F.coalesce(wrong, said), wrong.isNull()))


def convert_units(arguments: Column) -> Column:
    value, source, target = _text(arguments, "value").try_cast("double"), _text(arguments, "from_unit"), _text(arguments, "to_unit")
    given = F.struct(value.alias("v"), source.alias("a"), target.alias("b"), tools.unit(source).alias("s"), tools.unit(target).alias("t"))

    def told(g: Column) -> Column:
        return let(F.struct(g.alias("g"), tools.convert(g["v"], g["s"], g["t"]).alias("r")), said)

    def said(x: Column) -> Column:
        g, result, status = x["g"], x["r"]["result"], x["r"]["status"]
        sign = lambda u: F.concat(F.lit(" °"), F.upper(u))
        left = F.concat(general(g["v"]), F.lit(" "), g["a"], F.lit(" = "))
        text = (
            F.when(g["v"].isNull(), UNIT_NOT_A_NUMBER)
            .when(status == "same", F.concat(left, general(g["v"]), F.lit(" "), g["b"], F.lit("（来源与目标单位相同）。")))
            .when((status == "ok") & g["s"].isin("c", "f"), F.concat(general(g["v"]), sign(g["s"]), F.lit(" = "), F.format_string("%.1f", result), sign(g["t"])))
            .when(status == "ok", F.concat(left, general(result), F.lit(" "), g["b"]))
            .when(status == "refused", F.lit(UNIT_REFUSED))
            .otherwise(F.concat(F.lit("错误：不支持「"), g["a"], F.lit("」→「"), g["b"], F.lit("」的换算。" + UNIT_SUPPORTED)))
        )
        return _result(text, g["v"].isNotNull() & status.isin("same", "ok"))

    return _needs(arguments, ("value", "from_unit", "to_unit"), let(given, told))


def _strings(arguments: Column, name: str) -> Column:
    """The texts of a list argument, trimmed, without blank ones."""
    items = F.coalesce(F.from_json(_text(arguments, name), "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def red_flag_report(text: Column) -> Column:
    """What a text of symptoms says about danger."""

    def lines_of(level: str) -> Column:
        of_level = [r for r in rules.RED_FLAGS if r.level == level]
        before, after = (F.create_map(*(F.lit(x) for r in of_level for x in (r.rule_id, form.format(*FLAG_TEXTS[r.rule_id])))) for form in ("- [{0}] {1}（命中：「", "」）→ 建议：{2}"))
        return F.transform(rules.rule_hits(text, of_level), lambda h: F.concat(F.element_at(before, h["rule_id"]), h["matched"], F.element_at(after, h["rule_id"])))

    none = F.array().cast("array<string>")
    part = lambda head, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(head)), rows)).otherwise(none)
    whole = F.concat(part(FLAGS_URGENT, lines_of("emergency")), part(FLAGS_SOON, lines_of("high")))
    return F.when(F.size(whole) > 0, F.array_join(F.concat(whole, F.array(F.lit(FLAGS_CLOSE))), "\n")).otherwise(FLAGS_NONE)


def check_red_flags(arguments: Column) -> Column:
    told = lambda text: _result(F.when(text != "", red_flag_report(text)).otherwise(FLAGS_EMPTY), text != "")
    return _needs(arguments, ("symptoms",), let(F.array_join(_strings(arguments, "symptoms"), "；"), told))


def timeline_calc(arguments: Column, today: Column) -> Column:
    """Events sorted from the earliest, those of one day in the order told, with the days between neighbours."""
    number, nothing = lambda i: i.cast("string"), F.array().cast("array<string>")
    day = lambda e: F.date_sub(today, F.bround(e["days"], 0).cast("int")).cast("string")
    when = lambda e: F.when(e["days"] < 0, F.concat(F.lit("日期在未来（≈"), day(e), F.lit("），请与用户确认"))).when(e["days"] == 0, "今天").otherwise(F.concat(F.lit("约"), general(e["days"]), F.lit("天前（≈"), day(e), F.lit("）")))
    events = F.transform(_strings(arguments, "events"), lambda e, i: F.struct((-tools.days_ago(e, today)).alias("late"), i.alias("i"), e.alias("text")))

    def sorted_out(all_: Column) -> Column:
        known = F.transform(F.array_sort(F.filter(all_, lambda e: e["late"].isNotNull())), lambda e: F.struct((-e["late"]).alias("days"), e["text"].alias("text")))
        unread = F.array_join(F.transform(F.filter(all_, lambda e: e["late"].isNull()), lambda e: e["text"]), "；")
        return F.struct(known.alias("known"), unread.alias("unread"))

    def told(x: Column) -> Column:
        rows, unread = x["known"], x["unread"]
        listed = F.transform(rows, lambda e, i: F.concat(number(i + 1), F.lit(". "), when(e), F.lit("："), e["text"]))
        gaps = F.transform(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), lambda e, i: F.concat(F.lit("- 事件"), number(i + 1), F.lit(" → 事件"), number(i + 2), F.lit("：约 "), general(F.abs(F.get(rows, i + 1)["days"] - e["days"])), F.lit(" 天")))
        head = F.array(F.concat(F.lit("今天日期："), today.cast("string")), F.lit("时间线（由早到晚）："))
        between = F.when(F.size(rows) > 1, F.concat(F.array(F.lit("相邻事件间隔：")), gaps)).otherwise(nothing)
        rest = F.when(unread != "", F.array(F.concat(F.lit(TIMELINE_UNREAD), unread))).otherwise(nothing)
        none = F.when(unread != "", F.concat(F.lit(TIMELINE_NONE + "\n" + TIMELINE_ASK), unread)).otherwise(TIMELINE_NONE)
        some = F.size(rows) > 0
        return _result(F.when(some, F.array_join(F.concat(head, listed, between, rest), "\n")).otherwise(none), some)

    given = F.coalesce(F.json_array_length(_text(arguments, "events")), F.lit(0)) > 0
    return _needs(arguments, ("events",), F.when(given, let(let(events, sorted_out), told)).otherwise(_result(F.lit(TIMELINE_EMPTY), F.lit(False))))


def column_tool(f: Callable[[Column], Column]) -> Tool:
    return lambda calls: calls.select("id", f(F.col("arguments")).alias("r")).select("id", "r.observation", "r.ok", "r.chunk_ids")


def retrieval_tool(chunks: DataFrame, config: SearchConfig | None = None, embed: Embed = hashed_vectors, most: int = 3) -> Tool:
    """Searches (chunk_id, doc_id, ord, text[, source, section]) for the calls' queries, all of them at once; ``most`` hits at most."""
    config = config or SearchConfig()

    def run(calls: DataFrame) -> DataFrame:
        k = F.coalesce(F.nullif(_text(F.col("arguments"), "k").try_cast("double").cast("int"), F.lit(0)), F.lit(most))
        asked = calls.select("id", _text(F.col("arguments"), "query").alias("query"), F.least(F.greatest(k, F.lit(1)), F.lit(most)).alias("k"), F.col("arguments"))
        hits = search(chunks, asked.select(F.col("id").alias("query_id"), F.col("query").alias("question")), config, embed=embed)
        blank = F.lit("")
        told = {c: (F.coalesce(F.col(c), blank) if c in chunks.columns else blank).alias(c) for c in ("source", "section")}
        of = chunks.select("chunk_id", "text", *told.values())
        rows = hits.join(asked.select(F.col("id").alias("query_id"), "k"), "query_id").where(F.col("rank") <= F.col("k")).join(of, "chunk_id")
        listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text", "source", "section", "score"))).alias("found"))  # at most ``most`` for a call
        found = asked.join(listed, F.col("id") == F.col("query_id"), "left")
        payload = F.to_json(F.transform("found", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["text"].alias("text"), h["source"].alias("source"), h["section"].alias("section"), h["score"].alias("score"))))
        some, blank_query = F.col("found").isNotNull(), rules.flat(F.col("query")) == ""
        said = F.when(blank_query, F.lit(NO_SEARCH)).when(some, F.concat(F.lit(FOUND), payload)).otherwise(F.concat(F.lit(NOTHING_FOUND[0]), "query", F.lit(NOTHING_FOUND[1])))
        ids = F.coalesce(F.transform("found", lambda h: h["chunk_id"].cast("string")), F.array().cast("array<string>"))
        return found.select("id", _needs(F.col("arguments"), ("query",), _result(said, ~blank_query, ids)).alias("r")).select("id", "r.observation", "r.ok", "r.chunk_ids")

    return run


def standard_tools(chunks: DataFrame | None = None, today: Column | None = None, config: SearchConfig | None = None, embed: Embed = hashed_vectors) -> Mapping[str, Tool]:
    """The tools by name; that of retrieval only with ``chunks`` to search."""
    day = F.current_date() if today is None else today
    found: dict[str, Tool] = {
        "calculate_bmi": column_tool(calculate_bmi),
        "convert_units": column_tool(convert_units),
        "check_red_flags": column_tool(check_red_flags),
        "timeline_calc": column_tool(lambda a: timeline_calc(a, day)),
    }
    if chunks is not None:
        found["retrieve_evidence"] = retrieval_tool(chunks, config, embed)
    return found
