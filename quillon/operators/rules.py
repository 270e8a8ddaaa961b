"""Safety rules: red flags, pre-scan of inputs, review of outputs.

Rules are data with defaults below; patterns are constants of the plan, so each
is compiled once for a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.text import let, strip
from quillon.staging import stage


@dataclass(frozen=True)
class Rule:
    rule_id: str
    level: str
    patterns: tuple[str, ...]


# Red-flag rules in their order, urgent ones first; then pre-scan patterns.
RED_FLAGS = (
    Rule("chest_pain", "emergency", (
        "(胸口|胸前|心口|胸骨后|胸).{0,10}(压榨|压得|刀割|针扎|紧缩).{0,12}(疼|痛|闷)?",
        "(胸痛|胸口疼|胸口痛|胸闷|心口疼|心口痛).{0,12}(大汗|冷汗|冒汗|出汗|呼吸困难|喘不上气|放射|恶心|呕吐|左肩|左臂|后背|濒死|不缓解)",
        "(胸口|胸前|心口|胸骨后).{0,8}(疼|痛|闷).{0,12}(大汗|冷汗|冒汗|出汗|喘|呼吸困难|恶心|呕吐|放射|左肩|左臂|后背)",
        "(胸痛|胸口疼|胸口痛|胸闷).{0,6}(持续|一直|不停)",
        "(胸痛|胸口疼|胸口痛|胸闷).{0,10}(十几分钟|20分钟|半小时|一小时)",
    )),
    Rule("breathing", "emergency", ("(呼吸困难|喘不上气|喘不过气|窒息)", "(口唇发紫|嘴唇发紫|嘴唇青紫)", "(憋气|憋得慌).{0,12}(厉害|严重|加重|越来越|受不了)")),
    Rule("stroke", "emergency", (
        "(嘴角歪|嘴角歪斜|口角歪斜|嘴歪了|面部歪)", "(说话不清|言语不清|说不清话|口齿不清|听不懂话)", "(半身|偏瘫|一侧肢体无力|一侧手脚发麻|一侧手脚无力|胳膊腿没力气|手脚不听使唤)",
    )),
    Rule("consciousness", "emergency", (
        "(昏迷|意识不清|意识模糊|叫不醒|抽搐|抽风|晕厥|晕倒|休克)", "(突然|突发|剧烈|炸裂|雷击样).{0,6}头痛", "(头痛|头疼).{0,3}欲裂", "头痛.{0,8}(呕吐|看不清|视物模糊|脖子硬|颈部僵硬)",
    )),
    Rule("bleeding", "emergency", ("(呕血|吐血|咯血|咳出血|大出血|血流不止|止不住血)", "(黑便|柏油样便|血便|便血|大便带血)", "(阴道大出血|经期大出血|出血不止)")),
    Rule("anaphylaxis", "emergency", ("(喉咙|喉头|嗓子).{0,4}(发紧|紧缩|堵|肿胀)", "(皮疹|风团|荨麻疹|全身痒).{0,10}(呼吸困难|喘不上气|喉|头晕|胸闷)")),
    Rule("abdominal", "emergency", ("(肚子|腹部|腹痛).{0,10}(剧痛|剧烈|疼得直不起|疼得打滚|拒按|硬邦邦|板状)",)),
    Rule("sepsis_meningitis", "emergency", ("(高烧|高热|发烧|发热).{0,10}(脖子硬|颈部僵硬|皮疹|瘀点|瘀斑|意识|抽搐|叫不醒|寒战)",)),
    Rule("pregnancy_emergency", "emergency", ("(怀孕|孕妇|孕期|妊娠|产后|哺乳期).{0,16}(剧烈腹痛|肚子疼|阴道出血|大出血|看不见|看不清|剧烈头痛|胎动)",)),
    Rule("trauma_poison", "emergency", ("(误服|吃错药|喝农药|中毒|一氧化碳)", "(头.{0,3}(撞|摔|磕|碰)).{0,12}(呕吐|意识|晕|叫不醒|头痛)", "(骨折|骨头.{0,4}(露|戳))")),
    Rule("fever_duration", "high", ("(发烧|发热|高烧).{0,12}(三天|3天|四天|4天|五天|5天|一周|七天|7天)",)),
    Rule("weight_loss", "high", ("体重.{0,6}(下降|减轻|变轻|往下掉|掉得)",)),
    Rule("cough_long", "high", ("咳嗽.{0,10}(三周|3周|一个月|四周|4周)", "(痰|咳).{0,4}带血")),
    Rule("leg_swelling", "high", ("(小腿|腿).{0,6}(肿|胀).{0,6}(疼|痛)", "(小腿|腿).{0,6}(疼|痛).{0,6}(肿|胀)")),
    Rule("mass", "high", ("(肿块|疙瘩|淋巴结).{0,8}(变大|增大|新出现|长出来)",)),
    Rule("dehydration", "high", ("(呕吐|腹泻|拉肚子|拉稀).{0,12}(口渴|尿少|没尿|脱水|乏力|站不起来)",)),
)
SELF_HARM = (
    ("(想死|不想活|活不下去|活着没意思|活着没意义|活够了|一了百了)", "自伤念头表达"),
    ("(自杀|轻生|割腕|跳楼|结束(自己的)?(生命|一生)|伤害自己|自残|自伤)", "自伤相关表达"),
    ("(杀了?自己|弄死自己)", "自伤相关表达"),
    ("(杀(了|掉)?(他|她|别人)|弄死(他|她)|报复社会|同归于尽)", "伤人相关表达"),
)
FIRST_TURN = (
    ("psych", "精神心理专项", "(精神病|精神分裂|分裂症|双相|躁郁|抑郁症|抑郁发作|焦虑症|强迫症|妄想|幻觉)"),
    ("child", "儿童症状", "(孩子|小孩|儿童|宝宝|婴儿|幼儿|闺女|儿子|女儿).{0,12}(发烧|发热|咳嗽|喘|呕吐|吐了|腹泻|拉肚子|出疹|起疹|抽搐|哭闹|不吃|烫伤|磕|摔)"),
    ("pregnancy", "孕产专项", "(怀孕|孕妇|孕期|妊娠期|哺乳期|产后).{0,14}(腹痛|肚子疼|出血|头痛|发烧|发热|呕吐|恶心|不适|头晕|心慌)"),
)
NEGATIONS = ("不疼", "不痛", "不闷", "没疼", "没有疼", "没有压榨", "没有出汗", "没出汗", "不再", "已经不", "未出现", "没有出现")
# What a reply may not say, and the words that make a mention harmless.
DIAGNOSIS = ("(你|您)得了", "(你|您)(得|患)的是", "(你|您)(就是|肯定是|一定是)(得|患)?", "确诊为", "诊断为")
DRUGS = (
    "布洛芬", "对乙酰氨基酚", "阿司匹林", "阿莫西林", "头孢", "左氧氟沙星", "莫西沙星", "甲硝唑", "奥美拉唑", "蒙脱石散", "氯雷他定",
    "西替利嗪", "硝酸甘油", "速效救心丸", "开塞露", "泼尼松", "地塞米松", "强的松", "退烧药", "消炎药", "抗生素", "安眠药",
)
MEDICATION = (
    r"[0-9]+(\.[0-9]+)?\s*(mg|毫克|微克|μg|ug|g|克|片|粒|ml|毫升|滴|IU|iu|单位)",
    r"(每天|每日|一日|每次|一天)\s*(吃|服|用|喷|滴|喝)\s*[0-9]",
    "(建议|可以|应该|不妨|试试|吃点|喝点|服用|口服)[^。！？；\\n]{0,14}?(" + "|".join(DRUGS) + ")",
    r"(停(用|掉|药)|不用再吃|先别吃|减量|加量)[^。！？；\n]{0,10}(他汀|降压|降糖|胰岛素|药)",
)
ABSOLUTES = ("一定能(好|治好)?", "肯定能(好|治好)?", "肯定(没事|没问题)", "绝对(没事|不会有事|没问题)", "包治", "保证(治好|能治好)", "百分之百")
SELF_HARM_ECHO = ("自杀", "轻生", "不想活", "活着没意思", "活不下去", "结束生命", "伤害自己", "自残")
UNSUPPORTED = "(根据|依据|据)(相关|现有的)?(资料|文献|研究|指南)"
GUARD = "(?s)(?<![不没未别勿否说问称].{0,5}|(?:提到|认为|觉得|怀疑|担心|自称).{0,4})"
CARE_WORDS = ("就医", "就诊", "医院", "面诊", "复查", "急诊", "120")
URGENT_WORDS = ("急诊", "120", "急救")
ADVICE = "建议尽快到医院就诊评估（如症状加重请立即急诊）。"
CONTINUE = "抱歉，我需要再确认一下：请告诉我您最主要的不适和持续时间，我来帮您梳理。"
FROM_DIALOGUE = "结合您描述的情况"
REWRITES = (
    ("绝对不会有事", "可能性较低（但不能完全排除）"),
    ("肯定没事", "暂时没有发现需要紧急处理的信号（但无法完全排除其他可能）"),
    ("绝对没事", "风险看起来较低（但不能完全排除）"),
    ("一定能治好", "配合规范治疗有机会好转"),
    ("一定能好", "配合治疗有机会好转"),
    ("肯定能好", "配合治疗有机会好转"),
    ("保证治好", "无法保证结果，需要规范治疗"),
    ("包治", "需要规范治疗"),
    ("百分之百", "很难做到完全保证"),
)


def flat(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def leads(pattern: str) -> str | None:
    """The characters that a match may begin with, where all of the pattern's options begin with plain ones; else null."""
    tokens = re.findall(r"\\.|\[\^?.[^\]]*\]|.", pattern, re.DOTALL)
    if "(?" in pattern or r"\Q" in pattern or "&&" in pattern:
        return None
    depth, options = 0, [[]]
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "|" and depth == 0:
            options.append([])
        else:
            options[-1].append(t)
    found: set[str] = set()
    for option in options:
        first, after = option[:1], option[1:2]
        if first == ["("]:
            depth, end = 1, 1
            while depth and end < len(option):
                depth += (option[end] == "(") - (option[end] == ")")
                end += 1
            within, after = leads("".join(option[1 : end - 1])), option[end : end + 1]
        else:
            within = first[0] if first and first[0].isalnum() else None
        if not within or after and after[0] in "?*{":
            return None
        found |= set(within)
    return "".join(sorted(found))


def sought(pattern: str) -> str:
    """The pattern behind a look at the one character that it may begin with, so that its options are not tried at all others."""
    found = leads(pattern)
    return f"(?=[{found}])(?:{pattern})" if found else pattern


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """What the first pattern that matches has matched, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns))


def _from_first(plain: Column, patterns: Sequence[str]) -> Column:
    """The text from the first character that lies between those that the patterns may begin with: no match begins before it."""
    found = [leads(p) for p in patterns]
    if not found or None in found:
        return plain
    letters = "".join(found)
    return F.regexp_extract(plain, f"(?s)[{min(letters)}-{max(letters)}].*", 0)


def rule_hits(text: Column, rules: Sequence[Rule] = RED_FLAGS) -> Column:
    """Array of struct(rule_id, level, matched), one for each rule that fits, in the rules' order."""
    hits = lambda plain: [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"), first_match(plain, [sought(p) for p in r.patterns]).alias("matched")) for r in rules]
    plain = _from_first(flat(text), [p for r in rules for p in r.patterns])
    return F.filter(let(plain, lambda x: F.array(*hits(x))), lambda h: h["matched"].isNotNull())


def _stands(plain: Column, pattern: str) -> Column:
    """The first match, or null if a negation touches it or the four characters before it."""

    def told(found: Column) -> Column:
        at = F.instr(plain, found)
        near = F.substring(plain, F.greatest(F.lit(1), at - 4), F.length(found) + F.least(F.lit(4), at - 1))
        return F.when((found != "") & ~near.rlike("|".join(NEGATIONS)), found)

    return let(F.regexp_extract(plain, sought(pattern), 0), told)


def prescan(text: Column, first_turn: Column) -> Column:
    """struct(kind, rule_id, matched) of the first hit: self-harm, then urgent rules, then (first turn only) what is out of scope."""
    shape = "struct<kind:string,rule_id:string,matched:string>"

    def options(plain: Column) -> list[Column]:
        def hit(kind: str, rule_id: str, pattern: str, also: Column | None = None) -> Column:
            found = _stands(plain, pattern) if also is None else F.when(also, _stands(plain, pattern))
            return let(found, lambda x: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(rule_id).alias("rule_id"), x.alias("matched")).cast(shape)))

        found = [hit("self_harm", f"self_harm:{label}", p) for p, label in SELF_HARM]
        found += [hit("emergency", r.rule_id, p) for r in RED_FLAGS if r.level == "emergency" for p in r.patterns]
        return found + [hit(kind, f"{kind}:{label}", p, first_turn) for kind, label, p in FIRST_TURN]

    return let(flat(text), lambda plain: F.coalesce(*options(plain)))


def route(kind: Column) -> Column:
    """struct(risk_level, handled_as, template, confidence) of a pre-scan hit; null without one."""
    urgent, scope = kind.isin("self_harm", "emergency"), kind.isin("psych", "child", "pregnancy")
    return F.when(
        urgent | scope,
        F.struct(
            F.when(urgent, "emergency").otherwise("medium").alias("risk_level"),
            F.when(urgent, "emergency").otherwise("out_of_scope").alias("handled_as"),
            F.when(urgent, kind).otherwise("out_of_scope").alias("template"),
            F.lit("low").alias("confidence"),
        ),
    )


def behind_guard(pattern: str) -> str:
    """The pattern where neither a negation nor reported speech precedes it; what precedes is looked at only where the pattern fits."""
    if re.search(r"\\[1-9k]|\(\?P?<[A-Za-z]", pattern):  # groups that are referred to cannot stand twice
        return GUARD + pattern
    found = leads(pattern)
    flags, before = GUARD[:4], GUARD[4:]
    return f"{flags}(?=[{found}]){before}{pattern}" if found else f"{flags}(?={pattern}){before}{pattern}"


def guarded(text: Column, patterns: Sequence[str]) -> Column:
    """The first match that neither a negation nor reported speech precedes, or null."""
    return first_match(text, [behind_guard(p) for p in patterns])


def has_care_word(text: Column, words: Sequence[str] = CARE_WORDS) -> Column:
    return text.rlike("|".join(words))


def violations(reply: Column, hypotheses: Column, confidence: Column, bad_refs: Column, retrieved: Column, red_flags: Column, risk: Column, steps: Column, closing: Column) -> Column:
    """Codes of all findings in a reply, in the order of the checks; arrays may be empty but not null."""
    advice = F.array_join(steps, "；")
    weak = (F.size(red_flags) > 0) & ~(risk.isin("high", "emergency") & has_care_word(F.concat(reply, F.lit("；"), advice), CARE_WORDS + URGENT_WORDS))
    checks = [
        ("empty_reply", strip(F.coalesce(reply, F.lit(""))) == ""),
        ("empty_hypotheses", (F.size(hypotheses) == 0) & (confidence != "low")),
        ("diagnosis_language", guarded(reply, DIAGNOSIS).isNotNull()),
        ("medication_recommendation", guarded(reply, MEDICATION).isNotNull()),
        ("absolutist_claim", guarded(reply, ABSOLUTES).isNotNull()),
        ("fabricated_citation", F.size(bad_refs) > 0),
        ("unsupported_reference", (F.size(bad_refs) == 0) & (F.size(retrieved) == 0) & reply.rlike(UNSUPPORTED)),
        ("red_flag_escalation", weak),
        ("closing_confidence_cap", closing & (confidence == "high")),
        ("closing_advice_missing", confidence.isin("medium", "high") & ~has_care_word(advice)),
        ("self_harm_echo", guarded(reply, SELF_HARM_ECHO).isNotNull()),
    ]
    return F.array_compact(F.array(*(F.when(fits, code) for code, fits in checks)))


#: Findings that the model is first asked to mend; the others are mended at once.
FIXED_BY_MODEL = ("empty_reply", "empty_hypotheses", "diagnosis_language", "medication_recommendation", "absolutist_claim", "unsupported_reference")
_REVIEWED = ("reply", "hypotheses", "evidence", "confidence", "risk_level", "next_steps")


def _findings(rows: DataFrame) -> DataFrame:
    """``bad_refs`` (cited chunks that were not retrieved) and ``codes`` of the rows as they are."""
    refs = F.transform(F.filter("evidence", lambda e: e["source"] == "kb"), lambda e: e["ref"])
    rows = rows.withColumn("bad_refs", F.array_except(refs, F.col("retrieved")))
    given = ("reply", "hypotheses", "confidence", "bad_refs", "retrieved", "red_flags", "risk_level", "next_steps", "closing")
    return rows.withColumn("codes", let(F.struct(*given), lambda x: violations(*(x[c] for c in given))))  # so that the patterns are no generated code


def review(rows: DataFrame, templates: Mapping[str, str], fix: Callable[[DataFrame], DataFrame] | None = None, extra: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Replies as they go out, with ``action`` (pass, fix, degrade or replace) and ``codes`` (what was found at first).

    Rows: id, reply, hypotheses, evidence (source, ref, detail), retrieved,
    confidence, red_flags, risk_level, next_steps, closing.  First ``fix``, if
    given, gets the rows with a finding it can mend and returns those it did
    (id and the reviewed columns).  What can be mended by rule is, then the
    rows are checked again and what the model left is replaced.  ``extra``
    gives more findings, (id, more array<string>), which are only reported.
    """
    fixable = F.array(*map(F.lit, FIXED_BY_MODEL))
    state = stage(_findings(rows).withColumn("found", F.col("codes")).withColumn("fixed", F.lit(False)), "found")
    if fix is not None:
        mended = fix(state.where(F.arrays_overlap("codes", fixable))).select("id", F.struct(*_REVIEWED).alias("m"))
        state = state.join(mended, "id", "left").withColumn("fixed", F.col("m").isNotNull())
        state = state.withColumns({c: F.when(F.col("fixed"), F.col(f"m.{c}")).otherwise(F.col(c)) for c in _REVIEWED}).drop("m")
    if fix is not None:  # each check is compiled once: nested in each other the patterns would be too much code
        state = stage(_findings(state.drop("codes", "bad_refs")), "found")
    has = lambda code: F.array_contains("codes", code)
    advised = lambda when: F.when(when & ~has_care_word(F.array_join("next_steps", "；")), F.concat(F.array(F.lit(ADVICE)), "next_steps")).otherwise(F.col("next_steps"))
    kept = F.filter("evidence", lambda e: (e["source"] != "kb") | ~F.array_contains("bad_refs", e["ref"]))
    suffix = templates.get("self_harm_suffix", "")
    with_suffix = F.concat(F.regexp_replace("reply", r"(?U)\s+$", ""), F.lit("\n\n" + suffix))
    state = state.withColumns(
        {
            "degraded": F.size(F.array_except("codes", fixable)) > 0,
            "risk_level": F.when(has("red_flag_escalation") & ~F.col("risk_level").isin("high", "emergency"), "high").otherwise(F.col("risk_level")),
            "next_steps": advised(has("red_flag_escalation") | has("closing_advice_missing")),
            "evidence": F.when(has("fabricated_citation"), kept).otherwise(F.col("evidence")),
            "confidence": F.when(has("closing_confidence_cap"), "medium").otherwise(F.col("confidence")),
            "reply": F.when(has("self_harm_echo") & F.lit(suffix != "") & ~F.contains("reply", F.lit(suffix)), with_suffix).otherwise(F.col("reply")),
        }
    )
    state = stage(_findings(state.drop("codes", "bad_refs")), "mended")
    refused = has("diagnosis_language") | has("medication_recommendation")
    refuse = templates.get("refuse", "")
    # In the order of the checks: a refusal takes the place of the reply, then promises are softened and references reworded.
    reply = F.when(has("empty_reply"), F.lit(CONTINUE)).otherwise(F.col("reply"))
    reply = F.when(refused, F.lit(refuse)).otherwise(reply) if refuse else reply
    reply = F.when(has("absolutist_claim"), soften(reply)).otherwise(reply)
    reply = F.when(has("unsupported_reference"), F.regexp_replace(reply, UNSUPPORTED, FROM_DIALOGUE)).otherwise(reply)
    left = F.arrays_overlap("codes", fixable)
    state = state.withColumns(
        {
            "action": F.when(refused | has("empty_reply"), "replace").when(F.col("fixed"), "fix").when(F.col("degraded") | left, "degrade").otherwise("pass"),
            "reply": reply,
            "next_steps": advised(refused | has("empty_hypotheses")),
            "confidence": F.when(has("empty_hypotheses"), "low").otherwise(F.col("confidence")),
        }
    )
    done = state.select("id", *_REVIEWED, "action", F.col("found").alias("codes"))
    if extra is None:
        return done
    return done.join(extra(rows).select("id", "more"), "id", "left").withColumn("codes", F.concat("codes", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def action(codes: Column) -> Column:
    """replace before degrade before pass: what an output becomes if the model does not mend it."""
    has = lambda *names: F.arrays_overlap(codes, F.array(*map(F.lit, names)))
    return F.when(has("empty_reply", "diagnosis_language", "medication_recommendation"), "replace").when(F.size(codes) > 0, "degrade").otherwise("pass")


def soften(reply: Column) -> Column:
    """Absolute promises replaced, one after the other."""
    for old, new in REWRITES:
        reply = F.replace(reply, F.lit(old), F.lit(new))
    return reply
