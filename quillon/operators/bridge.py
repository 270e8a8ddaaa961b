"""Reading what a language model wrote: tolerant JSON, tool calls, outputs, stop reasons.

The parsers are plain Python behind Arrow-batched functions, as built-in JSON
functions give up on a text that was cut; everything around them is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

# Names of levels, risks and sources, in either language.
LIKELIHOODS = {"low": "low", "medium": "medium", "high": "high", "低": "low", "中": "medium", "中等": "medium", "高": "high"}
RISKS = {**LIKELIHOODS, "emergency": "emergency", "紧急": "emergency", "急诊": "emergency", "危急": "emergency"}
SOURCES = {"dialogue": "dialogue", "tool": "tool", "kb": "kb", "对话": "dialogue", "问诊": "dialogue", "工具": "tool", "知识库": "kb", "检索": "kb", "资料": "kb"}
PLACEHOLDERS = ("", "未提供", "无", "未知", "none", "null", "n/a", "不适用")
DEFAULT_STEPS = ("如症状加重或出现新的不适，请及时就医",)
DEFAULT_REF = "本轮对话"
DEFAULT_REPLY = "抱歉，本轮我没能整理出可靠的分析。请您再描述一次最主要的症状和持续时间；如果情况较急，请直接就医。"

_SCALAR = re.compile(r'-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null')
_BLANK = re.compile(r"\s*")


class _Cut(Exception):
    """The text ended before the value began."""


class TolerantReader:
    """One JSON value from the start of a text; a value that the end cuts is closed, a key without its value dropped."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _skip(self) -> str:
        self.at = _BLANK.match(self.text, self.at).end()
        return self.text[self.at] if self.at < len(self.text) else ""

    def value(self):
        head = self._skip()
        if head == "{":
            return self._object()
        if head == "[":
            return self._array()
        if head == '"':
            return self._string()
        found = _SCALAR.match(self.text, self.at)
        if not found:
            if not head or self.at + 5 >= len(self.text):
                raise _Cut
            raise ValueError(f"no value at {self.at}")
        self.at = found.end()
        return json.loads(found[0])

    def _string(self) -> str:
        start, at = self.at, self.at + 1
        while at < len(self.text) and self.text[at] != '"':
            at += 2 if self.text[at] == "\\" else 1
        self.at = min(at + 1, len(self.text))
        raw = self.text[start + 1 : min(at, len(self.text))]
        if at >= len(self.text):
            raw = re.sub(r"\\(u[0-9a-fA-F]{0,3})?$", "", raw)
        return json.loads(f'"{raw}"', strict=False)

    def _object(self) -> dict:
        self.at += 1
        out: dict = {}
        while (head := self._skip()) not in ("}", ""):
            if head == ",":
                self.at += 1
                continue
            if head == "{" and not out:  # braces doubled, as in a format template
                out = self._object()
                continue
            if head != '"':
                raise ValueError(f"no key at {self.at}")
            key = self._string()
            if self._skip() != ":":
                if self.at >= len(self.text):
                    break
                raise ValueError(f"no colon at {self.at}")
            self.at += 1
            try:
                out[key] = self.value()
            except _Cut:
                break
        self.at += 1
        return out

    def _array(self) -> list:
        self.at += 1
        out: list = []
        while (head := self._skip()) not in ("]", ""):
            if head == ",":
                self.at += 1
                continue
            try:
                out.append(self.value())
            except _Cut:
                break
        self.at += 1
        return out


def tolerant_json(text: str | None):
    """The first value of a text that begins with one, or None; what follows it is ignored."""
    try:
        return TolerantReader(text or "").value()
    except (ValueError, _Cut, RecursionError):
        return None


def json_objects(text: str | None) -> Iterator[dict]:
    """Every object of a text, in order; those within another are not told again."""
    text, at = text or "", 0
    while (at := text.find("{", at)) >= 0:
        reader = TolerantReader(text)
        reader.at = at
        try:
            value = reader.value()
        except (ValueError, _Cut, RecursionError):
            at += 1
            continue
        yield value
        at = max(reader.at, at + 1)


def tool_call(text: str | None, allowed: Sequence[str] = ()) -> dict | None:
    """name and arguments of the first call that is allowed: two lines TOOL and ARGS, else an object that names a tool."""
    plain = re.sub(r"```(?:json)?", "", text or "")
    told = re.search(r"TOOL\s*[:：]\s*(\w+)\s*[\r\n]+\s*ARGS\s*[:：]\s*", plain)
    candidates = [(told[1], tolerant_json(plain[told.end() :]))] if told else []
    for found in json_objects(plain):
        call = found.get("tool_call") if isinstance(found.get("tool_call"), dict) else found
        arguments = call.get("arguments")
        candidates.append((call.get("name"), tolerant_json(arguments) if isinstance(arguments, str) else arguments))
    for name, arguments in candidates:
        if isinstance(name, str) and isinstance(arguments, dict) and (not allowed or name in allowed):
            return {"name": name, "arguments": arguments}
    return None


def _text(value) -> str:
    return "" if value is None else str(value).strip()


def _texts(value) -> list[str]:
    items = [_text(x) for x in (value if isinstance(value, list) else [value])]
    return [x for x in items if x.lower() not in PLACEHOLDERS]


def _named(value, names: dict[str, str], default: str) -> str:
    raw = _text(value)
    return names.get(raw.lower(), default)


def normalize_output(value: dict | None, draft: str = "") -> dict:
    """An output in full: defaults for what lacks, levels in English, placeholders dropped, hypotheses as objects with a name, evidence with a detail."""
    value = value if isinstance(value, dict) else {}
    told, card = (value.get(k) if isinstance(value.get(k), dict) else {} for k in ("assessment", "case_card"))
    listed = lambda k: told.get(k) if isinstance(told.get(k), list) else []
    guesses = []
    for h in listed("hypotheses"):
        if isinstance(h, str) and h.strip().lower() not in PLACEHOLDERS:
            guesses.append({"name": h.strip(), "likelihood": "low"})
        elif isinstance(h, dict) and _text(h.get("name")):
            guesses.append({"name": _text(h["name"]), "likelihood": _named(h.get("likelihood"), LIKELIHOODS, "low")})
    evidence = [{"source": _named(e.get("source"), SOURCES, "dialogue"), "ref": _text(e.get("ref")) or DEFAULT_REF, "detail": _text(e.get("detail"))} for e in listed("evidence") if isinstance(e, dict) and _text(e.get("detail"))]
    return {
        "reply": _text(value.get("reply")) or draft.strip() or DEFAULT_REPLY,
        "risk_level": _named(value.get("risk_level"), RISKS, "medium"),
        "confidence": _named(told.get("confidence"), LIKELIHOODS, "medium" if guesses else "low"),
        "hypotheses": guesses,
        "evidence": evidence,
        "missing_info": _texts(told.get("missing_info")),
        "next_steps": _texts(told.get("next_steps")) or list(DEFAULT_STEPS),
        "red_flags": _texts(card.get("red_flags_found")),
    }


def _dumped(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def json_column(text: Column) -> Column:
    """The text's first value as canonical JSON, or null."""
    return F.pandas_udf(lambda s: s.map(lambda x: _dumped(tolerant_json(x))), "string")(text)


def objects_column(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: [_dumped(o) for o in json_objects(x)]), "array<string>")(text)


def tool_column(text: Column, allowed: Sequence[str] | Column = ()) -> Column:
    """struct(name, arguments), the arguments as canonical JSON; null without a call. ``allowed``: names, or a column of arrays of them."""
    shape = "name string, arguments string"

    def told(found: list[dict | None]) -> pd.DataFrame:
        return pd.DataFrame({"name": [f and f["name"] for f in found], "arguments": [f and _dumped(f["arguments"]) for f in found]}, dtype=object)

    if isinstance(allowed, Column):
        return F.pandas_udf(lambda s, a: told([tool_call(x, tuple(y)) for x, y in zip(s, a, strict=True)]), shape)(text, allowed)
    names = tuple(allowed)
    return F.pandas_udf(lambda s: told([tool_call(x, names) for x in s]), shape)(text)


def output_column(text: Column, draft: Column) -> Column:
    return F.pandas_udf(lambda s, d: pd.Series([_dumped(normalize_output(next(json_objects(x), None), y or "")) for x, y in zip(s, d, strict=True)]), "string")(text, draft)


def output_errors(reply: Column, risk: Column, confidence: Column, steps: Column) -> Column:
    """Names of the fields that an output may not have as they are."""
    known = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    wrong = [("reply", reply.isNull()), ("risk_level", ~known(risk, set(RISKS.values()))), ("confidence", ~known(confidence, set(LIKELIHOODS.values()))), ("next_steps", F.coalesce(F.size(steps) < 1, F.lit(True)))]
    return F.array_compact(F.array(*(F.when(w, n) for n, w in wrong)))


def enum(value: Column, names: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), value), F.lit(default))


# The marks around a model's thinking.
THINK_START, THINK_END, TEXT_END = "[unused16]", "[unused17]", "[unused10]"


def split_thinking(text: Column) -> Column:
    """struct(thinking, content)."""
    from quillon.functions.text import strip

    has = F.contains(text, F.lit(THINK_END))
    thinking = strip(F.substring_index(F.substring_index(text, THINK_END, 1), THINK_START, -1))
    content = strip(F.substring_index(F.when(has, F.substring_index(text, THINK_END, -1)).otherwise(text), TEXT_END, 1))
    return F.struct(F.when(has, thinking).otherwise("").alias("thinking"), content.alias("content"))


def stop_reason(tokens: Column, think_end: int, budget: Column, ngram: int = 24, window: int = 512) -> Column:
    """think_cap or repeat while still thinking, else null.

    repeat: the last ``ngram`` tokens equal those before them, or occur three
    times in the last ``window``.
    """
    thinking = ~F.array_contains(tokens, think_end)
    seen = F.when(F.size(tokens) > window, F.slice(tokens, -window, window)).otherwise(tokens)
    n = F.size(seen)
    if ngram < 1:
        repeats = F.lit(False)
    else:
        enough = F.size(tokens) >= 3 * ngram
        tail = F.slice(seen, F.greatest(F.lit(1), n - ngram + 1), ngram)
        before = F.slice(seen, F.greatest(F.lit(1), n - 2 * ngram + 1), ngram)
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - ngram + 1))
        repeats = enough & ((before == tail) | (F.size(F.filter(starts, lambda i: F.slice(seen, i, ngram) == tail)) >= 3))
    return F.when(thinking & budget.isNotNull() & (F.size(tokens) >= budget), "think_cap").when(thinking & repeats, "repeat")
