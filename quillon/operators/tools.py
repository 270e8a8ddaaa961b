"""Small clinical tools as columns: body-mass index, units, timelines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Units and their factors to metre and kilogram, other names, days per unit of time, words for days.
LENGTHS = {"mm": 0.001, "毫米": 0.001, "cm": 0.01, "厘米": 0.01, "m": 1.0, "米": 1.0, "km": 1000.0, "千米": 1000.0, "inch": 0.0254, "in": 0.0254, "英寸": 0.0254, "ft": 0.3048, "foot": 0.3048, "英尺": 0.3048}
WEIGHTS = {"kg": 1.0, "千克": 1.0, "公斤": 1.0, "g": 0.001, "克": 0.001, "斤": 0.5, "lb": 0.45359237, "磅": 0.45359237}
VOLUMES = ("ml", "毫升", "l", "升", "cc")
ALIASES = {"°c": "c", "℃": "c", "摄氏度": "c", "摄氏": "c", "°f": "f", "℉": "f", "华氏度": "f", "华氏": "f"}
TIME_UNITS = {"小时": 1 / 24, "天": 1.0, "日": 1.0, "周": 7.0, "星期": 7.0, "个月": 30.0, "月": 30.0, "年": 365.0}
DAY_WORDS = {"今天": 0.0, "昨天": 1.0, "前天": 2.0, "大前天": 3.0, "上周": 7.0, "上个月": 30.0}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    """struct(bmi, class); null outside 2-500 kg and 100-250 cm."""
    fits = weight_kg.between(2, 500) & height_cm.between(100, 250)
    value = F.round(weight_kg / F.pow(height_cm / 100, 2), 1)
    exact = weight_kg / F.pow(height_cm / 100, 2)
    name = F.when(exact < 18.5, "偏瘦").when(exact < 24, "正常").when(exact < 28, "超重").otherwise("肥胖")
    return F.struct(F.when(fits, value).alias("bmi"), F.when(fits, name).alias("class"))


def unit(name: Column) -> Column:
    plain = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit(""))
    return F.coalesce(F.try_element_at(_map(ALIASES), plain), plain)


def convert(value: Column, source: Column, target: Column) -> Column:
    """struct(result, status): ok, same, refused (mass to volume or back: doses) or unsupported."""
    s, t = unit(source), unit(target)
    factors = {**{k: ("length", v) for k, v in LENGTHS.items()}, **{k: ("mass", v) for k, v in WEIGHTS.items()}}
    kinds, ratio = _map({k: v[0] for k, v in factors.items()}), _map({k: v[1] for k, v in factors.items()})
    mass = lambda x: x.isin(*WEIGHTS)
    volume = lambda x: x.isin(*VOLUMES)
    degrees = s.isin("c", "f") & t.isin("c", "f")
    refused = (mass(s) & volume(t)) | (volume(s) & mass(t))
    alike = F.try_element_at(kinds, s) == F.try_element_at(kinds, t)
    result = (
        F.when(s == t, value)
        .when(degrees, F.round(F.when(s == "c", value * 9 / 5 + 32).otherwise((value - 32) * 5 / 9), 1))
        .when(alike, value * F.try_element_at(ratio, s) / F.try_element_at(ratio, t))
    )
    status = F.when(s == t, "same").when(degrees, "ok").when(refused, "refused").when(F.coalesce(alike, F.lit(False)), "ok").otherwise("unsupported")
    return F.struct(result.alias("result"), status.alias("status"))


def days_ago(text: Column, today: Column) -> Column:
    """Days before ``today``: a written date, else a number of units ago, else the first known word (in their fixed order)."""
    date = r"([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?"
    parts = [F.regexp_extract(text, date, i) for i in (1, 2, 3)]
    written = F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d")
    ago = r"([0-9]+)\s*(小时|天|日|周|星期|个月|月|年)\s*前"
    count, per = F.regexp_extract(text, ago, 1), F.try_element_at(_map(TIME_UNITS), F.regexp_extract(text, ago, 2))
    words = F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(d)) for w, d in DAY_WORDS.items()))
    return F.when(parts[0] != "", F.datediff(today, written).cast("double")).when(count != "", count.try_cast("double") * per).otherwise(words)
