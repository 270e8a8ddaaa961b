"""From raw pages to documents: cleaning, gates, structure, audits."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.text import let, strip
from quillon.operators.maintenance import fingerprint

# The entities that occur in the pages, in the order they are replaced.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&#39;", "'"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def norm_text(text: Column) -> Column:
    """Line ends, entities, blanks and blank lines made uniform; every line stripped."""
    text = unescape(F.regexp_replace(text, "\r\n?", "\n"))
    text = F.regexp_replace(text, "[ \t\u3000\u00a0]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return strip(text)


def strip_tags(html: Column) -> Column:
    """Text of a fragment: scripts and styles dropped, block ends as line ends, list items marked."""
    text = html
    for tag in ("script", "style", "noscript"):
        text = F.regexp_replace(text, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</(p|div|li|h[1-6]|tr|table|section|article)>", "\n")
    text = F.regexp_replace(text, r"(?i)<li[^>]*>", "\n· ")
    return norm_text(F.regexp_replace(text, "<[^>]+>", ""))


def html_title(html: Column) -> Column:
    return strip(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def clean_title(raw: Column, suffixes: Sequence[str], times: int = 3) -> Column:
    """Without up to ``times`` site names that follow a bar or an underscore."""
    title = strip_tags(raw)
    for _ in range(times):
        title = F.regexp_replace(title, rf"\s*[_|｜]\s*({'|'.join(suffixes)})\s*$", "")
    return F.regexp_replace(title, "^[ _|｜]+|[ _|｜]+$", "")


# Opening tags of what holds a page's text, in the order they are looked for, and the name of each tag.
CONTAINERS = (
    ('<div[^>]+id="UCAP-CONTENT"[^>]*>', "div"),
    ('<div[^>]+class="[^"]*Article_content[^"]*"[^>]*>', "div"),
    ('<div[^>]+class="[^"]*trout-region-content[^"]*"[^>]*>', "div"),
    ('<div[^>]+class="[^"]*TRS_Editor[^"]*"[^>]*>', "div"),
    ('<div[^>]+id="zoom"[^>]*>', "div"),
    ("<article[^>]*>", "article"),
)


def balanced(html: Column, opening: str, tag: str) -> Column:
    """From the first match of ``opening`` to before the closing tag that pairs with it, or to the end if none does; null without a match.

    The rest of the page is cut at every opening and closing tag of that name,
    and a fold over the pieces counts the depth; so containers may be nested.
    """
    start = F.regexp_instr(html, F.lit(f"(?i){opening}"))

    def paired(rest: Column) -> Column:
        pieces = F.split(rest, rf"(?i)(?=</?{tag}\b)")
        step = lambda piece: F.when(F.substring(piece, 1, 2) == "</", -1).otherwise(1)

        def fold(done: Column, piece: Column) -> Column:
            depth = F.when(done["depth"] == 0, 0).otherwise(F.greatest(done["depth"], F.lit(0)) + step(piece))
            return F.struct(depth.alias("depth"), (done["size"] + F.when(depth == 0, 0).otherwise(F.length(piece))).alias("size"))

        # depth -1 is that before the first piece, which is the opening tag; 0 ends the count
        return F.substr(rest, F.lit(1), F.aggregate(pieces, F.struct(F.lit(-1).alias("depth"), F.lit(0).alias("size")), fold)["size"])

    return F.when(start > 0, let(F.substr(html, start), paired))


def html_body(html: Column, containers: Sequence[tuple[str, str]] = CONTAINERS, least: int = 200, require_container: bool = True) -> Column:
    """Text of the first container, in their order, that has ``least`` characters of it; else empty, or the text of the whole page."""
    text = lambda opening, tag: let(strip_tags(balanced(html, opening, tag)), lambda t: F.when(F.length(t) >= least, t))
    return F.coalesce(*(text(*c) for c in containers), F.lit("") if require_container else strip_tags(html))


def slug(text: Column, most: int = 40) -> Column:
    name = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(name, 1, most), "_+$", ""), F.lit("")), F.lit("doc"))


def count_keywords(text: Column, words: Sequence[str], weight: int = 1) -> Column:
    """How many of the words occur, times the weight."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.contains(text, F.lit(w)), weight).otherwise(0)
    return total


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def relevance(title: Column, body: Column, strong: Sequence[str], extra: Sequence[str]) -> Column:
    """3 for each strong word in the title, 1 in the head of the body; 2 or else 1 for each extra word."""
    head = F.substring(body, 1, 1500)
    score = count_keywords(title, strong, 3) + count_keywords(head, strong)
    for w in extra:
        score = score + F.when(F.contains(title, F.lit(w)), 2).when(F.contains(head, F.lit(w)), 1).otherwise(0)
    return score


def gate(title: Column, body: Column, noise: str, topics: Sequence[str], score: Column, least_body: int = 400, threshold: int = 4, subjects: Sequence[str] | None = None, body_head: int = 0) -> Column:
    """The first reason against a page, or null if it passes.

    ``noise`` may not be in the title, nor in the first ``body_head``
    characters of the text; one of ``topics`` must be in the title, and one of
    ``subjects`` if they are given.
    """
    found = F.regexp_extract(title, f"({noise})", 1)
    told = F.when(F.coalesce(title, F.lit("")) == "", "empty title").when(found != "", F.concat(F.lit("noise: "), found))
    if body_head:
        head = F.regexp_extract(F.substring(body, 1, body_head), f"({noise})", 1)
        told = told.when(head != "", F.concat(F.lit("noise in text: "), head))
    told = told.when(~contains_any(title, topics), "off topic")
    if subjects is not None:
        told = told.when(~contains_any(title, subjects), "off subject")
    return told.when(F.length(body) < least_body, "short body").when(score < threshold, F.concat(F.lit("score "), score.cast("string")))


# Suffixes of files of text, those that may be pages, and what the beginning of an error page has.
TEXT_SUFFIXES, PAGE_SUFFIXES = ("json", "jsonl", "xml", "csv", "txt", "md", "html", "htm"), ("html", "htm")
ERROR_MARKS = ("<html", "<!doctype html", "access denied", "403 forbidden", "404 not found", "<error>", "no such file")


def _well_formed(texts: pd.Series) -> pd.Series:
    def parses(text: str | None) -> bool:
        try:
            return text is None or ElementTree.fromstring(text.lstrip("\ufeff \t\r\n").encode()) is not None
        except ElementTree.ParseError:
            return False

    return texts.map(parses)


def file_problem(path: Column, content: Column) -> Column:
    """What is wrong with a fetched file, or null: missing, empty, an error page, or broken XML. Only files of text are looked into."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    head = F.lower(F.substring(F.regexp_replace(content, r"^\s+", ""), 1, 200))
    mark = F.coalesce(*(F.when(F.contains(head, F.lit(m)), m) for m in ERROR_MARKS))
    xml = suffix == "xml"
    broken = ~F.pandas_udf(_well_formed, "boolean")(F.when(xml, content))
    return (
        F.when(content.isNull(), "missing").when(F.length(content) == 0, "empty").when(~suffix.isin(*TEXT_SUFFIXES), None)
        .when(mark.isNotNull() & ~suffix.isin(*PAGE_SUFFIXES), F.concat(F.lit("error page: "), mark)).when(xml & broken, "broken XML")
    )


def audit(registry: DataFrame, files: DataFrame) -> DataFrame:
    """(local_path, size, problem) of the registered files: registry (local_path, status), files (local_path, content).

    A file that is not there is a problem only if its row says that it was
    fetched (status ``ok``); other absent ones are left out.
    """
    found = files.select(F.col("local_path").alias("of"), "content", F.lit(True).alias("there"))
    rows = registry.join(found, F.col("local_path") == F.col("of"), "left").where("there or status = 'ok'")
    return rows.select("local_path", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size"), file_problem(F.col("local_path"), F.col("content")).alias("problem"))


# Short labels of licences, each with the wordings that it stands for, in the order they are looked for; the label of an empty text.
LICENSE_LABELS = (
    (("by-nc",), "CC BY-NC（不可商用）"),
    (("by-sa",), "CC BY-SA"),
    (("by/4.0", "attribution 4.0", "cc by 4"), "CC BY 4.0"),
    (("cc by", "cc-by", "creative commons attribution"), "CC BY"),
)
NO_LICENSE = "CC BY（Europe PMC 仅取开放获取）"
# Marks of clauses and the level of heading that each stands for.
NUMERALS = "[一二三四五六七八九十百零]+"
CLAUSES = ((f"^第{NUMERALS}章", 2), (f"^{NUMERALS}、", 2), (f"^第{NUMERALS}[节条]", 3), (f"^（{NUMERALS}）", 4))
# What a line of a title is, what it is not, and the title of a text without one.
ATTACHMENT, NO_TITLE_END, CONTENTS, NO_TITLE = r"^附件\s*[0-9]*\s*[：:、.]?\s*(.+)$", "[：:。]$", "^(目录|目次)", "默认"


def normalize_license(text: Column) -> Column:
    """One short label for the many wordings of a licence; others as they are, cut to 60 characters."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.coalesce(F.when(low == "", NO_LICENSE), *(F.when(contains_any(low, words), label) for words, label in LICENSE_LABELS), F.substring(norm_text(text), 1, 60)))


def clause_heading(line: Column) -> Column:
    """struct(marker, level) of a line that begins a clause; nulls for others."""
    # Optional, so that other lines fit emptily at their beginning and are not searched to their end.
    found = lambda x: F.array(*(F.struct(F.regexp_extract(x, f"(?:{p})?", 0).alias("marker"), F.lit(n).cast("long").alias("level")) for p, n in CLAUSES))
    first = F.get(F.filter(let(line, found), lambda h: h["marker"] != ""), F.lit(0))
    return let(first, lambda h: F.struct(h["marker"].alias("marker"), h["level"].alias("level")))


def derive_title(text: Column, most: int = 80, looked_at: int = 30) -> Column:
    """What follows an attachment's mark, else the first line that reads like a title, among the first lines."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), 1, looked_at)
    named = lambda rows: F.filter(F.transform(rows, lambda x: F.regexp_extract(x, ATTACHMENT, 1)), lambda x: F.length(x) >= 5)
    plain = lambda rows: F.filter(rows, lambda x: (F.length(x) >= 6) & (F.regexp_count(x, F.lit("[一-鿿]")) >= 5) & ~x.rlike(NO_TITLE_END) & ~x.rlike(CONTENTS))
    return F.substring(let(lines, lambda rows: F.coalesce(F.get(named(rows), F.lit(0)), F.get(plain(rows), F.lit(0)), F.lit(NO_TITLE))), 1, most)


def content_class(content: Column) -> Column:
    """missing, empty, bad (an error page that is not HTML) or ok, from the start of the content."""
    head = F.lower(F.substring(content, 1, 200))
    page = head.rlike("<!doctype html|<html")
    wrong = contains_any(head, ("error", "not found", "forbidden", "access denied"))
    return F.when(content.isNull(), "missing").when(F.length(content) == 0, "empty").when(wrong & ~page, "bad").otherwise("ok")


def merge_sections(sections: Column, least: int = 200) -> Column:
    """Array of struct<head, body> to the same, each section that follows one shorter than ``least`` folded into it."""
    item = "struct<head:string,body:string>"
    start = F.array().cast(f"array<{item}>")

    def fold(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        short = (F.size(done) > 0) & (F.length(F.coalesce(F.get(done, F.size(done) - 1)["body"], F.lit(""))) < least)
        joined = F.struct(last["head"].alias("head"), F.concat(last["body"], F.lit("\n**"), s["head"], F.lit("** "), s["body"]).alias("body"))
        return F.when(short, F.concat(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)), F.array(joined.cast(item)))).otherwise(
            F.concat(done, F.array(F.struct(s["head"].alias("head"), s["body"].alias("body")).cast(item)))
        )

    return F.aggregate(F.filter(sections, lambda s: s["body"] != ""), start, fold)


def rejoin_lines(lines: DataFrame, doc: str, ord_: str, line: str) -> DataFrame:
    """Lines broken within sentences put together: a line begins anew after a sentence mark, and headings stand alone.

    Page numbers and blank lines are dropped first.
    """
    from pyspark.sql import Window

    text = strip(F.col(line))
    heading = (F.length(text) <= 40) & text.rlike("^(附件|第|一、|二、)")
    kept = lines.withColumn(line, text).where((F.col(line) != "") & ~F.col(line).rlike(r"^[—\-–\s]*[0-9]{1,3}[—\-–\s]*$"))
    w = Window.partitionBy(doc).orderBy(ord_)
    kept = kept.withColumn("_head", heading)
    ends = F.lag(F.col(line).rlike("[。；！？：）」』”\"']$")).over(w)
    begins = F.coalesce(ends, F.lit(True)) | F.col("_head")
    blocks = kept.withColumn("block", F.sum(begins.cast("int")).over(w))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(ord_, line))), lambda x: x[line])
    return blocks.groupBy(doc, "block").agg(F.array_join(in_order, "").alias(line)).select(doc, F.col("block").cast("long").alias("block"), line)


def convert(adapters: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """(adapter, id, text) of all adapters, each giving (id, text): blank texts dropped, one of copies kept, of the first adapter, then of the least id.

    Ids are not null and tell an adapter's rows apart.  Texts are not shuffled to find copies, only fingerprints.
    """
    parts = [give().select(F.lit(n).alias("_n"), F.lit(name).alias("adapter"), "id", "text") for n, (name, give) in enumerate(adapters.items())]
    docs = reduce(DataFrame.unionByName, parts).where(strip(F.col("text")) != "")
    first = docs.select("_n", "id", fingerprint(F.col("text")).alias("print")).groupBy("print").agg(F.min(F.struct("_n", "id")).alias("f"))
    kept = first.select(F.col("f._n").alias("_n"), F.col("f.id").alias("id"))
    return docs.join(kept, ["_n", "id"], "left_semi").select("adapter", "id", "text")
