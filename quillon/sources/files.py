"""Files in: registries, JSON lines, texts, DOCX and XML; tables out, a version at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions.text import strip
from quillon.streaming.progress import current, publish

__all__ = ["current", "docx_texts", "json_lines", "publish", "read_registry", "read_texts", "registry_errors", "strict", "xml_articles"]

REGISTRY_FIELDS = ("file", "doc_id", "name", "version", "category", "source_type", "url", "note", "license", "language", "tier")
RECORD_ERROR = "bad JSON in line "


def read_registry(spark: SparkSession, path: str, yaml_text: str | None = None) -> DataFrame:
    """The ``files`` of a YAML registry: every field a stripped string, empty if it lacks, the name that of the file."""
    import yaml

    text = yaml_text if yaml_text is not None else "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    rows = (yaml.safe_load(text) or {}).get("files")
    if not rows or not all(isinstance(r, dict) for r in rows):
        raise ValueError("the registry needs a list of files, each a mapping")
    clean = [{f: str(r.get(f) or "").strip() for f in REGISTRY_FIELDS} for r in rows]
    for r in clean:
        r["name"] = r["name"] or re.sub(r"\.[^.]*$", "", r["file"].rsplit("/", 1)[-1])
    return spark.createDataFrame([tuple(r[f] for f in REGISTRY_FIELDS) for r in clean], ", ".join(f"{f} string" for f in REGISTRY_FIELDS))


def registry_errors(registry: DataFrame) -> DataFrame:
    """(error, value, n): blank or repeated files and ids."""
    twice = [registry.where(f"{c} <> ''").groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate {c}").alias("error"), "value", "n") for c in ("file", "doc_id")]
    blank = registry.where("file = '' or doc_id = ''").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("blank field").alias("error"), F.lit("").alias("value"), "n")
    return twice[0].unionByName(twice[1]).unionByName(blank)


def json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines that are neither blank nor comments, with ``record``: the parsed object, or null if it is none."""
    plain = strip(F.col(column))
    full = lines.where((plain != "") & ~plain.startswith("#"))
    return full.withColumn("record", F.when(F.try_parse_json(column).isNotNull(), F.from_json(column, schema)))


def strict(lines: DataFrame, schema: str, column: str = "value", line: str = "line") -> DataFrame:
    """As ``json_lines``, but a bad line fails the query and names its number."""
    rows = json_lines(lines, schema, column)
    message = F.concat(F.lit(RECORD_ERROR), F.col(line).cast("string"))
    return rows.withColumn("record", F.when(F.col("record").isNull(), F.raise_error(message).cast(rows.schema["record"].dataType)).otherwise(F.col("record")))


def read_texts(spark: SparkSession, path: str, suffixes: Sequence[str] = (".md", ".markdown", ".txt")) -> DataFrame:
    """(path, text, sha1, error) of the text files under ``path``; bytes that are not UTF-8 become the replacement mark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.where(known.isin(*suffixes)).select("path", F.coalesce(text, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.sha1("content").alias("sha1"))
    return rows.withColumn("error", F.when(strip(F.col("text")) == "", "empty file"))


_TEXT, _ROW, _CELL, _PARAGRAPH = (f"{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}{x}" for x in ("t", "tr", "tc", "p"))


def docx_text(content: bytes) -> str:
    """A line for each paragraph, and for each table row with its cells between bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        root = ElementTree.fromstring(box.read("word/document.xml"))
    said = lambda node: "".join(t.text or "" for t in node.iter(_TEXT)).strip()
    lines: list[str] = []

    def walk(node) -> None:
        for child in node:
            if child.tag == _ROW:
                lines.append(" | ".join(x for c in child.iter(_CELL) if (x := said(c))))
            elif child.tag == _PARAGRAPH:
                lines.append(said(child))
            else:
                walk(child)

    walk(root)
    return "\n".join(x for x in lines if x)


def docx_texts(files: DataFrame, column: str = "content") -> DataFrame:
    """``files`` with text and error; a file that cannot be read has the error's text."""

    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for content in contents:
            try:
                out.append((docx_text(bytes(content)), None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as error:
                out.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.withColumn("_r", F.pandas_udf(run, "text string, error string")(column)).select("*", "_r.text", "_r.error").drop("_r")


def article_markdown(xml: str) -> tuple[str | None, str | None]:
    """Title and Markdown of a journal article: abstract, then sections with their headings, one level of nesting."""
    try:
        root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", xml))
    except (ElementTree.ParseError, TypeError):
        return None, None
    said = lambda node: re.sub(r"\s+", " ", unescape("".join(node.itertext()))).strip() if node is not None else ""
    title = said(root.find(".//article-title"))
    out = [f"# {title}"]
    if (abstract := root.find(".//abstract")) is not None:
        out += ["## Abstract", *(said(p) for p in abstract.iter("p"))]
    body = root.find(".//body")
    for section in body.findall("sec") if body is not None else []:
        out.append(f"## {said(section.find('title'))}")
        for child in section:
            if child.tag == "p":
                out.append(said(child))
            elif child.tag == "sec":
                out += [f"### {said(child.find('title'))}", *(said(p) for p in child.findall("p"))]
    return title, "\n\n".join(x for x in out if x.strip("# "))


def xml_articles(rows: DataFrame, column: str = "xml") -> DataFrame:
    """``rows`` with title and markdown; null where the XML is not well formed."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article_markdown(x) for x in texts], columns=["title", "markdown"])

    return rows.withColumn("_r", F.pandas_udf(run, "title string, markdown string")(column)).select("*", "_r.title", "_r.markdown").drop("_r")
