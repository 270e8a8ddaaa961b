"""A published index of chunks and vectors: incremental builds, loading, retrieval."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions.text import strip
from quillon.operators import chunking, maintenance as M, search as S
from quillon.sources import files
from quillon.staging import stage
from quillon.streaming.progress import current, publish_all

CHUNKER_VERSION = "entry-prefix-1"


class IndexMissingError(LookupError):
    """There is no index, or it is empty."""


@dataclass(frozen=True)
class Report:
    n_chunks: int
    n_docs: int
    reused: int
    embedded: int
    removed: int
    file_status: dict[str, int]
    duplicate_ids: int
    seconds: float


def build_chunks(texts: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 600, overlap: int = 80) -> DataFrame:
    """(chunk_id, doc_id, ord, section, text) of documents: headings, then entries, then blocks of ``size``.

    A chunk of a section begins with its title, so that it is found by it.
    """
    named = texts.select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("text"))
    sections = chunking.sections_of(named, "doc_id", "text")
    entries = chunking.entries_of(sections.select(F.struct("doc_id", "section", "path").alias("of"), "body"), "of", "body")
    blocks = entries.select("of.*", "block", "entry", F.col("body").alias("part"))
    path = F.when((F.col("entry") == "") | F.col("path").endswith(F.col("entry")), F.col("path")).otherwise(F.concat_ws(" / ", F.nullif("path", F.lit("")), "entry"))
    blocks = blocks.select("doc_id", F.concat_ws("\u0001", F.lpad("section", 8, "0"), F.lpad("block", 8, "0")).alias("at"), path.alias("title"), "part")
    pieces = chunking.split_blocks(blocks.select(F.struct("doc_id", "at", "title").alias("b"), "part").select(F.to_json("b").alias("b"), "part"), "b", "part", size, overlap)
    cut = pieces.withColumn("b", F.from_json("b", "doc_id string, at string, title string")).select("b.*", "seq", "piece")
    last = F.element_at(F.split("title", " / "), -1)
    prefixed = F.when((last == "") | F.contains("piece", last), F.col("piece")).otherwise(F.concat(last, F.lit("\n"), "piece"))
    rows = cut.select("doc_id", F.concat_ws("\u0001", "at", F.lpad("seq", 8, "0")).alias("ord"), F.col("title").alias("section"), prefixed.alias("text"))
    return M.with_chunk_ids(rows, "doc_id", "text", "ord").select("chunk_id", "doc_id", F.col("seq").alias("ord"), "section", "text")


def build_index(texts: DataFrame, path: str, embed: S.Embed = S.hashed_vectors, model: str = "hashed-16", rebuild: bool = False, doc: str = "doc_id", text: str = "text") -> Report:
    """Builds or brings up to date the index at ``path``, embedding only chunks that are new; chunks and manifest are
    published together in one rename.

    Another model or chunker means a full rebuild, as does ``rebuild``.
    """
    began, spark = time.time(), texts.sparkSession
    chunks = stage(build_chunks(texts, doc, text), "chunks")
    twice = M.duplicates(chunks, ["chunk_id"], "ord").count()
    if twice:
        raise ValueError(f"{twice} chunk ids occur more than once")
    digests = stage(texts.select(F.col(doc).cast("string").alias("doc_id"), F.sha1(text).alias("sha1")), "digests")
    old = None if rebuild else current(spark, path, "chunks")
    if old is not None and old.where((F.col("model") != model) | (F.col("chunker") != CHUNKER_VERSION)).limit(1).count():
        old = None
    manifest = None if rebuild else current(spark, path, "manifest")
    empty = spark.createDataFrame([], "chunk_id string, v array<double>")
    known = old.select("chunk_id", F.col("v").cast("array<double>").alias("v")) if old is not None else empty
    reused = stage(M.reuse(chunks, known, "chunk_id", "v"), "reused")
    fresh = reused.where(~F.col("reused")).drop("v")
    made = stage(fresh.join(embed(fresh, "chunk_id", "text").select("chunk_id", F.col("v").cast("array<double>").alias("v")), "chunk_id"), "made")
    whole = reused.where("reused").unionByName(made, allowMissingColumns=True).drop("reused").withColumns({"model": F.lit(model), "chunker": F.lit(CHUNKER_VERSION)})
    status = M.manifest_diff(manifest if manifest is not None else digests.limit(0), digests, "doc_id", "sha1").groupBy("status").count().collect()
    counts = chunks.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    n_made = made.count()
    removed = known.join(chunks.select("chunk_id"), "chunk_id", "left_anti").count()
    version = f"v{time.time_ns()}"
    publish_all({"chunks": whole, "manifest": digests}, path, version)
    return Report(counts.n, counts.d, counts.n - n_made, n_made, removed, {r.status: r["count"] for r in status}, twice, time.time() - began)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    found = current(spark, path, "chunks")
    if found is None or not found.limit(1).count():
        raise IndexMissingError(path)
    return found


def retrieve(index: DataFrame, queries: DataFrame, config: S.SearchConfig | None = None, threshold: float | None = None, embed: S.Embed = S.hashed_vectors) -> DataFrame:
    """Hits of every query over an index, with section and text joined last."""
    blank = queries.where(strip(F.coalesce("question", F.lit(""))) == "")
    if blank.limit(1).count():
        raise ValueError("a question is blank")
    chunks = index.select("chunk_id", "doc_id", "ord", "text")
    stored = lambda df, key, text: index.select("chunk_id", "v") if key == "chunk_id" else embed(df, key, text)
    hits = S.search(chunks, queries, config, threshold, embed=stored)
    return hits.join(index.select("chunk_id", "section", "text"), "chunk_id")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Texts of a folder by their path below it, and the errors of those that cannot be used."""
    rows = files.read_texts(spark, path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    below = F.substring_index(F.col("path"), f"{root.rstrip('/')}/", -1) if path else F.col("path")
    return rows.where("error is null").select(below.alias("doc_id"), "text"), rows.where("error is not null").select(below.alias("doc_id"), "error")


def manifest_json(report: Report) -> str:
    return json.dumps(report.__dict__, ensure_ascii=False, sort_keys=True)
