"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next one's docs.  All but the last
return the columns that they were given, for the documents they keep; extra
columns may have any names.  An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.decontamination import contaminated_documents, contaminated_pairs
from quillon.llm.jaccard_join import jaccard_components
from quillon.llm.language_id import UNDETERMINED, learn_profiles, predict_texts
from quillon.llm.quality import fit_quality, predict_texts as predict_quality
from quillon.llm.source_mixing import mix_sources
from quillon.session import ship
from quillon.staging import scratch, stage

#: Least language score that a document is kept with; documents without a letter score 0.
LEAST_LANGUAGE_SCORE = 0.25


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the documents has it (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of id and text, by which decisions are taken: ids may be null, or be those of several texts."""
    key = _fresh(docs, "row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def _rows(keyed: DataFrame, key: str, named: DataFrame, how: str) -> DataFrame:
    """The rows whose key is in ``named`` (one column), or is not, as ``how`` is left_semi or left_anti."""
    name = _fresh(keyed, "named_key")
    return keyed.join(named.toDF(name), F.col(key) == F.col(name), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is determined with a score of ``LEAST_LANGUAGE_SCORE`` at least.

    Null texts and texts without a letter go.  If no row has both text and
    language to learn from, every document stays.  Each row is judged by its
    own text alone, so repeated rows share their fate.
    """
    ship(spark)
    profiles = learn_profiles(docs)
    if not profiles:
        return docs
    name = _fresh(docs, "found_language")
    found = docs.withColumn(name, predict_texts(profiles)(F.col("text")))
    return found.where((F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier predicts to be good.

    If the documents have no labels, or all have the same one, nothing can be
    told apart and every document stays.  Each row is judged by its own text
    alone, so repeated rows share their fate; null texts count as empty.
    """
    ship(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model.knots):
        return docs
    name = _fresh(docs, "found_quality")
    return docs.withColumn(name, predict_quality(model)(F.col("text"))).where(F.col(name)["predicted"] == 1).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents: that of the smallest doc_id (null last), then of the smallest key of id and text.

    Rows alike in id and text are one document, and one row of them stays (the
    least by its columns as JSON).  Documents without words are groups of their own.
    """
    ship(spark)
    keyed, key = _keyed(docs)
    ids = stage(keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id")), "ids")
    groups = jaccard_components(keyed, id_col=key).select(F.col("doc_id").alias("k"), F.col("component_id").alias("group"))
    linked = stage(groups.where("group <> k").distinct(), "linked")  # the least key of a group is not in it
    members = linked.unionByName(linked.select(F.col("group").alias("k"), "group").distinct()).join(ids.distinct(), "k")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k")).alias("first")).select("group", F.col("first.k").alias("stays"))
    copies = stage(members.join(first, "group").where("k <> stays").select("k").distinct(), "copies")
    kept = _rows(keyed, key, copies, "left_anti")
    repeated = stage(ids.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "repeated")
    if repeated.limit(1).count():
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        many = _rows(kept, key, repeated, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row"))
        return _rows(kept, key, repeated, "left_anti").drop(key).unionByName(many.select("row.*"))
    return kept.drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose texts hold no benchmark item; another text of the same id stays. Null and empty texts, and all if there is no benchmark, stay."""
    ship(spark)
    keyed, key = _keyed(docs)
    pairs = contaminated_pairs(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _rows(keyed, key, stage(contaminated_documents(pairs).select("doc_id"), "contaminated"), "left_anti").drop(key)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; see ``mix_sources`` for the columns."""
    ship(spark)
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifiers and the T-occurrence search have no SQL; tests compare ``run`` with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with scratch(spark, name):  # what a stage wrote for itself goes with it
            kept = stage(step(spark, docs, sf_dir), name)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
