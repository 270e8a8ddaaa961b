"""Which rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: crc32 of the id as text, modulo FOLDS; HELD_OUT is never learnt from.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: Column) -> Column:
    """True for the rows whose labels may not be learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) for at most ``most`` labelled ids outside the held-out fold: those of the smallest hashes.

    Labels other than 0 and 1 and null ids are left out.  An id labelled twice
    counts as 1 if any of its labels is 1.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    return chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def one_text_each(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, label, text) of the sampled ids that documents have; of the texts of a repeated id that of the smallest hash.

    ``sample`` is what ``labelled_sample`` gives, so it may be broadcast.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return texts.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
