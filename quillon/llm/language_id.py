"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, words padded
with a blank) in order.  A text's own profile is compared with that of each
language: every n-gram is charged the distance of its two ranks, or the length
of the language's profile if it is not in it.  The least sum names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm import textkit
from quillon.llm.labelled import held_out
from quillon.staging import stage

#: N-grams in a profile.
PROFILE = 300
#: Texts (about) that the profile of a language is made of: those whose ids have the smallest hashes.
SAMPLE = 1000
UNDETERMINED = "und"
#: The blank that stands for everything between words, and the most bits of a letter.
_BLANK, _BITS = 0x20, 21
#: Characters handled at once, and n-grams of languages that a task holds before it sends them.
SLICE, HELD = 1 << 20, 1 << 17
#: Languages up to which the bounds of their samples are broadcast; beyond it they are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of the whole text, as integers in ascending order, and their counts.

    Letters count as they are, every run of other characters as one blank, with
    a blank at both ends; a text without a letter has none.  A slice goes on
    from the last two symbols before it, so the cuts make no difference.
    """
    grams: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    shift, before = np.uint64(_BITS), np.array([_BLANK], dtype=np.uint64)
    lowered = text.lower()
    for lo in range(0, len(lowered) + 1, SLICE):
        piece = lowered[lo : lo + SLICE] + (" " if lo + SLICE > len(lowered) else "")
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _is_letter()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first blank after a word
        keep[0] |= before[-1] != _BLANK
        symbols = np.concatenate([before, np.where(letter, codes, np.uint32(_BLANK))[keep].astype(np.uint64)])
        old = len(before)
        two = (symbols[:-1] << shift) | symbols[1:]
        three = (two[:-1] << shift) | symbols[2:]
        one = symbols[old:]
        for g in (one[one != _BLANK], two[old - 1 :], three[max(0, old - 2) :]):  # those that end in this slice
            found, n = np.unique(g, return_counts=True)
            grams.append(found)
            counts.append(n)
        before = symbols[-2:]
    all_grams, all_counts = np.concatenate(grams), np.concatenate(counts)
    if len(lowered) < SLICE:
        return all_grams, all_counts  # ascending: longer n-grams are greater
    found, at = np.unique(all_grams, return_inverse=True)
    return found, np.bincount(at, weights=all_counts, minlength=len(found)).astype(np.int64)


def top_ngrams(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by the n-gram."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        grams, counts = grams[near], counts[near]
    return grams[np.argsort(-counts, kind="stable")][:size]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def settle(total: dict[tuple[str, int], int]) -> Iterator[pa.RecordBatch]:
        if total:
            lang, gram = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.int64()), pa.array(list(total.values()), pa.int64())], schema=schema)

    total: dict[tuple[str, int], int] = {}
    for batch in textkit.pieces(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            grams, counts = ngram_counts(text.as_py())
            for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                total[lang, g] = total.get((lang, g), 0) + n
            if len(total) >= HELD:
                yield from settle(total)
                total = {}
    yield from settle(total)


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to its profile, from about ``sample`` labelled texts a language outside the held-out fold.

    Rows of null text or language are left out, and so are languages whose
    texts hold no letter.  Every language is learnt.  What is gathered is
    ``size`` n-grams a language, as each task compares with every profile.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    # The hash bound of the sample is taken from counts, so that texts are neither sorted nor shuffled.
    position = F.abs(F.xxhash64("doc_id", "text", F.lit(5)) % (1 << 20))
    bounds = stage(known.groupBy("lang").agg(F.count("*").alias("rows")).select(F.col("lang").alias("of"), F.ceil(F.lit(sample * (1 << 20)) / F.col("rows")).alias("bound")), "languages")
    if bounds.count() <= BROADCAST_LANGUAGES:
        bounds = F.broadcast(bounds)
    chosen = known.join(bounds, F.col("lang") == F.col("of")).where(position < F.col("bound")).select("lang", "text")
    counts = chosen.mapInArrow(_count_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("top")).collect()
    return {r.lang: np.array([x.gram for x in r.top], dtype=np.int64).view(np.uint64) for r in sorted(top, key=lambda r: r.lang)}


def _predictor(profiles: dict[str, np.ndarray], size: int):
    langs = sorted(profiles)
    grams = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, dtype=np.uint64)
    ranks = np.full((len(langs), len(grams) + 1), -1, dtype=np.int64)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(text: str | None) -> tuple[str, float]:
        if not langs or not text:
            return UNDETERMINED, 0.0
        own = top_ngrams(*ngram_counts(text), size)
        if not len(own):
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        theirs = np.where(grams[at] == own, ranks[:, at], -1)
        distance = np.where(theirs < 0, size, np.minimum(size, np.abs(theirs - np.arange(len(own))))).sum(axis=1)
        best = int(np.argmin(distance))
        return langs[best], 1.0 - float(distance[best]) / (size * len(own))

    return predict


def predict_batches(profiles: dict[str, np.ndarray], size: int = PROFILE):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    predict = _predictor(profiles, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            lang, score = [], []
            for text in batch.column("text"):
                one, two = predict(text.as_py())
                lang.append(one)
                score.append(two)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return run


def predict_texts(profiles: dict[str, np.ndarray], size: int = PROFILE):
    """A function from a text column to a struct of lang_pred and score."""

    @F.arrow_udf("lang_pred string, score double")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = _predictor(profiles, size)  # once for each task
        for texts in batches:
            told = [predict(x.as_py()) for x in texts]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64())], names=["lang_pred", "score"])

    return found


def identify_languages(docs: DataFrame, profiles: dict[str, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred and score (1 less the mean distance, 0 to 1).

    Only the text is used to predict.  ``und`` with score 0 is given to null
    texts, texts without a letter, and all texts if nothing could be learnt.
    Equal distances go to the language first by code point.  Repeated rows get
    equal rows; other columns are ignored; an empty table gives an empty table.
    """
    profiles = learn_profiles(docs, id_col, text_col, lang_col) if profiles is None else profiles
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict_batches(profiles), "doc_id long, held_out boolean, lang_pred string, score double")
