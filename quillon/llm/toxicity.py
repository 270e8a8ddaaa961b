"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of a lower-cased text, over code points:
those of 4 to 6 anywhere, and those of 7 and 8 where a word begins.  An n-gram
is one feature if it occurs and a second if it occurs twice or more; each that
is present counts its log-count ratio between toxic and other labelled texts.
A logistic regression on those scaled features, fitted on a bounded sample,
gives the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import textkit
from quillon.llm.labelled import held_out, labelled_sample, one_text_each
from quillon.staging import stage

#: Labelled texts at most that the model is fitted on.
SAMPLE = 20_000
#: Lengths of the n-grams taken everywhere, and of those taken where a word begins (its blank counted), in code points.
ANYWHERE, LEADING = (4, 5, 6), (7, 8)
#: Features kept: those whose counts differ most between the classes. With SAMPLE it bounds what the driver gets (327 MB if every text held every feature).
KEPT = 8_192
SMOOTHING, PENALTY, STEPS = 1.0, 1e-4, 300
#: Texts that a step of the fit goes through at once.
TEXTS_AT_ONCE = 1000
#: A document is toxic from this score on.
THRESHOLD = 0.3
#: Code points hashed at once; n-grams across a cut are hashed with the slice they begin in.
SLICE = 1 << 20
#: N-grams that are counted before a task makes them distinct.
COUNTED = 1 << 20

_BLANK = 0x20
#: Code points that end words alike: white space, controls and ASCII punctuation.
_ENDS = np.array(sorted({*range(0x21), 0x21, 0x22, 0x27, 0x28, 0x29, 0x2A, 0x2C, 0x2E, 0x3A, 0x3B, 0x3F, *(c for c in range(0x3001) if chr(c).isspace())}), dtype=np.uint32)
#: Turns the feature of an n-gram that occurs into that of one that occurs twice.
_TWICE = np.uint64(0x5851F42D4C957F2D)
#: Leading bits of the hashes that are looked up in a bitmap first.
_BITS = 20
_MULTIPLIER = np.uint64(0x100000001B3)


def _folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each lower-cased and between two blanks, and their offsets; a null or empty text has none."""
    padded = [f" {t.lower()} " if t else "" for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.zeros(0x3001, dtype=bool)
    table[_ENDS] = True
    ends = table[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
    return np.where(ends, np.uint32(_BLANK), codes), np.cumsum([0, *map(len, padded)])


def _slices(codes: np.ndarray) -> Iterator[list[tuple[np.ndarray, np.ndarray, int]]]:
    """For each slice, by length: where its n-grams begin, their 64-bit hashes, and the length."""
    longest = max(*ANYWHERE, *LEADING)
    for lo in range(0, len(codes), SLICE):
        piece = codes[lo : lo + SLICE + longest - 1].astype(np.uint64)
        everywhere = np.arange(min(SLICE, len(piece)))
        leading = everywhere[piece[: len(everywhere)] == _BLANK]
        found, h = [], np.zeros(len(piece), dtype=np.uint64)
        for length in range(1, longest + 1):
            n = len(piece) - length + 1
            if n <= 0:
                break
            h = (h[:n] ^ piece[length - 1 :]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
            if length in ANYWHERE or length in LEADING:
                at = everywhere[:n] if length in ANYWHERE else leading[: np.searchsorted(leading, n)]
                found.append((at + lo, textkit.mix(h[at] + np.uint64(length)), length))
        yield found


def _distinct(row: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, gram) once, in order, with the sum of its counts."""
    order = np.lexsort((gram, row)) if row.any() else np.argsort(gram)
    row, gram, count = row[order], gram[order], count[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])]) if len(row) else np.zeros(0, dtype=np.int64)
    return row[new], gram[new], np.add.reduceat(count, new) if len(new) else count


def features(texts: list[str | None], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each text, in the order of both; null and empty texts have none.

    kept: the features that are wanted, ascending; all are without it.
    """
    codes, at = _folded(texts)
    maybe = None
    if kept is not None:
        wanted = np.unique(np.concatenate([kept, kept ^ _TWICE]))  # n-grams either of whose features is kept
        maybe = np.zeros(1 << _BITS, dtype=bool)
        maybe[wanted >> np.uint64(64 - _BITS)] = True
    parts = []
    for found in _slices(codes):
        rows, grams = [], []
        for start, h, length in found:
            if maybe is not None:
                near = np.flatnonzero(maybe[h >> np.uint64(64 - _BITS)])
                start, h = start[near], h[near]
                real = np.isin(h, wanted)
                start, h = start[real], h[real]
            row = np.searchsorted(at, start, side="right") - 1
            inside = start + length <= at[row + 1]
            rows.append(row[inside])
            grams.append(h[inside])
        row, gram = np.concatenate(rows or [np.zeros(0, dtype=np.int64)]), np.concatenate(grams or [np.zeros(0, dtype=np.uint64)])
        parts.append(_distinct(row, gram, np.ones(len(row), dtype=np.int64)))
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    row, gram, count = parts[0] if len(parts) == 1 else _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    again = count >= 2
    row, gram = np.concatenate([row, row[again]]), np.concatenate([gram, gram[again] ^ _TWICE])
    if kept is not None:
        real = np.isin(gram, kept)
        row, gram = row[real], gram[real]
    order = np.lexsort((gram, row))
    return row[order], gram[order]


@dataclass(frozen=True)
class ToxicityModel:
    """The kept features, ascending, their weights, and the intercept."""

    kept: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        row, gram = features(texts, self.kept)
        margin = np.bincount(row, weights=self.weights[np.searchsorted(self.kept, gram)], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either class each feature occurs, summed over many texts at a time."""
    schema = pa.schema([("gram", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])

    def settle(parts: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        gram = np.concatenate([g for _, g in parts])
        label = np.repeat([x for x, _ in parts], [len(g) for _, g in parts])
        seen, at = np.unique(gram, return_inverse=True)
        toxic, every = np.bincount(at, weights=label, minlength=len(seen)).astype(np.int64), np.bincount(at, minlength=len(seen))
        for lo in range(0, len(seen), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(seen[cut].view(np.int64)), pa.array(toxic[cut]), pa.array(every[cut] - toxic[cut])], schema=schema)

    parts, size = [], 0
    for batch in textkit.pieces(batches, "text"):
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
            parts.append((label, features([text.as_py()])[1]))
            size += len(parts[-1][1])
            if size >= COUNTED:
                yield from settle(parts)
                parts, size = [], 0
    yield from settle(parts)


def _kept_features(kept: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("columns", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            row, gram = features(batch.column("text").to_pylist(), kept)
            columns, edge = np.searchsorted(kept, gram).astype(np.uint16), np.searchsorted(row, np.arange(batch.num_rows + 1))
            own = [columns[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.binary())], schema=schema)

    return run


def _logistic(columns: np.ndarray, edge: np.ndarray, scale: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights on the scaled features and the intercept, by accelerated gradient descent with an L2 penalty.

    columns: the features of all texts, one text after the other, those of text
    i between ``edge[i]`` and ``edge[i + 1]``.  Only a block of texts at a time
    is spread out to numbers of full width.
    """
    n, d = len(label), len(scale)
    blocks = [(lo, min(n, lo + TEXTS_AT_ONCE)) for lo in range(0, n, TEXTS_AT_ONCE)]
    squared = scale**2
    total = sum(float(squared[columns[edge[lo] : edge[hi]]].sum()) for lo, hi in blocks)
    # The curvature is at most a quarter of the mean squared row norm times four, plus the intercept's.
    step = 4.0 / (total / n * 4 + 1.0)
    w, b, v = np.zeros(d), float(np.log((label.sum() + 1) / (n - label.sum() + 1))), np.zeros(d)
    c = b
    for t in range(STEPS):
        scaled, grad, drift = scale * v, np.zeros(d), 0.0
        for lo, hi in blocks:
            own = columns[edge[lo] : edge[hi]]
            row = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(edge[lo : hi + 1]))
            margin = np.bincount(row, weights=scaled[own], minlength=hi - lo) + c
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[lo:hi]
            grad += np.bincount(own, weights=error[row], minlength=d)
            drift += error.sum()
        grad = scale * grad / n + PENALTY * v
        new_w, new_b = v - step * grad, c - step * drift / n
        ahead = t / (t + 3)
        v, c = new_w + ahead * (new_w - w), new_b + ahead * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fits on at most ``sample`` labelled texts outside the held-out fold.

    The sample's ids are broadcast to find its texts; of a repeated id one text
    counts, chosen by its hash.  The driver gets KEPT features and which of
    them each text of the sample holds, two bytes each.  Without labelled rows
    of both classes the score is the share of toxic rows (0 without rows).
    """
    texts = stage(one_text_each(docs, labelled_sample(labels, label_col, sample), id_col, text_col), "labelled")
    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return ToxicityModel(np.zeros(0, dtype=np.uint64), np.zeros(0), 30.0 if toxic else -30.0)
    counts = texts.mapInArrow(_counts, "gram long, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    p, q = F.col("toxic") / float(toxic), F.col("other") / float(other)
    pooled = (F.col("toxic") + F.col("other")) / float(toxic + other)
    contrast = F.abs(p - q) / F.sqrt(pooled * (1.0 - pooled) + 1e-4)
    best = counts.orderBy(F.round(contrast, 12).desc(), "gram").limit(KEPT).collect()
    found = sorted((r.gram % (1 << 64), r.toxic, r.other) for r in best)
    kept = np.array([x[0] for x in found], dtype=np.uint64)
    in_toxic, in_other = (np.array([x[i] for x in found], dtype=np.float64) for i in (1, 2))
    scale = np.log((in_toxic + SMOOTHING) / (toxic + 2 * SMOOTHING)) - np.log((in_other + SMOOTHING) / (other + 2 * SMOOTHING))
    rows = texts.mapInArrow(_kept_features(kept), "doc_id long, label int, columns binary").orderBy("doc_id").toArrow()  # ``sample`` rows at most
    held = rows.column("columns").combine_chunks().cast(pa.large_binary())
    offsets, data = held.buffers()[1:3]
    edge = np.frombuffer(offsets, dtype=np.int64)[held.offset : held.offset + len(held) + 1] // 2
    columns = np.frombuffer(data, dtype=np.uint16) if data is not None else np.zeros(0, dtype=np.uint16)
    w, b = _logistic(columns, edge, scale, rows.column("label").to_numpy().astype(np.float64))
    return ToxicityModel(kept, w * scale, b)


def _score_batches(model: ToxicityModel, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            score = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1) and predicted (1 if the score reaches the threshold).

    Only the text is used to score; a null or empty text has no n-gram and gets
    the intercept's score.  An id with labels that disagree counts as toxic.
    Repeated rows get equal rows, other columns are ignored, and an empty table
    gives an empty table.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score_batches(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
