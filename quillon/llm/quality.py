"""Quality classifier: random Fourier features over document statistics.

Statistics of the whole text (lengths, character classes, repetition) are
standardised and mapped to random Fourier features, which approximate a
Gaussian kernel.  Ridge scores come from normal equations that each partition
sums on its own, and isotonic regression on scores of folds that the ridge has
not seen turns them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import textkit
from quillon.llm.labelled import held_out, labelled_sample
from quillon.staging import stage

#: Labelled texts at most that the model is fitted on.
SAMPLE = 20_000
#: Random features, the kernel's width in standard deviations, and the ridge penalty for each row.
FEATURES, WIDTH, PENALTY = 200, 4.0, 1e-3
#: Folds of the calibration, and partitions of the sample.
FOLDS, PARTS = 4, 4
#: A document is of good quality from this score on.
THRESHOLD = 0.7

#: Bytes counted together, each class as a share of the text's bytes.
_CLASSES = (
    b"!?",
    b"#*$%&@^~",
    b"|",
    b"0123456789",
    b".",
    b",",
    b"<>{}[]()\\/=_+-",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"\n",
    bytes(range(128, 256)),
)
N_STATISTICS = len(_CLASSES) + 7


def statistics(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of statistics for each text; a null or wordless text has zeros."""
    data, at = textkit.text_bytes(column)
    words, where = textkit.hash_words(data, at)
    n_bytes, n_words = np.diff(at), np.diff(where)
    out = np.zeros((len(n_bytes), N_STATISTICS))
    some = np.maximum(1, n_bytes)
    for i, members in enumerate(_CLASSES):
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        out[:, i] = np.diff(np.searchsorted(np.flatnonzero(table[data]), at)) / some
    i = len(_CLASSES)
    out[:, i] = np.log1p(n_words)
    out[:, i + 1] = np.minimum(40.0, n_bytes / np.maximum(1, n_words))
    for d in np.flatnonzero(n_words):
        w = words[where[d] : where[d + 1]]
        n = len(w)
        count = np.unique(w, return_counts=True)[1]
        same = w[1:] == w[:-1]
        out[d, i + 2] = len(count) / n
        out[d, i + 3] = count.max() / n
        out[d, i + 4] = same.mean() if n > 1 else 0.0
        if n >= 4:
            runs = textkit.shingle_hashes(w, 4)
            out[d, i + 5] = 1.0 - len(np.unique(runs)) / len(runs)
        out[d, i + 6] = len(count) / np.sqrt(n)
    return out


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs; a few hundred kilobytes at most."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / len(self.phases)) * np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.features(x) @ self.ridge, self.knots, self.values), 0.0, 1.0)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing step fit (pool adjacent violators), blocks pulled to the base rate by one row."""
    base = label.mean()
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        blocks.append([y, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    value = np.maximum.accumulate(np.array([(y + base) / (n + 1) for y, n, _ in blocks]))
    return np.array([s / n for _, n, s in blocks]), value


def _text_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])
    for batch in textkit.pieces(batches, "text"):
        rows = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], schema=schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, N_STATISTICS)


def _normal_equations(model: QualityModel):
    schema = pa.schema([("fold", pa.int32()), ("gram", pa.binary()), ("target", pa.binary()), ("n", pa.int64())])
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target, n = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS, dtype=np.int64)
        for batch in batches:
            z, y, fold = model.features(_matrix(batch.column("x"))), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for f in range(FOLDS):
                own = z[fold == f]
                gram[f] += own.T @ own
                target[f] += own.T @ y[fold == f]
                n[f] += len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(FOLDS), pa.int32()), pa.array([g.tobytes() for g in gram], pa.binary()), pa.array([t.tobytes() for t in target], pa.binary()), pa.array(n)], schema=schema
        )

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 7) -> QualityModel:
    """Fits on at most ``sample`` labelled texts outside the held-out fold.

    The ids of the sample are broadcast (``sample`` rows at most) to find its
    texts; of a repeated id one text counts, chosen by a hash of its
    statistics.  The driver gets the sample's statistics and a matrix of
    FEATURES squared for each of FOLDS x PARTS; neither grows with the corpus.
    Without a labelled row every score is 0.5; with one class alone, that class.
    """
    chosen = F.broadcast(labelled_sample(labels, label_col, sample))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(_text_statistics, "doc_id long, label int, x binary").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("x", F.xxhash64("x")).alias("x"))
    rows = stage(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")), "statistics")
    table = rows.orderBy("doc_id").toArrow()  # ``sample`` rows at most
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float64).reshape(-1, N_STATISTICS)
    y, fold = table.column("label").to_numpy().astype(np.float64), table.column("fold").to_numpy()

    random = np.random.default_rng(seed)
    weights, phases = random.normal(size=(N_STATISTICS, FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), weights, phases, np.zeros(FEATURES + 1), np.zeros(0), np.array([y.mean() if len(y) else 0.5]))
    draft = QualityModel(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9), weights, phases, np.zeros(0), np.zeros(0), np.zeros(0))
    sums = rows.repartition(PARTS).mapInArrow(_normal_equations(draft), "fold int, gram binary, target binary, n long").collect()
    size = FEATURES + 1
    gram, target, n = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS)
    for r in sums:
        gram[r.fold] += np.frombuffer(r.gram).reshape(size, size)
        target[r.fold] += np.frombuffer(r.target)
        n[r.fold] += r.n

    def solve(keep: np.ndarray) -> np.ndarray:
        return np.linalg.solve(gram[keep].sum(axis=0) + PENALTY * max(1.0, n[keep].sum()) * np.eye(size), target[keep].sum(axis=0))

    z, unseen = draft.features(x), np.zeros(len(y))
    for f in range(FOLDS):
        unseen[fold == f] = z[fold == f] @ solve(np.arange(FOLDS) != f)
    knots, values = isotonic(unseen, y)
    return QualityModel(draft.mean, draft.scale, weights, phases, solve(np.arange(FOLDS) >= 0), knots, values)


def _score_batches(model: QualityModel, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            score = model.scores(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    return run


def predict_texts(model: QualityModel, threshold: float = THRESHOLD):
    """A function from a text column to a struct of score and predicted."""

    @F.arrow_udf("score double, predicted int")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = textkit.pieces(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text")
            score = np.concatenate([np.zeros(0), *(model.scores(statistics(p.column("text"))) for p in parts)])
            yield pa.StructArray.from_arrays([pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["score", "predicted"])

    return found


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1) and predicted (1 if the score reaches the threshold).

    Only the text is used to score; null and empty texts are scored as texts
    without words.  An id with labels that disagree counts as good.  Repeated rows get equal rows, other columns are ignored,
    and an empty table gives an empty table.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score_batches(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
