"""Periodic runs of words, by the runs theorem.

A run is a stretch of words with smallest period q that cannot be extended
without losing it.  Every run of two periods or more holds, for one of the two
orders of the words, a longest Lyndon word of length q: that order in which the
word after the run is smaller than the one q before it.  So all runs come from
the longest Lyndon words at each position under both orders, which end at the
next smaller value of the inverse suffix array (at the next larger one for the
opposite order).  Each such root is extended to both sides by longest common
extensions: the least entry, by a sparse table, between two suffixes in the
array of longest common prefixes, of the text and of the text turned round.

Texts of a batch are worked on together, in groups of bounded size, with numpy;
suffixes are compared within their own text only.  Every text is processed
whole, in O(n log n) for n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm.textkit import pieces, text_bytes, word_parts

#: Words of the texts that are worked on together (a longer text alone). Any number gives the same result.
GROUP = 1 << 16
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Suffixes:
    """Ranks of all suffixes of several texts laid end to end, each compared within its text, a shorter one before those it begins.

    ``ids`` numbers the words, ``text`` says which text each belongs to (rising).
    ``levels[k]`` ranks the pieces of 2**k words; the last one ranks the suffixes.
    """

    def __init__(self, ids: np.ndarray, text: np.ndarray) -> None:
        n = len(ids)
        self.n, self.stop = n, np.searchsorted(text, text, side="right")
        rank = self._dense(text * (int(ids.max(initial=0)) + 1) + ids)
        self.levels, step = [rank.astype(np.int32)], 1
        while True:
            met = np.bincount(rank, minlength=n)
            open_ = np.flatnonzero(met[rank] > 1)
            if not len(open_):
                break
            after = open_ + step
            inside = after < self.stop[open_]
            second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            # ranks leave room for all that share them, so that only these need sorting
            key = rank[open_] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            key = key[order]
            group = rank[open_][order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            begins = np.ones(len(key), dtype=bool)
            begins[1:] = group[1:] != group[:-1]
            at = np.arange(len(key))
            first = np.maximum.accumulate(np.where(begins, at, 0))
            own = np.maximum.accumulate(np.where(new, at, 0))
            rank = rank.copy()
            rank[open_[order]] = group + own - first
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        """For each entry, how many are smaller."""
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        return rank

    def alike(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words at ``i`` and at ``j`` > ``i`` (of the same text) are the same, by the ranks of the two pieces that cover them; true for n = 0."""
        k = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
        out = (k < len(self.levels)) & (j + n <= self.stop[i])  # pieces longer than those of the last level are all different
        for level in np.unique(k[out]):
            at = np.flatnonzero(out & (k == level) & (n > 0))
            rank, a, b, over = self.levels[level], i[at], j[at], n[at] - (1 << int(level))
            out[at] = (rank[a] == rank[b]) & (rank[a + over] == rank[b + over])
        return out

    def index_prefixes(self) -> None:
        """Longest common prefixes of suffixes that are neighbours in order, and a sparse table of their minima."""
        suffix = np.empty(self.n, dtype=np.int64)
        suffix[self.rank] = np.arange(self.n)
        a, b = suffix[:-1], suffix[1:]
        common = np.zeros(len(a), dtype=np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = a + common, b + common
            fits = (i < self.stop[a]) & (j < self.stop[b])
            level = self.levels[k]
            same = fits & (level[np.where(fits, i, 0)] == level[np.where(fits, j, 0)])
            common += same.astype(np.int32) << k  # pieces of equal rank are equal words: a piece cut off by its text's end equals no other
        self.levels.clear()
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            was, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(was[:-half], was[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``i`` and ``j`` (other places of the same text) have in common."""
        lo, hi = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for level in np.unique(k):
            at, table = np.flatnonzero(k == level), self.minima[level]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << int(level))])
        return out


def next_smaller(values: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each place the next one of a smaller value before ``stop``, else ``stop``; by jumps over what is known to be no smaller."""
    n = len(values)
    after = np.minimum(np.arange(1, n + 1), stop)
    open_ = np.flatnonzero(after < stop)
    while len(open_):
        to = after[open_]
        larger = values[to] > values[open_]
        open_, to = open_[larger], to[larger]
        after[open_] = after[to]
        open_ = open_[after[open_] < stop[open_]]
    return after


def find_runs(ids: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of ``min_length`` words and ``min_exponent`` periods (2 at least) in texts laid end to end, in order of start, then period."""
    none = np.zeros(0, dtype=np.int64)
    if len(ids) < 2:
        return none, none, none
    order = Suffixes(ids, text)
    at = np.arange(order.n)
    found = []
    for values in (order.rank, -order.rank):
        end = next_smaller(values, order.stop)
        period = end - at
        # a run's first root after its start begins within a period, so that the rest of the run's least length lies behind the root
        need = np.maximum((min_exponent - 2) * period, np.maximum(min_length - 2 * period, 0))
        root = np.flatnonzero(order.alike(at, end, need))
        found.append(root * (order.n + 1) + period[root])
    roots = np.stack(np.divmod(np.unique(np.concatenate(found)), order.n + 1), 1)
    if not len(roots):
        return none, none, none
    # only the texts that have roots are needed from here on
    used = np.zeros(int(text[-1]) + 1, dtype=bool)
    used[text[roots[:, 0]]] = True
    held = used[text]
    if not held.all():
        place = np.cumsum(held) - 1
        start, length, period = _extend(ids[held], text[held], place[roots[:, 0]], roots[:, 1], min_length, min_exponent)
        return np.flatnonzero(held)[start], length, period
    return _extend(ids, text, roots[:, 0], roots[:, 1], min_length, min_exponent, order)


def _extend(ids: np.ndarray, text: np.ndarray, i: np.ndarray, p: np.ndarray, min_length: int, min_exponent: int, order: Suffixes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs around the roots [i, i + p)."""
    order = order or Suffixes(ids, text)
    order.index_prefixes()
    n, after = order.n, i + p
    ahead = np.zeros(len(i), dtype=np.int64)
    inside = after < order.stop[i]
    ahead[inside] = order.common(i[inside], after[inside])
    turned = Suffixes(ids[::-1].copy(), int(text[-1]) - text[::-1])
    turned.index_prefixes()
    behind = np.zeros(len(i), dtype=np.int64)
    inside = i > np.searchsorted(text, text[i], side="left")
    behind[inside] = turned.common(n - i[inside], n - after[inside])  # of the words before the root and before its end
    start, length = i - behind, behind + p + ahead
    keep = length >= np.maximum(min_length, min_exponent * p)
    runs = np.stack([start, length, p], 1)[keep]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # of roots with the same extent the shortest is the period; the others are its multiples
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)


def _grouped(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts in groups: the first and the one after the last, the number of each word, and where each text's words begin (and end)."""
    data, at = text_bytes(texts)
    parts = list(word_parts(data, at, fold=False))
    if parts:
        hashes, begins = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    else:
        hashes, begins = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    where = np.searchsorted(begins, at, side="left")
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(where, where[lo] + GROUP, side="right")) - 1)
        own = hashes[where[lo] : where[hi]]
        yield lo, hi, np.unique(own, return_inverse=True)[1].astype(np.int64), where[lo : hi + 1] - where[lo]
        lo = hi


def _runs_of_batch(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[list[list[dict[str, int]]], list[str]]:
    """The runs of each text, and its words without their repeats.

    Words are compared by 64-bit hashes first.  Runs found so are held against
    the words themselves; if one fails, the text is searched again by its words.
    No run is missed: where equal hashes join different words, the run that they
    make longer or shorter in its period is among those that fail.
    """
    runs: list[list[dict[str, int]]] = []
    rest: list[str] = []
    for lo, hi, numbers, began in _grouped(texts):
        found = find_runs(numbers, np.repeat(np.arange(hi - lo), np.diff(began)), min_length, min_exponent)
        cut = np.searchsorted(found[0], began)
        for k in range(hi - lo):
            words = (texts[lo + k].as_py() or "").encode().split()  # by the six white-space characters of ASCII
            own = list(zip(*(x[cut[k] : cut[k + 1]].tolist() for x in (found[0] - began[k], *found[1:])), strict=True)) if cut[k] < cut[k + 1] else []
            if any(words[s : s + n - q] != words[s + q : s + n] for s, n, q in own):
                own = list(zip(*(x.tolist() for x in find_runs(_numbered(words), np.zeros(len(words), dtype=np.int64), min_length, min_exponent)), strict=True))
            if own:
                covered = np.zeros(len(words) + 1, dtype=np.int64)
                for s, n, q in own:
                    covered[s + q] += 1
                    covered[s + n] -= 1
                words = [w for w, c in zip(words, np.cumsum(covered[:-1]).tolist(), strict=True) if not c]
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            rest.append(b" ".join(words).decode())
    return runs, rest


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs array<struct(start, length, period)>, collapsed) of every row: its runs, by start, then period, and its text without their repeats.

    Words are those between ASCII white space, numbered from 0; equal words are
    equal in every byte.  A run has ``min_length`` words and ``min_exponent``
    periods at least.  ``collapsed`` joins, by single spaces, the words that no
    run contains after its first period.  Null and empty texts have no runs and
    an empty ``collapsed``; an empty table gives an empty one; repeated rows and
    null ids are rows like others; other columns are not read.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods at least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in pieces(batches, "t"):
            runs, rest = _runs_of_batch(batch.column("t"), min_length, min_exponent)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, kind), pa.array(rest, pa.string())], ["doc_id", "runs", "collapsed"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return texts.mapInArrow(search, f"doc_id long, runs array<{RUN}>, collapsed string")


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts, those of a tenth of the ids with a periodic end.

    With h the CRC-32 of the id as text and g = floor(h / 10), a text of n > 0
    words whose h is divisible by 10 has each word i >= a = g % n replaced by
    word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)).  A null id
    leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    plain = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    planted = F.coalesce((h % 10 == 0) & (plain != ""), F.lit(False))
    split = rows.withColumns({"h": h, "w": F.when(planted, F.split(plain, r"[\x20\x09-\x0D]+"))})
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    placed = split.withColumns({"a": F.when(F.col("w").isNotNull(), g % n), "parts": 3 + g % 8})
    placed = placed.withColumn("p", 1 + F.floor((n - F.col("a")) / F.col("parts")))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    turned = F.transform("w", lambda x, i: F.when(i < a, x).otherwise(F.get("w", a + (i - a) % p)))
    return placed.select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """``periodic_runs`` in columns that can be compared: the number of runs, the longest one, and digests of all runs and of what is left."""
    longest = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] > y["length"], -1).when(x["length"] < y["length"], 1).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = runs.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
