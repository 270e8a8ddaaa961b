"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and bytes above ASCII, with A-Z lower-cased,
so case, punctuation and line breaks do not hide a passage.  A document and a
benchmark item that share a seed (a run of ``k`` words) are compared: the
longest match of free words is marked again and again, found by running
Karp-Rabin over the free runs, until none of ``k`` words is left.  The item's
marked share is its coverage, which a passage keeps when its parts are
reordered, split or edited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import textkit
from quillon.staging import stage

#: Benchmark words up to which seeds and items are sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_WORDS = 2_000_000
#: Words whose seeds are looked up at once.
SLICE = 1 << 20
#: Bits, at most 2 ** FILTER_BITS, of the filter that documents' seeds must pass before they are shuffled; it comes in parts of 2 ** PART_BITS.
FILTER_BITS, PART_BITS = 27, 19
_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ITEM_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def words_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column and each text's offsets among them."""
    return textkit.hash_words(*textkit.text_bytes(column), separators=_SEPARATORS)


class _Rolling:
    """Karp-Rabin hashes of all windows of any length over one word sequence."""

    def __init__(self, words: np.ndarray, power: np.ndarray, inverse: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * power[:n], out=self.sums[1:])
        self.inverse = inverse
        self.free = np.ones(n, dtype=bool)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows whose words are all free, and their hashes."""
        n = len(self.free) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        taken = np.zeros(len(self.free) + 1, dtype=np.int64)
        np.cumsum(~self.free, out=taken[1:])
        start = np.flatnonzero(taken[length:] == taken[:n])
        return start, (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def _shared_parts(item: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the text that are in a run of ``least`` words that the item has, one word in place of each gap, and their places (-1: a gap)."""
    if least < 1 or min(len(item), len(text)) < least:
        return text[:0], np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.isin(textkit.shingle_hashes(text, least), textkit.shingle_hashes(item, least)))
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    return np.insert(text[place], gap, 0), np.insert(place, gap, -1)


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first; equal lengths by their starts.

    ``least`` is the shortest tile, so only those parts of the text count whose
    runs of ``least`` words are in the item, too; the rest is left out first, a
    break in its place.  Each round finds the greatest length of a
    common run of unmarked words by bisection and marks all runs of it that do
    not overlap, in the order of their starts.
    """
    text, place = _shared_parts(item, text, least)
    n = max(len(item), len(text))
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _ROLL, dtype=np.uint64)])
        inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, pow(int(_ROLL), -1, 1 << 64), dtype=np.uint64)])
        a, b = _Rolling(item, power, inverse), _Rolling(text, power, inverse)
        b.free &= place >= 0

        def common(length: int) -> bool:
            return bool(np.isin(a.windows(length)[1], b.windows(length)[1]).any())

        tiles, most = [], min(len(item), len(text))
        while most >= least:
            low, high = least - 1, most
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if common(middle) else (low, middle - 1)
            if low < least:
                break
            starts, hashes = b.windows(low)
            order = np.argsort(hashes, kind="stable")
            starts, hashes = starts[order], hashes[order]
            for p, h in zip(*a.windows(low), strict=True):
                for t in starts[np.searchsorted(hashes, h) : np.searchsorted(hashes, h, side="right")]:
                    if a.free[p : p + low].all() and b.free[t : t + low].all() and (item[p : p + low] == text[t : t + low]).all():
                        a.free[p : p + low] = b.free[t : t + low] = False
                        tiles.append((int(p), int(place[t]), low))
                        break
            most = low - 1
    return tiles


def seed_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k words; fewer words are one run."""
    return np.unique(textkit.shingle_hashes(words, min(k, len(words)))) if len(words) else words[:0]


_PAIRS = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("item_words", pa.int64()), ("n_tiles", pa.int64()), ("tiles", pa.list_(pa.list_(pa.int64())))]
)
_PAIR_DDL = "doc_id long, item_id long, coverage double, matched_words long, item_words long, n_tiles long, tiles array<array<long>>"


def _judge(doc_id: int | None, text: np.ndarray, item_id: int | None, item: np.ndarray, k: int, threshold: float) -> tuple | None:
    tiles = greedy_tiles(item, text, min(k, len(item)))
    matched = sum(x[2] for x in tiles)
    if matched < threshold * len(item):
        return None
    return doc_id, item_id, matched / len(item), matched, len(item), len(tiles), [list(x) for x in sorted(tiles)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _PAIRS, strict=True)], schema=_PAIRS)


def _against(items: list[tuple[int | None, np.ndarray]], k: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares documents with items that every executor holds."""
    seeds = [seed_hashes(words, k) for _, words in items]
    lengths = sorted({min(k, len(words)) for _, words in items})
    hashes = np.concatenate(seeds)
    owner = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    known = np.unique(hashes)
    bits = max(16, int(len(known) * 16).bit_length())
    maybe = np.zeros(1 << bits, dtype=bool)  # most words of most documents end here
    maybe[known >> np.uint64(64 - bits)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            words, where = words_of(batch.column("text"))
            pairs = set()
            for lo in range(0, len(words), SLICE):
                for length in lengths:
                    h = textkit.shingle_hashes(words[lo : lo + SLICE + length - 1], length)
                    at = np.flatnonzero(maybe[h >> np.uint64(64 - bits)])
                    h, at = h[at], at + lo
                    real = np.isin(h, known)
                    h, at = h[real], at[real]
                    doc = np.searchsorted(where, at, side="right") - 1
                    inside = at + length <= where[doc + 1]
                    for d, x in zip(doc[inside].tolist(), h[inside], strict=True):
                        pairs.update((d, i) for i in owner[np.searchsorted(hashes, x) : np.searchsorted(hashes, x, side="right")].tolist())
            ids = batch.column("doc_id").to_pylist() if pairs else []
            found = (_judge(ids[d], words[where[d] : where[d + 1]], *items[i], k, threshold) for d, i in sorted(pairs))
            if rows := [x for x in found if x]:
                yield _batch(rows)

    return run


def _seed_rows(id_name: str, k: int, lengths: tuple[int, ...] | None = None, maybe: Callable[[], np.ndarray] | None = None):
    """(id, seed) for every distinct seed of a text: of an item the runs of k words (or of all, if it has fewer), of a document those of all ``lengths``.

    maybe: a filter by leading bits that seeds must pass.
    """
    schema = pa.schema([(id_name, pa.int64()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = maybe() if maybe else None
        shift = np.uint64(64 - (len(held).bit_length() - 1)) if held is not None else None
        for batch in textkit.pieces(batches, "text"):
            words, where = words_of(batch.column("text"))
            ids, seeds, owners = batch.column(id_name).to_pylist(), [], []
            for i, lo, hi in zip(ids, where[:-1], where[1:], strict=True):
                for length in lengths or (min(k, int(hi - lo)),):
                    if length and hi - lo >= length:
                        h = textkit.shingle_hashes(words[lo:hi], length)
                        seeds.append(np.unique(h if held is None else h[held[h >> shift]]))
                        owners.append(np.full(len(seeds[-1]), i, dtype=np.int64))
            if seeds:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(np.concatenate(seeds).view(np.int64))], schema=schema)

    return run


_PART = pa.schema([("part", pa.int32()), ("mask", pa.binary())])


def _masks(bits: int, part_bits: int):
    """The parts of a filter in which seeds of this task have a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            seen[batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        for part, own in enumerate(seen.reshape(-1, 1 << part_bits)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], schema=_PART)

    return run


def _joined(table: pa.Table) -> pa.Table:
    whole = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in table.column("mask").to_pylist()])
    return pa.table([table.column("part")[:1], pa.array([whole.tobytes()], pa.binary())], schema=_PART)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """One bit for each value of the seeds' leading bits: 16 times as many as there are seeds, 2 ** FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(16, (16 * seeds.count()).bit_length()))
    part_bits = min(PART_BITS, bits)
    parts = seeds.mapInArrow(_masks(bits, part_bits), "part int, mask binary").groupBy("part").applyInArrow(_joined, "part int, mask binary").collect()  # 16 MB at most
    packed = np.zeros((1 << (bits - part_bits), (1 << part_bits) // 8), dtype=np.uint8)
    for r in parts:
        packed[r.part] = np.frombuffer(bytes(r.mask), dtype=np.uint8)
    return packed.reshape(-1)


def _paired(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            (words, at), (item_words, item_at) = words_of(batch.column("text")), words_of(batch.column("item_text"))
            ids = zip(batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), strict=True)
            found = (_judge(d, words[at[i] : at[i + 1]], m, item_words[item_at[i] : item_at[i + 1]], k, threshold) for i, (d, m) in enumerate(ids))
            if rows := [x for x in found if x]:
                yield _batch(rows)

    return run


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    threshold: float = 0.5,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """The (document, item) pairs whose coverage reaches ``threshold``.

    Columns: doc_id, item_id, coverage (0 to 1, of the item), matched_words,
    item_words, n_tiles and tiles ([start in item, start in document, length],
    in words).  An item of fewer than ``k`` words is matched as one run.  Null
    or wordless texts on either side match nothing; repeated rows on either
    side give repeated pairs; a null id is reported as null.  Other columns are
    ignored; empty tables give no pairs.

    Up to ``broadcast_words`` words of items (a count of the whole table) the
    items go to the executors and no row is shuffled.  Beyond it the documents'
    seeds that pass a filter of the items' seeds are joined with them by a
    shuffle (AQE splits a seed of many documents), and texts only for the pairs
    that share one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    n_words = items.agg(F.sum(F.regexp_count("text", F.lit(_ITEM_WORD)))).first()[0] or 0
    if n_words <= broadcast_words:
        rows = items.collect()  # broadcast_words words at most
        words, where = words_of(pa.array([r.text for r in rows], pa.string()))
        held = [(r.item_id, words[lo:hi]) for r, lo, hi in zip(rows, where[:-1], where[1:], strict=True) if hi > lo]
        if not held:
            return texts.select("doc_id").limit(0).mapInArrow(lambda batches: iter(()), _PAIR_DDL)
        return texts.mapInArrow(_against(held, k, threshold), _PAIR_DDL)

    # Rows are told apart by their own number, as ids may be null or repeated.
    numbered = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    numbered_items = items.withColumn("item_row", F.xxhash64("item_id", "text"))
    item_seeds = stage(numbered_items.select(F.col("item_row").alias("item_id"), "text").mapInArrow(_seed_rows("item_id", k), "item_id long, seed long").distinct(), "seeds")
    n_item_words = F.least(F.lit(k), F.regexp_count("text", F.lit(_ITEM_WORD)))
    lengths = tuple(sorted(r.n for r in items.select(n_item_words.alias("n")).where("n > 0").distinct().collect()))  # k rows at most
    packed = docs.sparkSession.sparkContext.broadcast(seed_filter(item_seeds))
    doc_seeds = numbered.select(F.col("row").alias("doc_id"), "text").mapInArrow(_seed_rows("doc_id", k, lengths, lambda: np.unpackbits(packed.value).view(bool)), "doc_id long, seed long")
    pairs = doc_seeds.join(item_seeds, "seed").select(F.col("doc_id").alias("row"), F.col("item_id").alias("item_row")).distinct()
    with_items = pairs.join(numbered_items.select("item_row", "item_id", F.col("text").alias("item_text")), "item_row")
    return with_items.join(numbered, "row").select("doc_id", "text", "item_id", "item_text").mapInArrow(_paired(k, threshold), _PAIR_DDL)


def contaminated_documents(pairs: DataFrame) -> DataFrame:
    """One row per document of ``contaminated_pairs``: doc_id, item_ids (ascending), n_items and max_coverage."""
    return pairs.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.count_distinct("item_id").alias("n_items"),
        F.max("coverage").alias("max_coverage"),
    )
