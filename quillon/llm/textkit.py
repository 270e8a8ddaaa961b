"""Vectorised word and shingle hashing over Arrow text columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z
lower-cased, hashed to 64 bits.  Everything works on the UTF-8 bytes of a whole
Arrow batch with numpy, in segments of bounded size, so that neither Python
strings nor per-word objects are made and a text of any length is processed
whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it

#: Bytes hashed at once; the working set is about 40 times this.
SEGMENT = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking 64-bit value for each byte, so that words are not sums of small numbers.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def _power(inverse: bool, n: int) -> np.ndarray:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + (SEGMENT >> 2))
        _powers.clear()
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[inverse]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text (n + 1 of them); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Hands freed memory back to the system: a worker lives on after its task, and its allocators keep what they once held."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that ``column``, of texts or bytes, has about four segments in each (a longer value alone).

    What a task holds beside Spark's own batch is then bounded, however long the rows are.
    """
    for batch in batches:
        values = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 4 * SEGMENT, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch, values
        release()


def _segments(space: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts the bytes where a word may end: at ends of texts, or at white space within a long one."""
    lo, end = 0, int(at[-1])
    while lo < end:
        hi = int(at[np.searchsorted(at, lo + SEGMENT, side="right") - 1])
        if hi <= lo:  # one text longer than a segment
            stop = int(at[np.searchsorted(at, lo, side="right")])
            hi = lo + SEGMENT
            while hi < stop and not space[hi]:
                ahead = np.flatnonzero(space[hi : min(stop, hi + SEGMENT)])
                hi = hi + int(ahead[0]) if len(ahead) else min(stop, hi + SEGMENT)
            hi = min(hi, stop)
        yield lo, hi
        lo = hi


def hash_words(data: np.ndarray, at: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and where each text's words begin among them (n + 1 offsets).

    ``separators`` marks the bytes that end words.
    """
    parts = list(word_parts(data, at, separators))
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    return np.concatenate([x[0] for x in parts]), np.searchsorted(np.concatenate([x[1] for x in parts]), at, side="left")


def word_parts(data: np.ndarray, at: np.ndarray, separators: np.ndarray = _SPACE, fold: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By segments: the hashes of the words, and the bytes where they begin and end. ``fold``: A-Z count as a-z."""
    space = separators[data]
    for lo, hi in _segments(space, at):
        gap = space[lo:hi]
        first = ~gap
        first[1:] &= gap[:-1]
        inner = at[np.searchsorted(at, lo, side="right") : np.searchsorted(at, hi, side="left")] - lo
        first[inner] = ~gap[inner]
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        last = ~gap
        last[:-1] &= gap[1:]
        last[inner - 1] = ~gap[inner - 1]
        end = np.flatnonzero(last) + 1
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[data[lo:hi]] if fold else data[lo:hi]] * _power(False, hi - lo)[: hi - lo], out=total[1:])
        h = (total[end] - total[begin]) * _power(True, hi - lo)[begin]
        yield mix(h + (end - begin).astype(np.uint64)), begin + lo, end + lo


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words; fewer words than k give none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out + words[i : i + n]) * np.uint64((0xD6E8FEB86659FD93 + 2 * i) | 1)
        out ^= out >> np.uint64(32)
    return mix(out)


def by_segment(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in order, in groups of about a segment (a longer text alone), as bytes and offsets."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 4 * SEGMENT, side="right")) - 1)
        yield data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a text of 1 to k - 1 words has one, of them all."""
    for part, offsets in by_segment(data, at):
        words, where = hash_words(part, offsets)
        for lo, hi in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield np.unique(shingle_hashes(words[lo:hi], k))
            elif hi > lo:
                yield shingle_hashes(words[lo:hi], hi - lo)
            else:
                yield words[:0]
