"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Words are runs of letters, digits and characters above ASCII, with A-Z
lower-cased.  A template's fingerprints are the winnowed hashes of its k-word
runs (in every window of w hashes the least), held in an inverted index from
fingerprint to template and position.  Whole texts are winnowed alike, so any
shared run of k + w - 1 words meets the index.  Edits can break every such run,
so single words are looked up too: if m words of a template may be missing, one
of any m + 1 of its words is in each notice.  Such a hit counts if the words
around it are enough for the coverage.  Around the diagonal of every hit the
template is aligned with the text, within a band; the share of its words that
align is the coverage.  The span must not be padded out either, and the words
that tell a licence from its relatives (version numbers, NC, Lesser, ...) must
be, within the span, exactly those of the template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import textkit
from quillon.llm.decontamination import SLICE, words_of

#: Words in a hashed run, and hashes in a winnowing window.
RUN, WINDOW = 3, 2
#: Diagonals to either side that an alignment may stray.
BAND = 8
#: Least share of a template's words that must align, and of the span's words that must belong to the template.
COVERAGE, DENSITY = 0.8, 0.5
#: Word hits whose surroundings are looked at at once.
CHUNK = 1 << 14

# The wording of public licence notices.
_CC_SUFFIXES = {"BY": "", "BY-SA": "-ShareAlike", "BY-ND": "-NoDerivatives", "BY-NC": "-NonCommercial", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
_GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
TEMPLATES = {
    **{f"CC-{k}-{v}": f"Licensed under CC {k} {v}." for v in _CC_VERSIONS for k in _CC_SUFFIXES},
    **{f"CC-{k}-{v}-notice": f"This work is licensed under a Creative Commons Attribution{x} {v} {kind} License." for v, kind in _CC_VERSIONS.items() for k, x in _CC_SUFFIXES.items()},
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "ISC": "Released under the ISC License.",
    **{k: f"This work is licensed under the GNU {x} Public License, version {v}." for k, (x, v) in _GNU.items()},
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    **{
        f"{k}-notice": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {x} Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
        for k, (x, v) in _GNU.items()
    },
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
# Words that tell one licence from its relatives. Numbers do, too.
DECISIVE = frozenset("nc nd sa by cc0 noncommercial sharealike noderivatives noderivs commercial derivatives derivs lesser library affero".split())

_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of every window (the last of equals); all of them if fewer than a window."""
    if len(hashes) < window:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def align(template: np.ndarray, text: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """Most words of the template that align in order with ``text``, its first word being near ``start``; and the span they take.

    Cell d of row i is the best of the first i template words against the text
    up to diagonal d of the band, as one integer: words, then the span's first
    word, then how early it ends.  Of equal alignments the one of the shortest
    span counts, then the earliest, so that none reaches into a neighbour
    without need.  Returns (words, first, end) with the span's words in
    ``text``; (0, 0, 0) if none align.
    """
    n, width = len(template), 2 * band + 1
    words = text.tolist()
    bits = (len(words) + 1).bit_length()
    one, late = 1 << 2 * bits, (1 << bits) - 1
    row = [0] * width
    for i, word in enumerate(template.tolist(), 1):
        above, row = row, [0] * width
        for d in range(width):
            j = start + i - 1 + d - band
            score = above[d + 1] if d + 1 < width else 0  # the template's word is skipped
            if d and row[d - 1] > score:  # the text's word is skipped
                score = row[d - 1]
            if 0 <= j < len(words) and words[j] == word:
                more = ((above[d] or j << bits) | late) + one - (j + 1)
                if more > score:
                    score = more
            row[d] = score
    told = [(x >> 2 * bits, x >> bits & late, late - (x & late)) for x in row if x]
    return min(told, key=lambda x: (-x[0], x[2] - x[1], x[1]), default=(0, 0, 0))


_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("license", pa.string()),
        ("coverage", pa.float64()),
        ("density", pa.float64()),
        ("matched_words", pa.int64()),
        ("template_words", pa.int64()),
        ("start_word", pa.int64()),
        ("end_word", pa.int64()),
        ("start_char", pa.int64()),
        ("end_char", pa.int64()),
    ]
)
_FOUND_DDL = "doc_id long, license string, coverage double, density double, matched_words long, template_words long, start_word long, end_word long, start_char long, end_char long"


def _scan(templates: Mapping[str, str], coverage: float, density: float):
    names = sorted(templates)
    words, where = words_of(pa.array([templates[n] for n in names], pa.string()))
    wanted = [words[lo:hi] for lo, hi in zip(where[:-1], where[1:], strict=True)]
    entries = sorted((int(h), t, int(p)) for t, w in enumerate(wanted) for run in [textkit.shingle_hashes(w, RUN)] for p in winnow(run) for h in [run[p]])
    index: dict[int, list[tuple[int, int]]] = {}
    for h, t, p in entries:
        index.setdefault(h, []).append((t, p))
    known = np.array(sorted(index), dtype=np.uint64)
    bits = 16
    maybe = np.zeros(1 << bits, dtype=bool)
    maybe[known >> np.uint64(64 - bits)] = True
    # Of each template the longest words, one more than may be missing, with all their places in it.
    spelt = [[x.lower() for x in _WORD.findall(templates[n])] for n in names]
    marks: list[tuple[int, int, int]] = []
    least = [max(1, next(x for x in range(len(w) + 1) if x >= coverage * len(w))) if coverage <= 1 else len(w) + 1 for w in wanted]
    for t, w in enumerate(wanted):
        longest = sorted(range(len(w)), key=lambda p: (-len(spelt[t][p]), p))[: max(0, len(w) - least[t] + 1)]
        marks += [(int(w[p]), t, p) for p in longest]
    marked = np.array(sorted({x[0] for x in marks}), dtype=np.uint64)
    # Hashes of the decisive words; of the numbers those that templates hold.
    telling = {int(h) for t, w in enumerate(wanted) for h, word in zip(w, spelt[t], strict=True) if word.isdigit() or word in DECISIVE}
    telling |= {int(h) for h in words_of(pa.array([" ".join(sorted(DECISIVE))]))[0]}
    told = [[x for x in w.tolist() if x in telling] for w in wanted]
    maybe_word = np.zeros(1 << bits, dtype=bool)
    maybe_word[marked >> np.uint64(64 - bits)] = True

    def word_hits(words: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, template, diagonal) where a marked word stands among enough of its template's words for the coverage."""
        at = np.concatenate([lo + np.flatnonzero(maybe_word[words[lo : lo + SLICE] >> np.uint64(64 - bits)]) for lo in range(0, len(words), SLICE)] or [np.zeros(0, dtype=np.int64)])
        at = at[np.isin(words[at], marked)]
        found = words[at]
        for h, t, p in marks:
            mine, n = at[found == h], len(wanted[t])
            for lo in range(0, len(mine), CHUNK):
                here = mine[lo : lo + CHUNK]
                row = np.searchsorted(where, here, side="right") - 1
                place = (here - p - BAND)[:, None] + np.arange(n + 2 * BAND)
                inside = (place >= where[row][:, None]) & (place < where[row + 1][:, None])
                around = words[np.clip(place, 0, len(words) - 1)]
                share = sum(np.minimum(((around == w) & inside).sum(axis=1), c) for w, c in zip(*np.unique(wanted[t], return_counts=True), strict=True))
                enough = share >= least[t]
                yield from ((d, t, a - p) for d, a in zip(row[enough].tolist(), (here - where[row])[enough].tolist(), strict=True))

    def mismatch(span: list[int], want: list[int]) -> int | None:
        """Where the span's decisive words first differ from ``want``: there, or at the span's end if words are missing; None if nowhere."""
        at = [i for i, x in enumerate(span) if x in telling]
        for i, x in zip(at, want, strict=False):
            if span[i] != x:
                return i
        return None if len(at) == len(want) else at[len(want)] if len(at) > len(want) else len(span)

    def matches(text: np.ndarray, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Accepted (template, words, first, end), the longest first and none overlapping, from (template, diagonal, position).

        Every diagonal of a hit is aligned.  Whenever a notice is chosen, what
        else was found on its words is aligned again with the text left to
        either side, until nothing left is accepted.
        """
        chosen: list[tuple[int, int, int, int]] = []  # (first, end, template, words) in order
        queue: list[tuple[int, float, int, int, str, int, int, int, int, int]] = []

        def measure(t: int, start: int, lo: int, hi: int) -> None:
            """Aligns a diagonal with every stretch from ``lo`` to ``hi`` that no chosen notice takes."""
            n = len(wanted[t])
            inside = chosen[max(0, bisect_left(chosen, (lo,)) - 1) : bisect_left(chosen, (hi,))]
            stretches = list(zip([lo, *(max(lo, x[1]) for x in inside)], [*(x[0] for x in inside), hi], strict=True))
            while stretches:
                a, b = stretches.pop()
                if b <= a or b - a < coverage * n:
                    continue
                total, first, end = align(wanted[t], text[a:b], start - a, BAND)
                if not total or total < coverage * n:
                    continue
                span = text[a + first : a + end].tolist()
                wrong = mismatch(span, told[t])
                if wrong is None and total >= density * len(span):
                    heappush(queue, (-total, -total / n, len(span), first + a, names[t], end + a, t, start, a, b))
                elif wrong is not None and wrong < len(span):  # what aligns without the word that is out of place
                    stretches += [(a, a + first + wrong), (a + first + wrong + 1, b)]

        for t, start in sorted({(t, diagonal) for t, diagonal, _ in hits}):
            measure(t, start, max(0, start - BAND), min(len(text), start + len(wanted[t]) + BAND))
        while queue:
            less, _, _, first, _, end, t, start, lo, hi = heappop(queue)
            at = bisect_left(chosen, (first,))
            if (at == 0 or chosen[at - 1][1] <= first) and (at == len(chosen) or chosen[at][0] >= end):
                chosen.insert(at, (first, end, t, -less))
            measure(t, start, lo, hi)
        return [(t, total, first, end) for first, end, t, total in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text") if len(marked) or len(known) else ():
            words, where = words_of(batch.column("text"))
            by_doc: dict[int, list[tuple[int, int, int]]] = {}
            for lo in range(0, len(words), SLICE):
                h = textkit.shingle_hashes(words[max(0, lo - WINDOW) : lo + SLICE + RUN + WINDOW], RUN)
                at = np.flatnonzero(maybe[h >> np.uint64(64 - bits)])
                at = at[np.isin(h[at], known)]
                # A hash is a fingerprint if it is the least of a window; those of the text's own windows suffice.
                at = at[np.isin(at, winnow(h))] if len(at) else at
                doc = np.searchsorted(where, at + max(0, lo - WINDOW), side="right") - 1
                for d, a in zip(doc.tolist(), at.tolist(), strict=True):
                    position = a + max(0, lo - WINDOW)
                    if position + RUN <= where[d + 1]:
                        by_doc.setdefault(d, []).extend((t, int(position - where[d]) - p, int(position - where[d])) for t, p in index[int(h[a])])
            for d, t, diagonal in word_hits(words, where):
                by_doc.setdefault(d, []).append((t, diagonal, 0))
            rows = []
            for d, hits in sorted(by_doc.items()):
                chosen = matches(words[where[d] : where[d + 1]], sorted(set(hits)))
                if chosen:
                    spans = [m.span() for m in _WORD.finditer(batch.column("text")[d].as_py())]
                    doc_id = batch.column("doc_id")[d].as_py()
                    rows += [(doc_id, names[t], n / len(wanted[t]), n / (end - first), n, len(wanted[t]), first, end, spans[first][0], spans[end - 1][1]) for t, n, first, end in chosen]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice found: doc_id, license, coverage and density (0 to 1), matched_words, template_words, and its span in words and characters.

    Coverage is the share of the template's words that align, density that of
    the span's words.  Ends of spans are exclusive.  Where notices overlap the
    one with more matched words stays, then that of higher coverage, of the
    shorter span, the earlier one, then by name.  A notice is found if it
    strays by BAND diagonals at most, and if its version and variant are those
    of the template; of an unknown version none is reported.  Null, empty and wordless texts
    give no row; repeated rows give repeated rows; null ids stay null; other
    columns are ignored; empty tables and no templates give an empty table.
    The templates travel with the code, and no row is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_scan(dict(templates), coverage, density), _FOUND_DDL)
