"""Token counts of whole texts under a unigram vocabulary, by trie-shared dynamic programming.

Pre-tokens are runs of bytes outside white space, each led by the word mark.
A task inserts its distinct pre-tokens in a trie; a node holds the least cost
(negative log probability) at which its prefix can be cut into pieces and the
number of pieces, computed once from the nodes above it and shared by all
pre-tokens with that prefix.  The count at a pre-token's last node is stored
under the word's 64-bit hash (by chance two of a million distinct words of a
task meet with a probability of 3e-8), and a text's count is the sum over its
pre-tokens.  No row is shuffled.

The vocabulary is a public one, given as pieces in the order of their rank.
Its file holds no unigram probabilities, and none are learnt: the probability
of a piece is assumed to follow from its rank by Zipf's law.  Characters that no
piece holds fall back to their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import textkit

#: The vocabulary file's usual place; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"
#: Trie nodes after which a task starts a new trie; any number gives the same counts.
MAX_NODES = 1_000_000
#: Pre-tokens longer than this are scored by the same recurrence without nodes of their own.
MAX_DEPTH = 64
#: Costs are whole numbers of this part of a nat, so that sums are exact.
UNIT = 1e-6


@dataclass(frozen=True)
class Vocabulary:
    """Cost of each piece, and of one byte where no piece fits."""

    costs: dict[str, int]
    byte_cost: int
    longest: int


def zipf_vocabulary(pieces: list[str]) -> Vocabulary:
    """Costs by rank: ``ln(rank + 2)`` plus the log of the sum; a byte costs as much as the last piece, and 1 more nat."""
    if not pieces:
        return Vocabulary({}, round(1 / UNIT), 1)
    norm = math.log(sum(1 / (i + 2) for i in range(len(pieces))))
    costs: dict[str, int] = {}
    for rank, piece in enumerate(pieces):
        if piece:
            costs.setdefault(piece, round((math.log(rank + 2) + norm) / UNIT))
    return Vocabulary(costs, round((math.log(len(pieces) + 2) + norm + 1) / UNIT), max(map(len, costs), default=1))


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Reads a SentencePiece model on the driver; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return zipf_vocabulary([model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))])


class _Matcher:
    """Which pieces end at each letter of a word: the pieces in a tree of their own, with links to the longest suffix."""

    def __init__(self, vocabulary: Vocabulary):
        self.goto: dict[int, int] = {}
        self.fail, self.ending = [0], [[]]
        goto = self.goto
        for piece, cost in vocabulary.costs.items():
            state = 0
            for letter in piece:
                edge = state << 21 | ord(letter)
                state = goto.setdefault(edge, len(self.fail))
                if state == len(self.fail):
                    self.fail.append(0)
                    self.ending.append([])
            self.ending[state].append((len(piece), (cost << 32) + 1))
        by_depth: list[list[tuple[int, int, int]]] = []
        depth = {0: 0}
        for edge, state in goto.items():  # parents come before their children
            depth[state] = depth[edge >> 21] + 1
            while len(by_depth) < depth[state]:
                by_depth.append([])
            by_depth[depth[state] - 1].append((edge >> 21, edge & 0x1FFFFF, state))
        for level in by_depth[1:]:
            for parent, letter, state in level:
                self.fail[state] = self.follow(self.fail[parent], letter)
                self.ending[state].extend(self.ending[self.fail[state]])

    def follow(self, state: int, letter: int) -> int:
        goto, fail = self.goto, self.fail
        while True:
            found = goto.get(state << 21 | letter)
            if found is not None:
                return found
            if not state:
                return 0
            state = fail[state]


class TokenTrie:
    """Forward scores by prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.matcher = _Matcher(vocabulary)
        self._reset()

    def _reset(self) -> None:
        self.next: dict[int, int] = {}
        # Cost and pieces of each node in one number, so that equal costs go to fewer pieces.
        self.best, self.state = [0], [0]

    def _step(self, letter: str, state: int, forward: list[int]) -> int:
        """The least cost of a prefix that ends with ``letter``, from those of the shorter ones; the low 32 bits count pieces."""
        at, least, single = len(forward), -1, False
        for length, cost in self.matcher.ending[state]:
            cost += forward[at - length]
            single |= length == 1
            if cost < least or least < 0:
                least = cost
        if not single:
            n = len(letter.encode("utf-8", "surrogatepass"))
            cost = forward[-1] + (n * self.vocabulary.byte_cost << 32) + n
            if cost < least or least < 0:
                least = cost
        return least

    def count(self, word: str) -> int:
        """Pieces of one pre-token (with its mark)."""
        follow = self.matcher.follow
        if len(word) > MAX_DEPTH:
            state, forward = 0, [0]
            for letter in word:
                state = follow(state, ord(letter))
                forward.append(self._step(letter, state, forward))
            return forward[-1] & 0xFFFFFFFF
        if len(self.best) > MAX_NODES:
            self._reset()
        best, states, children = self.best, self.state, self.next
        node, forward = 0, [0]
        for letter in word:
            edge = node << 21 | ord(letter)
            child = children.get(edge)
            if child is None:
                children[edge] = child = len(best)
                state = follow(states[node], ord(letter))
                states.append(state)
                best.append(self._step(letter, state, forward))
            node = child
            forward.append(best[node])
        return best[node] & 0xFFFFFFFF


def _count_batches(vocabulary_of, mark: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(vocabulary_of())
        known: dict[int, int] = {}  # the stored counts by the hash of the pre-token

        def counted(data: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            """The count of each word; a distinct word of a segment is looked up once."""
            distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
            if len(known) > MAX_NODES // 2:
                known.clear()
            out = np.empty(len(distinct), dtype=np.int64)
            for i, (key, lo, hi) in enumerate(zip(distinct.tolist(), begin[first].tolist(), end[first].tolist(), strict=True)):
                n = known.get(key)
                if n is None:
                    known[key] = n = trie.count(mark + data[lo:hi].tobytes().decode("utf-8", "replace"))
                out[i] = n
            return out[at]

        for batch in textkit.pieces(batches, "text"):
            data, at = textkit.text_bytes(batch.column("text"))
            words, tokens = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for h, begin, end in textkit.word_parts(data, at, fold=False):
                row = np.searchsorted(at, begin, side="right") - 1
                words += np.bincount(row, minlength=batch.num_rows)
                tokens += np.bincount(row, weights=counted(data, h, begin, end), minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], schema=schema)

    return run


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, n_pretokens and n_tokens (0 and 0 for null, empty or blank texts).

    White space is ``[\\x20\\x09-\\x0D]``.  Equal costs go to the cut of fewer
    pieces.  The vocabulary (about 32,000 pieces, whatever the corpus) is
    broadcast.  Repeated rows get equal rows, null ids stay null, other columns
    are ignored, and an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary(path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count_batches(lambda: held.value, WORD_MARK), "doc_id long, n_pretokens long, n_tokens long")
