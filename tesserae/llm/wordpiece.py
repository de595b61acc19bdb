"""Token counts by a linear longest-match automaton.

A trie over the vocabulary gets failure links and, for each node, the number of pieces
that are popped on the way along its failure link. Running over a word then adds numbers
and never builds a piece; every byte moves the automaton forward once, whatever the
vocabulary. The count equals that of the greedy longest match from the left.

Words are ASCII-white-space separated; each is matched as a word-initial piece (those of
the vocabulary that open with a space) and then continuation pieces. A stretch that no
piece opens makes the whole word one unknown piece, as in WordPiece.

Edge cases: null and empty texts have no words and no tokens; repeated rows count alike.
"""

from __future__ import annotations

import json
from collections import deque
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import default_path
from .common import append_columns


def vocabulary(path: str | None = None) -> tuple[set[bytes], set[bytes]]:
    """Word-initial and continuation pieces of a byte-level vocabulary file, as bytes."""
    with open(path or default_path(), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    first, later = set(), set()
    for t in tokens:
        if all(c in byte for c in t):
            raw = bytes(byte[c] for c in t)
            if raw[:1] == b" ":
                first.add(raw[1:])
            else:
                later.add(raw)
    first.discard(b"")
    return first, later


class Automaton:
    """Nodes are numbers; step[node] maps a byte to the next node."""

    def __init__(self, first: set[bytes], later: set[bytes], memo_limit: int = 400_000):
        # two roots: 0 opens a word, 1 opens a continuation
        self.step: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for p in sorted(pieces):
                node = root
                for c in p:
                    to = self.step[node].get(c)
                    if to is None:
                        to = len(self.step)
                        self.step[node][c] = to
                        self.step.append({})
                        ends.append(False)
                    node = to
                ends[node] = True
        #: fail[v]: where the longest piece that opens v's string leaves the rest; -1: no piece opens it
        self.fail = [-1] * len(self.step)
        #: pops[v]: pieces that are popped on the way there
        self.pops = [0] * len(self.step)
        queue = deque(v for root in (0, 1) for v in [root])
        while queue:
            u = queue.popleft()
            for c, v in self.step[u].items():
                queue.append(v)
                if ends[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, n = self.fail[u], self.pops[u]
                while z != -1 and c not in self.step[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                if z != -1:
                    self.fail[v], self.pops[v] = self.step[z][c], n
        self.memo: dict[bytes, int] = {}
        self.memo_limit = memo_limit

    def word(self, word: bytes) -> int:
        """Pieces of one word; 1 for a word that can't be matched."""
        step, fail, pops = self.step, self.fail, self.pops
        node = n = 0
        for c in word:
            to = step[node].get(c)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node == -1:
                    return 1
                to = step[node].get(c)
            node = to
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node == -1:
                return 1
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """Words and pieces of a whole text."""
        if not text:
            return 0, 0
        words = text.encode().split()
        memo = self.memo
        try:
            return len(words), sum(map(memo.__getitem__, words))
        except KeyError:
            new = set(words).difference(memo)
            if len(memo) + len(new) > self.memo_limit:
                memo.clear()
                new = set(words)
            for w in new:
                memo[w] = self.word(w)
            return len(words), sum(map(memo.__getitem__, words))


@cache
def automaton(path: str | None = None) -> Automaton:
    """One automaton for each worker process."""
    return Automaton(*vocabulary(path))


def greedy(word: bytes, first: set[bytes], later: set[bytes], longest: int = 256) -> int:
    """The count by its definition, for tests. longest: no piece has more bytes."""
    at = n = 0
    while at < len(word):
        pieces = later if at else first
        to = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), 0)
        if not to:
            return 1
        at, n = to, n + 1
    return n


def count_tokens(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words and n_tokens of its text."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        counter = automaton(path)
        rows = [counter.text(t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
        return [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]

    return append_columns(docs, [("n_words", "long", pa.int64()), ("n_tokens", "long", pa.int64())], make, keep)
