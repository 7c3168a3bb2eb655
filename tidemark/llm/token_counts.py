"""Operator 9: exact greedy word-piece counts in linear time, without building the pieces.

A trie of the vocabulary gets failure links: from a node whose string can't be extended, the link leads to the node
that greedy longest match would be in after giving off its finished pieces, and the number of pieces given off is stored
with the link. Counting a word is then one walk over its bytes. Words of like length walk together as one numpy vector.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import LONG_WORD, WordTable, arrow, by_length, documents, slices

SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def pieces_of(model_path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, pieces that continue one) of a sentencepiece file; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    begin, inside = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        body = piece.removeprefix("▁")
        if body and "▁" not in body:
            (begin if piece != body else inside).append(body.encode())
    return begin, inside


class LongestMatch:
    """Failure-link automaton over bytes. Node 0 starts a word, node 1 continues one, -1 is no node."""

    def __init__(self, begin: list[bytes], inside: list[bytes]) -> None:
        child: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, begin), (1, inside)):
            for p in pieces:
                v = root
                for c in p:
                    if c not in child[v]:
                        child[v][c] = len(child)
                        child.append({})
                        final.append(False)
                    v = child[v][c]
                final[v] = v > 1
        n = len(child)
        link, popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            v = queue.popleft()
            for c, u in child[v].items():
                if final[u]:
                    link[u], popped[u] = 1, 1
                else:
                    z, k = link[v], popped[v]
                    while z >= 0 and c not in child[z]:
                        k += popped[z]
                        z = link[z]
                    if z >= 0:
                        link[u], popped[u] = child[z][c], k
                queue.append(u)
        ends = [0] * n  # pieces given off when the word ends in this node; -1 if it can't be split
        ends[0] = 0
        for v in self._by_link(link):
            ends[v] = 0 if v <= 1 else -1 if link[v] < 0 or ends[link[v]] < 0 else popped[v] + ends[link[v]]
        self.child, self.link, self.popped, self.ends = child, np.array(link), np.array(popped), np.array(ends)
        edges = sorted((v << 8 | c, u) for v, m in enumerate(child) for c, u in m.items())
        self.keys = np.array([k for k, _ in edges] or [-1], np.int64)
        self.to = np.array([u for _, u in edges] or [-1], np.int64)

    @staticmethod
    def _by_link(link: list[int]) -> Iterator[int]:
        """Every node after the node its link leads to."""
        done = [False] * len(link)
        for v in range(len(link)):
            path = []
            while v >= 0 and not done[v]:
                path.append(v)
                done[v] = True
                v = link[v]
            yield from reversed(path)

    def one(self, word: bytes) -> int:
        """Pieces of the word, or -1 if it has no split. The empty word has 0."""
        v, k, child, link, popped = 0, 0, self.child, self.link, self.popped
        for c in word:
            while c not in child[v]:
                if link[v] < 0:
                    return -1
                k += int(popped[v])
                v = int(link[v])
            v = child[v][c]
        return -1 if self.ends[v] < 0 else k + int(self.ends[v])

    def count(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i in (i for i, w in enumerate(words) if len(w) > LONG_WORD):
            out[i] = self.one(words[i])
        for pick, lens, grid in by_length(words):
            v = np.zeros(len(pick), np.int64)
            k = np.zeros(len(pick), np.int64)
            for t in range(grid.shape[1]):
                todo = np.flatnonzero((lens > t) & (v >= 0))
                while len(todo):
                    key = v[todo] << 8 | grid[todo, t]
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    hit = self.keys[at] == key
                    v[todo[hit]] = self.to[at[hit]]
                    todo = todo[~hit]
                    k[todo] += self.popped[v[todo]]
                    v[todo] = self.link[v[todo]]
                    todo = todo[v[todo] >= 0]
            last = np.where(v < 0, -1, self.ends[v])
            out[pick] = np.where(last < 0, -1, k + last)
        return out


@functools.lru_cache(1)
def table_for(model_path: str) -> WordTable:
    """A worker process keeps its automaton, and the words it has met, from task to task."""
    return WordTable(LongestMatch(*pieces_of(model_path)).count)


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each row's whole text.

    Words are the runs of bytes other than space and \\x09-\\x0D. A word that greedy longest match can't split counts as
    one unknown token. Null and empty texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(model_path)
        for batch in batches:
            for part, texts in slices(batch):
                doc, at, rows = table.look([t.split() for t in texts])
                n = rows[at] if len(at) else np.zeros(0, np.int64)
                total = lambda x: np.bincount(doc, x, len(texts)).astype(np.int64)
                yield arrow({"doc_id": part.column("doc_id"), "n_words": total(np.ones(len(n))), "n_tokens": total(np.where(n < 0, 1, n)), "n_unknown": total(n < 0)}, _OUT)

    return documents(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
