"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link to the node that stands for what is left of
its string after the pieces that greedy longest match takes off its front, and the number of those
pieces, all found when the trie is built. A word's pieces are then counted in one pass over its
bytes, without backing up and without building a piece. Words repeat, so a bounded table keeps the
counts of those that came first.

Nulls and ties: a null text has no words; a word that the vocabulary can't spell is one unknown
piece; the longest piece is unique, so there are no ties. Repeated rows are counted one by one;
other columns are left as they are. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


class Automaton:
    """start: pieces that may begin a word; inner: pieces that may follow (None: the same ones)."""

    def __init__(self, start: Iterable[bytes], inner: Iterable[bytes] | None = None):
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        parent, last, ends = [0], [0], [False]
        self.inner_root = 0

        def insert(root: int, piece: bytes) -> None:
            at = root
            for c in piece:
                key = at << 8 | c
                if key not in self.child:
                    self.child[key] = len(parent)
                    parent.append(at)
                    last.append(c)
                    ends.append(False)
                at = self.child[key]
            if piece:
                ends[at] = True

        if inner is not None:
            self.inner_root = 1
            parent.append(0)
            last.append(0)
            ends.append(False)
        for p in start:
            insert(0, p)
        for p in inner or ():
            insert(self.inner_root, p)
        n = len(parent)
        self.fail, self.popped = [-1] * n, [0] * n
        roots = {0, self.inner_root}
        depth = [0] * n
        for v in range(n):
            if v not in roots:
                depth[v] = depth[parent[v]] + 1
        for v in sorted((x for x in range(n) if x not in roots), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.popped[v] = self.inner_root, 1
                continue
            z, count = self.fail[parent[v]], self.popped[parent[v]]
            while z >= 0 and z << 8 | last[v] not in self.child:
                count += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.child[z << 8 | last[v]], count

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if it can't be spelt."""
        child, fail, popped, u, n = self.child, self.fail, self.popped, 0, 0
        for c in word:
            while (v := child.get(u << 8 | c)) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = v
        while u != self.inner_root and u:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


def byte_level_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes; a leading space marks a word's start."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible}
    byte_of.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(visible)))
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return [bytes(byte_of[c] for c in piece) for piece in vocab if all(c in byte_of for c in piece)]


class _Counts(dict):
    """word -> pieces; keeps the first `most` words (about 100 bytes each)."""

    def __init__(self, automaton: Automaton, most: int = 500_000):
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(self) < self.most:
            self[word] = n
        return n


_known: dict[str, _Counts] = {}


def counts(text: Column, vocabulary: str) -> Column:
    """Struct column (n_words, n_tokens) of whole texts, words being cut at ASCII white space.
    vocabulary: a byte-level vocabulary file, in the place of which each word starts with a space."""

    @arrow_udf("struct<n_words:long,n_tokens:long>")
    def run(texts: pa.Array) -> pa.Array:
        if vocabulary not in _known:
            _known[vocabulary] = _Counts(Automaton(byte_level_pieces(vocabulary)))
        get = _known[vocabulary].__getitem__
        words = [x.encode().split() if x else [] for x in texts.to_pylist()]
        cols = [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())]
        return pa.StructArray.from_arrays(cols, names=["n_words", "n_tokens"])

    return run(text)
