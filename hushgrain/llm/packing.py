"""Packing of documents into token sequences: sum-of-squares online packing.

A document longer than a window fills whole windows first. What is left, of s tokens, goes to the
fill level that minimises the sum over all levels below the window of (open windows at that
level) squared; the counts are kept in an array with one entry per level. Beyond `max_open` open windows
the one fullest window is completed, by cutting pieces of the emptiest ones. So are, when a partition's
input ends, those that are still open, and what is left at the very end is cut at powers of two, which
need no padding.

Each partition packs what it reads: no shuffle, and memory is bounded by `max_open` windows.

Nulls and ties: a null text is an empty one; an empty document still has its end id. Rows with a
null or repeated doc_id are packed like any other. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrain.llm.chunks import encoder, in_portions

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")])


class SumOfSquares:
    """Packs pieces online. add() and finish() return placed pieces: (document, start, length,
    sequence, offset, ids). Sequences are numbered from 0."""

    def __init__(self, window: int = 4096, max_open: int = 4096):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)  # open windows by fill; 0 and window stay empty
        self.open: dict[int, list[list]] = {}  # fill -> windows, each a list of (document, start, ids)
        self.n_open = self.sequences = 0

    def level_for(self, s: int) -> int:
        """The level where s more tokens give the least sum of squares; 0: a new window. Ties go
        to the fullest window."""
        n, w = self.levels, self.window
        h = np.flatnonzero(n[: w - s + 1])
        gain = 2 * n[h + s] - 2 * n[h] + 2
        gain[h + s == w] = 1 - 2 * n[h[h + s == w]]  # a full window leaves the count
        new = 2 * n[s] + 1 if s < w else 0
        if not len(h):
            return 0
        best = len(h) - 1 - int(np.argmin(gain[::-1]))
        return int(h[best]) if gain[best] <= new else 0

    def _emit(self, pieces: list) -> list[tuple]:
        out, at = [], 0
        for doc, start, ids in pieces:
            out.append((doc, start, len(ids), self.sequences, at, ids))
            at += len(ids)
        self.sequences += 1
        return out

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        """ids: all of one document's, at least one."""
        out, w = [], self.window
        whole = len(ids) // w * w
        for i in range(0, whole, w):
            out += self._emit([(doc, i, ids[i : i + w])])
        if s := len(ids) - whole:
            h = self.level_for(s)
            pieces = []
            if h:
                pieces = self._take(h)
            pieces.append((doc, whole, ids[whole:]))
            if h + s == w:
                out += self._emit(pieces)
            else:
                self._put(pieces, h + s)
        if self.n_open > self.max_open:
            out += self._complete()
        return out

    def _put(self, pieces: list, level: int) -> None:
        self.open.setdefault(level, []).append(pieces)
        self.levels[level] += 1
        self.n_open += 1

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _complete(self) -> list[tuple]:
        """Completes the fullest open window with the ends of pieces of the emptiest ones. Nothing is
        returned if they don't hold enough; all is then in one window."""
        at = int(np.flatnonzero(self.levels)[-1])
        full = self._take(at)
        while at < self.window and self.n_open:
            low = int(np.argmax(self.levels > 0))
            pieces = self._take(low)
            while at < self.window and pieces:
                doc, start, ids = pieces.pop()
                keep = max(0, len(ids) - (self.window - at))  # the end of a piece moves, its beginning stays
                full.append((doc, start + keep, ids[keep:]))
                at += len(ids) - keep
                low -= len(ids) - keep
                if keep:
                    pieces.append((doc, start, ids[:keep]))
            if pieces:
                self._put(pieces, low)
        if at == self.window:
            return self._emit(full)
        self._put(full, at)
        return []

    def finish(self) -> list[tuple]:
        """Completes the open windows by cutting pieces of the emptiest ones."""
        out = []
        while self.n_open > 1:
            out += self._complete()
        if self.n_open:
            level = int(np.flatnonzero(self.levels)[-1])
            out += self._powers(self._take(level), level)
        return out

    def _powers(self, pieces: list, n: int) -> list[tuple]:
        """Sequences of powers of two, the largest first."""
        out, pieces = [], list(reversed(pieces))
        for bit in range(n.bit_length() - 1, -1, -1):
            if room := n & 1 << bit:
                part = []
                while room:
                    doc, start, ids = pieces.pop()
                    part.append((doc, start, ids[:room]))
                    if len(ids) > room:
                        pieces.append((doc, start + room, ids[room:]))
                    room -= len(part[-1][2])
                out += self._emit(part)
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, drops_space: bool, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", max_open: int = 4096, cached: int = 700_000, portion: int = 4_000_000) -> DataFrame:
    """One row for each piece of each document: where it lies in its document and in its sequence,
    and its ids (little-endian, 32 bits). tokenizer: a file of the tokenizers library. cached, portion:
    chunks that a worker keeps, and characters that it encodes at once."""

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer, drops_space, cached)
        base = TaskContext.get().partitionId() << 36  # so many sequences are never in one partition
        packer = SumOfSquares(window, max_open)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = [x or 0 for x in pc.binary_length(texts).to_pylist()]
            for i, j in in_portions(lengths, portion):
                placed = []
                for doc, raw in zip(ids[i:j], encode.encode(texts.slice(i, j - i))):
                    got = np.append(np.frombuffer(raw, encode.dtype), encode.dtype.type(end_id))
                    placed += packer.add((doc, len(got)), got)
                if placed:
                    yield _batch(placed, base)
        if placed := packer.finish():
            yield _batch(placed, base)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def _batch(placed: list[tuple], base: int) -> pa.RecordBatch:
    docs, start, length, sequence, offset, ids = zip(*placed)
    cols = [[d for d, _ in docs], start, length, [n for _, n in docs], [base + s for s in sequence], offset]
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in cols), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], schema=_ARROW)
