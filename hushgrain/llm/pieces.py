"""SentencePiece encoding and decoding, with the n best segmentations.

A segmentation's score is the sum of its pieces' log-probabilities. A unigram model holds them. The
scores of a BPE model are the ranks of its merges, whose sums mean nothing; a piece's probability is then
taken from its rank r by Zipf's law, 1 / (r + 2) over the sum of all (log2, in 1/1024). The best
segmentation by probability isn't always the one that merges lead to; `merged` gives that one, the
library's own ids.

No piece reaches over the start of a word (a run of spaces) or over a line feed, so the lattice of a
text falls into chunks.
In each, forward Viterbi scores are the exact heuristic of a backward A-star search, which returns
its segmentations best first. The n best of a text differ from its best in at most n - 1 chunks;
those chunks are found from the difference of each chunk's two best scores, and combined.

A character that no piece has is spelt in byte pieces, at ten less than the least score.

Order and ties: by score, then fewer pieces; within a chunk then by ids compared from the end; in a
text then by the chunks' choices, the first chunk counting most, a better choice first.
Nulls: a null text has no segmentation (null); an empty one has one, without pieces. Other columns
are left as they are; repeated rows are encoded one by one. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from hushgrain.llm.chunks import in_portions
from hushgrain.llm.worker import each, held, no_collector

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*\n?[^{SPACE}\n]+|{SPACE}+|\n")
#: What a character outside the vocabulary costs beyond the least score.
_UNKNOWN_PENALTY = 10
#: Low bits of a weight, which count pieces (those of one chunk).
_BITS = 24
_INF = 1 << 200
#: Beyond every sum of weights of a short chunk; no single weight is beyond _MOST.
_FAR, _MOST = 1 << 62, 1 << 56
#: Chunks of at most so many characters are solved side by side.
_SHORT = 32
#: Longer chunks aren't kept.
_LONGEST = 64
#: Chunks whose n best are kept (about 1 KB each).
_SEARCHED = 20_000


def zipf(ranks: list[float], of: set[int]) -> list[float]:
    """Costs, in bits, of pieces of merge ranks from 0 (of BPE models, whose scores are 0, -1, -2 ...).
    Pieces that no merge makes (single characters come after all merges; runs of spaces have no rank)
    keep their order; what isn't in `of` costs nothing."""
    total = math.log2(sum(1.0 / (min(ranks[i], 1e5) + 2.0) for i in of))
    return [math.log2(min(x, 1e5) + 2.0) + total if i in of else 0.0 for i, x in enumerate(ranks)]


class Pieces:
    """A SentencePiece model's vocabulary. cached: most chunks kept (about 400 bytes each). with_merged:
    whether the library's ids are wanted."""

    def __init__(self, path: str, cached: int = 300_000, with_merged: bool = True):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        cost: list[float] = []
        merges = True
        self.bytes_of = piece_bytes(model)
        self.byte_id: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece, special = model.id_to_piece(i), model.is_control(i) or model.is_unknown(i)
            cost.append(-model.get_score(i))
            merges = merges and (special or model.is_byte(i) or cost[i] >= 1e8 or cost[i] == int(cost[i]))
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not special:
                self.ids[piece] = i
        self.longest = max(map(len, self.ids))
        if merges:
            cost = zipf(cost, set(self.ids.values()))
        normal = [cost[i] for i in self.ids.values() if cost[i] < 1e8]
        # A weight is a cost in whole units, then the number of pieces in the low bits.
        self.unit = 1 << 10 if merges else 1 << 20
        self.weight = [(round(x * self.unit) << _BITS) + 1 for x in cost]
        self.unknown = round((max(normal) + _UNKNOWN_PENALTY) * self.unit) << _BITS
        self.prefixes = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        if any("\n" in p or SPACE in p.strip(SPACE) or (p[-1:] == SPACE and p.strip(SPACE)) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word or a line")
        self.known: dict[str, tuple] = {}
        self.searched: dict[tuple[str, int], list] = {}
        self.cached, self.with_merged = cached, with_merged
        self._tables()

    def _tables(self) -> None:
        """The vocabulary as a dense automaton over Latin-1, for many short chunks at once. The space
        mark stands as 0."""
        child: list[dict[int, int]] = [{}]
        piece = [-1]
        for p, i in self.ids.items():
            try:
                codes = p.replace(SPACE, "\0").encode("latin-1")
            except UnicodeEncodeError:
                continue
            at = 0
            for c in codes:
                if c not in child[at]:
                    child[at][c] = len(child)
                    child.append({})
                    piece.append(-1)
                at = child[at][c]
            piece[at] = i
        inner = [v for v, x in enumerate(child) if x]
        row = {v: r + 1 for r, v in enumerate(inner)}  # row 0: nothing follows
        self.follow = np.zeros((len(inner) + 1, 256), np.int32)
        for v in inner:
            for c, w in child[v].items():
                self.follow[row[v], c] = w
        self.row = np.array([row.get(v, 0) for v in range(len(child))], np.int32)
        self.piece = np.array(piece, np.int32)
        self.root, self.row[0] = row[0], 0  # no child is node 0
        singles = [SPACE if c == 0 else chr(c) for c in range(256)]
        self.single = np.array([self.ids.get(x, -1) for x in singles], np.int64)
        self.single_weight = np.array([self.weight[self.ids[x]] if x in self.ids else self.unknown + len(x.encode()) for x in singles], np.int64)
        self.weights = np.array([min(w, _MOST) for w in self.weight], np.int64)

    # Chunks

    def keys(self, text: str) -> list[str]:
        """A key is a chunk without its leading space mark; one that begins with a line feed or a
        space mark is the chunk itself."""
        if not text:
            return []
        if SPACE in text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1] in " \n" or text[0] in " \n":
            found = _CHUNK.findall(SPACE + text.replace(" ", SPACE))
            return [x if x[0] == "\n" or x[1:2] == SPACE or len(x) == 1 or x[0] != SPACE or x[1] == "\n" else x[1:] for x in found]
        return text.replace("\n", " \n").split(" ")

    def chunk(self, key: str) -> str:
        return key if key[0] in ("\n", SPACE) else SPACE + key

    def spelt(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_id[x] for x in char.encode())

    def edges(self, chunk: str, a: int):
        """(end, weight, id; -1: spelt in bytes) of the edges that start at a place, by end."""
        get, weight, single = self.prefixes.get, self.weight, False
        for b in range(a + 1, min(len(chunk), a + self.longest) + 1):
            i = get(chunk[a:b])
            if i is None:
                break
            if i >= 0:
                yield b, weight[i], i
                single = single or b == a + 1
        if not single:
            yield a + 1, self.unknown + len(chunk[a].encode()), -1

    def edges_into(self, chunk: str, b: int) -> list[tuple[tuple[int, ...], int, int]]:
        """(ids from the end, weight, start) of the edges that end at a place, by ids."""
        get, out, single = self.ids.get, [], False
        for a in range(max(0, b - self.longest), b):
            i = get(chunk[a:b])
            if i is not None:
                out.append(((i,), self.weight[i], a))
                single = single or a == b - 1
        if not single:
            char = chunk[b - 1]
            out.append((self.spelt(char)[::-1], self.unknown + len(char.encode()), b - 1))
        return sorted(out)

    def forward(self, chunk: str) -> tuple[list[int], array, array]:
        """Viterbi: the least weight from the start to each place, and the last edge on the way there
        (start, id). Edges aren't kept: a character takes some 60 bytes."""
        n = len(chunk)
        best, start, ids = [_INF] * (n + 1), array("q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
        best[0] = 0
        for a in range(n):
            base = best[a]
            for b, x, i in self.edges(chunk, a):
                x += base
                if x < best[b] or x == best[b] and i < ids[b]:
                    best[b], start[b], ids[b] = x, a, i
        return best, start, ids

    def search(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations of a chunk: (weight, ids). A-star from the end: what is done, plus
        the forward score of what is left, is the exact weight of a node's best completion. Nodes that
        wait never lead to the same segmentation, so no more of them than segmentations are still
        wanted can matter: the others are dropped. They are kept in the order of their ids from the
        end, which breaks ties. A node links to the one it came from, so it takes little memory in a
        chunk of any length."""
        if len(chunk) <= _LONGEST:
            best, into = self._short(chunk)
            into = into.__getitem__
        else:
            best, into = self.forward(chunk)[0], lambda b: self.edges_into(chunk, b)
        waiting: list[tuple] = [(best[-1], len(chunk), 0, None)]  # (total, place, done, (ids from the end, link))
        out: list = []
        while waiting and len(out) < n:
            totals = [x[0] for x in waiting]
            k = totals.index(min(totals))
            total, at, done, link = waiting[k]
            if at:
                waiting[k : k + 1] = [(done + x + best[a], a, done + x, (ids, link)) for ids, x, a in into(at)]
            else:
                del waiting[k]
                ids = array("I")
                while link:
                    back, link = link
                    ids.extend(back[::-1])
                out.append((total, tuple(ids)))
            left = n - len(out)
            if len(waiting) > left:
                totals = [x[0] for x in waiting]
                waiting = [waiting[i] for i in sorted(sorted(range(len(totals)), key=totals.__getitem__)[:left])]
        return out

    def _short(self, chunk: str) -> tuple[list[int], list[list]]:
        """forward's weights, and edges_into every place, of a short chunk, in one go."""
        n, get, weight = len(chunk), self.prefixes.get, self.weight
        best, into = [_INF] * (n + 1), [[] for _ in range(n + 1)]
        best[0] = 0
        for a in range(n):
            base, single = best[a], False
            for b in range(a + 1, min(n, a + self.longest) + 1):
                i = get(chunk[a:b])
                if i is None:
                    break
                if i >= 0:
                    x = weight[i]
                    into[b].append(((i,), x, a))
                    single = single or b == a + 1
                    if base + x < best[b]:
                        best[b] = base + x
            if not single:
                x = self.unknown + len(chunk[a].encode())
                into[a + 1].append((self.spelt(chunk[a])[::-1], x, a))
                if base + x < best[a + 1]:
                    best[a + 1] = base + x
        for own in into:
            own.sort()
        return best, into

    def best(self, key: str) -> tuple[bytes, int, int]:
        """(ids as bytes, weight, what the second best adds) of a chunk. The second best takes some
        edge off the best path, so it is the least sum of forward score, edge and backward score."""
        chunk = self.chunk(key)
        best, start, last = self.forward(chunk)
        n, total = len(chunk), best[-1]
        ids, path, at = array("I"), bytearray(n + 1), n
        while at:
            ids.extend((last[at],) if last[at] >= 0 else self.spelt(chunk[at - 1])[::-1])
            path[at] = 1
            at = start[at]
        ids.reverse()
        rest, second = [_INF] * (n + 1), _INF
        rest[n] = 0
        for a in range(n - 1, -1, -1):
            for b, x, i in self.edges(chunk, a):
                x += rest[b]
                if x < rest[a]:
                    rest[a] = x
                x += best[a]
                if x < second and not (path[b] and start[b] == a and last[b] == i):
                    second = x
        return ids.tobytes(), total, second - total if second < _INF else _INF

    def best_many(self, keys: list[str]) -> dict[str, tuple[bytes, int, int]]:
        """best() of many chunks. Short ones of Latin-1 are solved side by side, those of one length
        at a time; the steps are those of lattice() and best()."""
        out, by_length = {}, {}
        for k in keys:
            try:
                codes = (k if k[:1] == "\n" else "\0" + k).encode("latin-1")  # fails if k begins with a space mark
                if len(codes) > _SHORT or "\0" in k:
                    raise ValueError
            except ValueError:
                out[k] = self.best(k)
                continue
            if len(codes) in by_length:
                by_length[len(codes)].append((k, codes))
            else:
                by_length[len(codes)] = [(k, codes)]
        for n, group in by_length.items():
            for i in range(0, len(group), 4096):
                part = group[i : i + 4096]
                out.update(zip([k for k, _ in part], self._side_by_side(n, [c for _, c in part])))
        return out

    def _side_by_side(self, n: int, chunks: list[bytes]) -> list[tuple[bytes, int, int]]:
        m = len(chunks)
        codes = np.frombuffer(b"".join(chunks), np.uint8).reshape(m, n).T.astype(np.int64)
        best = np.full((n + 1, m), _FAR, np.int64)
        last_start, last_id = np.zeros((n + 1, m), np.int64), np.full((n + 1, m), -1, np.int64)
        best[0] = 0
        edges = []  # (start, end, which chunks, weights, ids)
        for a in range(n):
            who, node = np.arange(m), np.full(m, self.root, np.int64)
            for b in range(a + 1, n + 1):
                to = self.follow[node, codes[b - 1, who]]
                if b == a + 1:
                    ids, weights, own = self.single[codes[a]], self.single_weight[codes[a]], who
                else:
                    ids = self.piece[to].astype(np.int64)
                    hit = ids >= 0
                    own, ids = who[hit], ids[hit]
                    weights = self.weights[ids]
                if len(own):
                    total = best[a, own] + weights
                    old = best[b, own]
                    better = (total < old) | ((total == old) & (ids < last_id[b, own]))
                    at = own[better]
                    best[b, at], last_start[b, at], last_id[b, at] = total[better], a, ids[better]
                    edges.append((a, b, own, weights, ids))
                node = self.row[to]
                going = node > 0
                if not going.any():
                    break
                who, node = who[going], node[going]
        whole = best[n]
        on_path = np.zeros((n + 1, m), bool)
        on_path[n] = True
        for b in range(n, 0, -1):
            at = np.flatnonzero(on_path[b])
            on_path[last_start[b, at], at] = True
        rest = np.full((n + 1, m), _FAR, np.int64)
        rest[n] = 0
        second = np.full(m, _FAR, np.int64)
        for a, b, own, weights, ids in reversed(edges):
            through = weights + rest[b, own]
            rest[a, own] = np.minimum(rest[a, own], through)
            through = through + best[a, own]
            taken = on_path[b, own] & (last_start[b, own] == a) & (last_id[b, own] == ids)
            through[taken] = _FAR
            second[own] = np.minimum(second[own], through)
        out = []
        starts, last = last_start.T.tolist(), last_id.T.tolist()
        more = np.where(second < _FAR, second - whole, -1).tolist()
        for k, total in enumerate(whole.tolist()):
            at, back = n, []
            while at:
                a, i = starts[k][at], last[k][at]
                back += (i,) if i >= 0 else self.spelt(SPACE if chunks[k][a] == 0 else chr(chunks[k][a]))[::-1]
                at = a
            out.append((array("I", back[::-1]).tobytes(), total, more[k] if more[k] >= 0 else _INF))
        return out

    def merged(self, keys: list[str]) -> list[bytes]:
        """The library's own ids of chunks. It puts a space mark before what it is given, if that isn't
        empty."""
        chunks = [self.chunk(k) for k in keys]
        found = self.model.encode([c[1:].replace(SPACE, " ") if c[0] == SPACE else c for c in chunks], num_threads=1)
        own = lambda c, x: [self.model.piece_to_id(SPACE)] if c == SPACE else x if c[0] == SPACE else x[1:]
        return [array("I", own(c, x)).tobytes() for c, x in zip(chunks, found)]

    def solved(self, keys: list[str]) -> dict[str, tuple[bytes, int, int, bytes]]:
        """best() and, if wanted, merged() of many chunks."""
        best = self.best_many(keys)
        if not self.with_merged:
            return {k: (*x, b"") for k, x in best.items()}
        return {k: (*best[k], best[k][0] if m == best[k][0] else m) for k, m in zip(keys, self.merged(keys))}

    # Texts

    def nbest(self, text: str, n: int) -> tuple:
        return self.nbest_many([text], n)[0]

    def nbest_many(self, texts: list[str], n: int) -> list:
        """For each text: the best segmentation's ids (little-endian, 32 bits), the merged ones; and for
        each of the n best: cost, number of pieces, and what it changes: (first piece, pieces replaced,
        new ids). The chunks that are new to all of them are solved together."""
        keys = [self.keys(x) for x in texts]
        found = [list(map(self.known.get, ks)) for ks in keys]
        missing: set[str] = set()
        for ks, xs in zip(keys, found):
            if None in xs:
                missing.update([k for k, x in zip(ks, xs) if x is None])
        if missing:
            new = self.solved(list(missing))
            found = [[new[k] if x is None else x for k, x in zip(ks, xs)] if None in xs else xs for ks, xs in zip(keys, found)]
            room = self.cached - len(self.known)
            if room > 0:
                self.known.update([x for x in new.items() if len(x[0]) <= _LONGEST][:room])
        return [self.combined(ks, xs, n) for ks, xs in zip(keys, found)]

    def options(self, key: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best of a chunk. The chunks that cost least to change are often the same."""
        if (kept := self.searched.get((key, n))) is None:
            kept = self.search(self.chunk(key), n)
            if len(key) <= _LONGEST:
                if len(self.searched) >= _SEARCHED:
                    self.searched.clear()
                self.searched[key, n] = kept
        return kept

    def combined(self, keys: list[str], found: list[tuple[bytes, int, int, bytes]], n: int) -> tuple:
        """The n best of a text, of its chunks' best."""
        best, weights, more, merged = zip(*found) if found else ((), (), (), ())
        ids = b"".join(best)
        pieces = len(ids) // 4
        cost = (sum(weights) - pieces) >> _BITS
        least = [x for x in sorted(more)[: n - 1] if x < _INF]
        most = least[-1] if least else -1
        places = sorted([(x, -i) for i, x in enumerate(more) if x <= most])[: n - 1]
        front: list[tuple] = [(0, ())]  # (added weight, choice of each place so far)
        order = sorted(-i for _, i in places)
        options = [self.options(keys[i], n) for i in order]
        for option in options:
            grown = [(x + o[0] - option[0][0], (*chosen, r)) for x, chosen in front for r, o in enumerate(option)]
            front = heapq.nsmallest(n, grown)
        starts, at, before = [], 0, 0
        for i in order:
            at += sum(map(len, best[before:i])) // 4
            starts.append(at)
            before = i
        out = []
        for x, chosen in front:
            fewer = (x + (1 << _BITS - 1)) >> _BITS  # the added cost; what is left are added pieces
            changes = [(s, len(option[0][1]), option[r][1]) for s, option, r in zip(starts, options, chosen) if r]
            out.append(((cost + fewer) / self.unit, pieces + x - (fewer << _BITS), changes))
        return ids, b"".join(merged), out

    def decode(self, ids) -> str:
        return joined(self.bytes_of, ids)


def joined(bytes_of: list[bytes], ids) -> str:
    return b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def piece_bytes(model) -> list[bytes]:
    """What each piece of a library's model stands for."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
    return out


def model(path: str, with_merged: bool) -> Pieces:
    """One for each Python worker and file."""
    return held(("pieces", path, with_merged), lambda: Pieces(path, with_merged=with_merged))


NBEST = "struct<ids:binary,merged:binary,nbest:array<struct<score:double,n_pieces:long,changes:array<struct<start:long,length:long,ids:array<int>>>>>>"
_CHANGES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32()))]))
_BEST = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("changes", _CHANGES)]))


def encoded(text: Column, path: str, n: int = 4, with_merged: bool = False) -> Column:
    """Struct column: the best segmentation's ids, with_merged those of the library's encoder (else
    null), and the n best as changes to the first."""

    @arrow_udf(NBEST)
    def run(texts: pa.Array) -> pa.Array:
        p, rows = model(path, with_merged), []
        for a, z in in_portions([x or 0 for x in pc.binary_length(texts).to_pylist()], 1_000_000):
            part = texts.slice(a, z - a).to_pylist()
            with no_collector():
                solved = iter(p.nbest_many([x for x in part if x is not None], n))
            for x in part:
                ids, merged, found = next(solved) if x is not None else (None, None, None)
                best = found and [{"score": -c, "n_pieces": k, "changes": [{"start": s, "length": m, "ids": list(new)} for s, m, new in changes]} for c, k, changes in found]
                rows.append((ids, merged if with_merged else None, best))
        ids, merged, best = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(merged, pa.binary()), pa.array(best, _BEST)], names=["ids", "merged", "nbest"])

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of a column of ids (binary, little-endian, 32 bits)."""

    @arrow_udf("string")
    def run(raws: pa.Array) -> pa.Array:
        import sentencepiece

        bytes_of = held(("bytes", path), lambda: piece_bytes(sentencepiece.SentencePieceProcessor(model_file=path)))
        return pa.array([None if x is None else joined(bytes_of, array("I", x)) for x in each(raws)], pa.string())

    return run(ids)
