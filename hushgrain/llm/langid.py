"""Language identification by prediction by partial matching.

For each language, a tree of byte contexts up to `order` 3 counts which bytes follow. A byte's
probability comes from the longest context that the language knows; a byte not seen there costs an
escape (method C) and is predicted by the next shorter context, without the bytes already excluded.
The statistics are frozen after training, so the code length of a byte depends only on itself and
the three bytes before it, and a text's exact code length under each language is a sum over all of its
bytes. The shortest code wins. What a context's escape costs is one number, so the trees hold lengths
of n-grams that were seen in some language, and an escape for each context; the shorter contexts give
the rest. All contexts that the training texts have are kept.

Training texts are a sample of labelled rows of about `train_docs` per language, chosen by a
hash of their id and text; each is read whole. n-grams are counted in the tasks and added up by Spark;
the driver builds the trees, whose size depends on the sample, not on the corpus. Their sizes are
checked before anything is collected or broadcast (MAX_GRAMS, MAX_BYTES): beyond them training fails
and says so, rather than learn from less.

Nulls and ties: a null text, or one without a letter, is `und` with score 0; equal lengths go to
the language first in order of name; rows with a null label aren't learned from; repeated rows
count as often as they occur. With no training rows every text is `und`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hushgrain.llm.runtime import drop, table, tidy
from hushgrain.llm.worker import each, release

UNKNOWN = "und"
_PAD = b"\n\n\n"
_PORTION = 1 << 20
_ASCII_LETTER = re.compile("[A-Za-z]")


#: Most n-grams, of all languages together, that come to the driver; and most bytes of a model.
MAX_GRAMS, MAX_BYTES = 30_000_000, 1 << 30


@dataclass
class Order:
    """Contexts of some symbols. row: code of a context -> its row, or -1; gram: row * n_symbols + symbol ->
    its place in lengths, or -1; lengths: (n-gram, language); escape: (row, language): what it adds to
    the length after a shorter context."""

    row: np.ndarray
    gram: np.ndarray
    lengths: np.ndarray
    escape: np.ndarray


@dataclass
class Model:
    """symbol: byte -> symbol (the last one for bytes never seen); first: (symbol before * n_symbols +
    symbol, language) -> bits; orders: contexts of two symbols, and of three."""

    langs: list[str]
    symbol: np.ndarray
    first: np.ndarray
    orders: list[Order]
    n_symbols: int
    usual: np.ndarray  # bits a byte of the training texts of each language

    def bits(self, text: str) -> np.ndarray:
        """Code length of the whole text under each language."""
        raw = np.frombuffer(_PAD + text.encode(), np.uint8)
        total, n = np.zeros(len(self.langs)), self.n_symbols
        for i in range(0, len(raw) - 3, _PORTION):
            x = self.symbol[raw[i : i + _PORTION + 3]]
            contexts = [x[1:-2] * n + x[2:-1], (x[:-3] * n + x[1:-2]) * n + x[2:-1]]
            before, own = x[2:-1], x[3:]
            for order, context in zip(reversed(self.orders), reversed(contexts)):
                row = order.row[context]
                found = np.where(row >= 0, order.gram[row * n + own], -1)
                hit = found >= 0
                total += order.lengths[found[hit]].sum(axis=0, dtype=np.float64)
                total += order.escape[row[~hit & (row >= 0)]].sum(axis=0, dtype=np.float64)
                contexts[0], before, own = contexts[0][~hit], before[~hit], own[~hit]
            total += self.first[before * n + own].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        """Language, its posterior under equal priors, and the bits that a byte takes in it, as a multiple
        of what the language's training texts take (null if the language is unknown)."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, None
        bits = self.bits(text)
        best = int(np.argmin(bits))
        strange = float(bits[best] / len(text.encode()) / max(self.usual[best], 1e-9))
        return self.langs[best], float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()), strange


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Every byte with the three before it, as one integer."""
    raw = np.frombuffer(_PAD + text.encode(), np.uint8).astype(np.uint32)
    return (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]


def count_grams(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, gram, n): summed in the tasks first."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for label, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch({"label": pa.array([label] * len(g), pa.string()), "gram": g.astype(np.int64), "n": n})
            held.clear()

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), each(batch.column(1))):
                if text:
                    held.setdefault(label, []).append(grams(text))
                    size += len(text)
                    if size > 8_000_000:
                        yield from out()
                        size = 0
        yield from out()

    rows = docs.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).mapInArrow(run, "label string, gram long, n long")
    return rows.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = 3000) -> Model:
    """docs: labelled rows. train_docs: about so many of them are learned from for each language."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros(256, np.int64), np.zeros((1, 0), np.float32), [], 1, np.zeros(0))
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col(label_col) == label, F.lit(min(1.0, train_docs / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(1 << 20)) < share * (1 << 20)
    counted = table(count_grams(labelled.where(drawn), text_col, label_col), "grams")
    if (n := counted.count()) > MAX_GRAMS:
        raise ValueError(f"{n} n-grams to learn from; at most {MAX_GRAMS} are: fewer train_docs or languages")
    got = counted.toPandas()
    drop(counted)
    model = build(got["label"].to_numpy(), got["gram"].to_numpy(), got["n"].to_numpy(), sorted(sizes))
    del got
    tidy(docs.sparkSession)
    return model


def _below(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with these counts (rows); shorter: those of the contexts one byte
    shorter. Method C, with exclusion: what escapes is shared among the bytes not seen here."""
    total = counts.sum(axis=1, keepdims=True)
    seen = counts > 0
    kinds = seen.sum(axis=1, keepdims=True)
    left = np.where(seen, 0.0, shorter)
    mass = left.sum(axis=1, keepdims=True)
    escape = np.where(mass > 0, kinds / np.maximum(total + kinds, 1), 0.0)
    p = np.where(seen, counts / np.maximum(total, 1) * (1 - escape), escape * left / np.maximum(mass, 1e-300))
    return np.where(total > 0, p, shorter)


class _Grams:
    """The distinct n-grams of one order: contexts, and which symbol follows."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, codes: int, a: int):
        self.contexts, place = np.unique(context, return_inverse=True)
        key, self.of = np.unique(place * a + symbol, return_inverse=True)
        self.context, self.symbol = key // a, key % a  # of each n-gram; the context by its row
        self.row = np.full(codes, -1, np.int32)
        self.row[self.contexts] = np.arange(len(self.contexts))
        self.gram = np.full(len(self.contexts) * a, -1, np.int32)
        self.gram[key] = np.arange(len(key))

    def counted(self, of: np.ndarray, n: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each n-gram, and what each context multiplies the shorter one's by, from one
        language's counts; shorter: what the shorter context gives each n-gram. The rules of _below."""
        c, size = np.bincount(self.of[of], n[of], len(self.context)), len(self.contexts)
        seen = c > 0
        at = lambda x: np.bincount(self.context, x, size)
        total, kinds = at(c), at(seen.astype(np.float64))
        mass = np.maximum(1.0 - at(np.where(seen, shorter, 0.0)), 0.0)
        mass[mass < 1e-9] = 0.0
        escape = np.where(mass > 0, kinds / np.maximum(total + kinds, 1), 0.0)
        factor = np.where(total > 0, escape / np.maximum(mass, 1e-300), 1.0)
        own = self.context
        return np.where(seen, c / np.maximum(total[own], 1) * (1 - escape[own]), factor[own] * shorter), factor


def _bits(p: np.ndarray) -> np.ndarray:
    return -np.log2(np.maximum(p, 1e-30))


def build(label: np.ndarray, gram: np.ndarray, n: np.ndarray, langs: list[str] | None = None) -> Model:
    """From counts of grams by label. The order of rows doesn't matter."""
    langs = sorted(set(label.tolist())) if langs is None else langs
    parts = np.stack([(gram >> k) & 255 for k in (24, 16, 8, 0)])
    known = np.unique(np.concatenate([parts.ravel(), np.frombuffer(_PAD, np.uint8)]))
    symbol = np.full(256, len(known), np.int64)
    symbol[known] = np.arange(len(known))
    a = len(known) + 1
    s = symbol[parts]
    two, three = _Grams(s[1] * a + s[2], s[3], a * a, a), _Grams((s[0] * a + s[1]) * a + s[2], s[3], a**3, a)
    held = sum(4 * (len(x.row) + len(x.gram) + (len(x.context) + len(x.contexts)) * len(langs)) for x in (two, three))
    if held > MAX_BYTES:
        raise ValueError(f"a model of {held} bytes; at most {MAX_BYTES} are broadcast: fewer train_docs or languages")
    uniform = np.ones(a) / 256
    uniform[-1] = max(257 - a, 1) / 256
    shape = lambda rows: np.empty((rows, len(langs)), np.float32)
    first, lengths, escapes = shape(a * a), [shape(len(x.context)) for x in (two, three)], [shape(len(x.contexts)) for x in (two, three)]
    # Where each n-gram of three contexts ends as one of two.
    ending = three.contexts[three.context] % (a * a)
    as_two = two.gram[two.row[ending].astype(np.int64) * a + three.symbol]
    for k, lang in enumerate(langs):
        of = label == lang
        c = n.astype(np.float64)
        p0 = _below(np.bincount(s[3][of], c[of], a)[None, :], uniform[None, :])
        p1 = _below(np.bincount(s[2][of] * a + s[3][of], c[of], a * a).reshape(a, a), np.broadcast_to(p0, (a, a)))
        p2, e2 = two.counted(of, c, p1[two.contexts[two.context] % a, two.symbol])
        p3, e3 = three.counted(of, c, p2[as_two])
        p1[:, -1] /= max(257 - a, 1)  # one byte of those never seen
        first[:, k] = _bits(p1).ravel()
        for order, (p, e) in enumerate(((p2, e2), (p3, e3))):
            lengths[order][:, k], escapes[order][:, k] = _bits(p), _bits(e)
    at = three.gram[three.row[(s[0] * a + s[1]) * a + s[2]].astype(np.int64) * a + s[3]]
    usual = np.array([float((lengths[1][at[label == x], k] * n[label == x]).sum() / max(n[label == x].sum(), 1)) for k, x in enumerate(langs)])
    return Model(langs, symbol, first, [Order(x.row, x.gram, lengths[i], escapes[i]) for i, x in enumerate((two, three))], a, usual)


def predictions(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct column (lang_pred, score, strange) for docs. The model goes to the executors as a broadcast
    variable, of MAX_BYTES at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("strange", pa.float64())]

    @arrow_udf("struct<lang_pred:string,score:double,strange:double>")
    def run(texts: pa.Array) -> pa.Array:
        release()
        cols = list(zip(*map(shared.value.predict, each(texts)))) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], fields=kind)

    return run.asNondeterministic()(F.col(text_col))  # so that Spark doesn't run it again for a filter
