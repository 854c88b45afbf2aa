"""Whole-text tokenization with the tokenizers library, one white-space chunk at a time.

Neither vocabulary that is used here merges across a single space or line feed, so the ids of a
text are the ids of its chunks put together. Chunks repeat, so a bounded table of the chunks seen
last saves most of the work.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hushgrain.llm.worker import held, no_collector

#: Before a line feed or single space that stands between two other characters.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Texts that can't be cut at every space and line feed: with white space at an end, side by side, or
#: of another kind.
_ODD = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# ASCII punctuation, which neither tokenizer joins with letters.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer chunks aren't kept.
_LONGEST = 64
#: Chunks encoded at once.
_JOINED = 128


class ChunkEncoder:
    """text -> bytes of little-endian ids (16 bits if the vocabulary allows it, else 32).

    drops_space: the tokenizer drops white space, so that chunks are encoded without it.
    cached: most chunks kept (about 150 bytes each); frequent chunks come early, so once the table
    is full, chunks that it lacks are encoded for the batch at hand only.
    """

    def __init__(self, path: str, drops_space: bool, cached: int = 350_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # Many chunks are encoded as one text, a special token between each two, as each call costs
        # more than a chunk's own work. Chunks in which such a token might stand go alone.
        special = [i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special]
        self.between = self.tokenizer.id_to_token(special[0]) if special else None
        self.between_id = special[0] if special else -1
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.drops_space, self.cached, self.known = drops_space, cached, {}

    def _keys(self, texts: pa.Array) -> pa.ListArray:
        """Keys of each text's chunks, without a loop in Python. A key stands for itself after a space;
        for itself alone if it begins with a line feed; for what follows if it begins with two."""
        if self.drops_space:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        marked = pc.binary_join_element_wise("\n\n", pc.replace_substring(texts, "\n", " \n"), "")
        return pc.split_pattern(marked, " ")

    def _odd_keys(self, text: str) -> list[str]:
        return ["\n\n" + x for x in _CUT.split(text)]

    def chunk(self, key: str) -> str:
        if self.drops_space:
            return key
        return key[2:] if key[:2] == "\n\n" else key if key[:1] == "\n" else " " + key

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null is an empty text."""
        if not len(texts):
            return []
        with no_collector():
            texts = pc.fill_null(texts, "")
            odd = [] if self.drops_space else pc.indices_nonzero(pc.match_substring_regex(texts, _ODD)).to_pylist()
            if odd:
                plain = np.ones(len(texts), bool)
                plain[odd] = False
                texts_ = pc.if_else(pa.array(plain), texts, "")
            else:
                texts_ = texts
            keys = self._keys(texts_)
            flat = keys.flatten().dictionary_encode()
            values = pa.array(self._values(flat.dictionary.to_pylist()), pa.binary()).take(flat.indices)
            ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
            at = ends[np.asarray(keys.offsets) - keys.offsets[0].as_py()].tolist()
            data = values.buffers()[2]
            raw = memoryview(data) if data is not None else memoryview(b"")
            out = [bytes(raw[x:y]) for x, y in zip(at, at[1:])]
            for i in odd:
                out[i] = b"".join(self._values(self._odd_keys(texts[i].as_py())))
            pa.default_memory_pool().release_unused()
            return out

    def _values(self, keys: list[str]) -> list[bytes]:
        """Ids of chunks; those that are new are encoded together, and kept while there is room. A word
        with punctuation after it is two tokens before merging, so the word alone may be known."""
        known, alone = self.known, "" if self.drops_space else "\n\n"
        found = list(map(known.get, keys))
        if None in found:
            new, parts = {}, {}
            for k in {k for k, v in zip(keys, found) if v is None}:
                word = k.rstrip(_PUNCTUATION)
                if len(word) < len(k) and word.isalpha():
                    tail = alone + k[len(word) :]
                    parts[k] = word, tail
                    if word not in known:
                        new[word] = None
                    if tail not in known:
                        new[tail] = None
                else:
                    new[k] = None
            new = self._new(list(new))
            self._keep(new, self.cached)
            whole = {}
            for k, (word, tail) in parts.items():
                a, b = known.get(word), known.get(tail)
                whole[k] = (new[word] if a is None else a) + (new[tail] if b is None else b)
            self._keep(whole, self.cached // 2)
            new.update(whole)
            found = [new[k] if v is None else v for k, v in zip(keys, found)]
        return found

    def _keep(self, new: dict[str, bytes], most: int) -> None:
        room = most - len(self.known)
        if room > 0:
            self.known.update([x for x in new.items() if len(x[0]) <= _LONGEST][:room])

    def _new(self, names: list[str]) -> dict[str, bytes]:
        alone = [k for k in names if self.between is None or self.between[:2] in k]
        out = {k: array(self.code, self.tokenizer.encode(self.chunk(k), add_special_tokens=False).ids).tobytes() for k in alone}
        if alone:
            names = [k for k in names if k not in out]
        width = self.dtype.itemsize
        self.tokenizer.encode_special_tokens = False
        for i in range(0, len(names), _JOINED):
            part = names[i : i + _JOINED]
            (found,) = self.tokenizer.encode_batch_fast([self.between.join(map(self.chunk, part))], add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            raw, at = ids.tobytes(), 0
            for k, end in zip(part, [*np.flatnonzero(ids == self.between_id).tolist(), len(ids)]):
                out[k] = raw[at * width : end * width]
                at = end + 1
        self.tokenizer.encode_special_tokens = True
        return out


def encoder(path: str, drops_space: bool, cached: int = 350_000) -> ChunkEncoder:
    """One for each Python worker and file."""

    def make() -> ChunkEncoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return ChunkEncoder(path, drops_space, cached)

    return held(("chunks", path, drops_space, cached), make)


def in_portions(lengths: list[int], limit: int = 2_000_000):
    """Index ranges whose lengths add up to about limit: bounds what is held at once."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)
