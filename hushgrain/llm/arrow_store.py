"""Token ids on disk: Arrow streams of fixed-size lists.

Documents are encoded in ascending order of their ids and laid end to end. Each task writes one
stream whose record batches hold equal-length sequences (`ids`) and their masks (`mask`, false
where the last sequence is padded), and a second, small stream with each document's place. A local
stream is memory-mapped: any sequence is a view on the file, found by arithmetic alone.

A task writes under a name of its own and reports it, so what a lost or repeated attempt leaves
behind is never read. Texts are shuffled once, by ranges of doc_id.

Nulls and ties: a null text is an empty one; each document has its end id at least; null ids come
first and repeated ids lie side by side, ordered by a hash of their text. An empty table gives no
rows.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.llm.chunks import encoder, in_portions

#: Sequences in a record batch.
BATCH = 256


def _fs(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Part:
    """One task's files, and where its ids begin in the whole."""

    number: int
    ids_file: str
    docs_file: str
    n_docs: int
    n_tokens: int
    start: int = 0


class StreamWriter:
    """Writes ids as sequences of `length`; memory is bounded by one record batch."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held, self.n_held, self.total = [], 0, 0

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        n = len(raw) // self.dtype.itemsize
        self.n_held += n
        self.total += n
        if self.n_held >= self.length * BATCH:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        size = self.length * BATCH
        whole = len(ids) if last else len(ids) // size * size
        for i in range(0, whole, size):
            part = ids[i : i + size]
            rows = -(-len(part) // self.length)
            mask = np.zeros(rows * self.length, bool)
            mask[: len(part)] = True
            full = np.zeros(rows * self.length, self.dtype)
            full[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        rest = ids[whole:]
        self.held, self.n_held = [rest.tobytes()] if len(rest) else [], len(rest)

    def close(self) -> None:
        self._flush(last=True)
        self.out.close()


class Sequences:
    """Random access to a stream's sequences; views on the mapped file if it is local."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids of sequence i (a numpy view) and its mask (an Arrow view)."""
        b, r = self.batches[i // BATCH], i % BATCH
        ids, mask = (b.column(k).values.slice(r * self.length, self.length) for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """ids start to stop of the stream; a view unless they cross a record batch."""
        size, out = self.length * BATCH, []
        while start < stop:
            b, at = divmod(start, size)
            n = min(stop - start, size - at)
            out.append(self.batches[b].column(0).values.slice(at, n).to_numpy(zero_copy_only=True))
            start += n
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, drops_space: bool, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> list[Part]:
    """Encodes docs and writes them to folder, which all executors reach. Returns the parts in
    order (one small row for each file comes to the driver)."""

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer, drops_space, cached=600_000)
        end = np.array([end_id], encode.dtype).tobytes()
        number, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{folder}/part-{number:06d}-{own}{x}.arrow" for x in ("", "-docs")]
        fs, paths = None, []
        for uri in names:
            fs, path = _fs(uri)
            paths.append(path)
        fs.create_dir(paths[0].rpartition("/")[0], recursive=True)
        n_docs = 0
        with fs.open_output_stream(paths[0]) as a, fs.open_output_stream(paths[1]) as b:
            ids_out, docs_out = StreamWriter(a, encode.dtype, length), pa.ipc.new_stream(b, _DOCS)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for i, j in in_portions([x or 0 for x in pc.binary_length(texts).to_pylist()], 4_000_000):
                    raws = encode.encode(texts.slice(i, j - i))
                    starts = []
                    for raw in raws:
                        starts.append(ids_out.total)
                        ids_out.add(raw + end)
                    sizes = np.diff([*starts, ids_out.total])
                    docs_out.write_batch(pa.record_batch([ids.slice(i, j - i), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_DOCS))
                    n_docs += len(raws)
            ids_out.close()
            docs_out.close()
        if n_docs:
            yield pa.record_batch({"number": [number], "ids_file": [names[0]], "docs_file": [names[1]], "n_docs": [n_docs], "n_tokens": [ids_out.total]})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    found = ordered.mapInArrow(run, "number long, ids_file string, docs_file string, n_docs long, n_tokens long").collect()
    parts, at = [], 0
    for r in sorted(found, key=lambda r: r.number):
        parts.append(Part(*r, start=at))
        at += r.n_tokens
    return parts


def read_documents(spark: SparkSession, parts: list[Part], checksum: bool = False) -> DataFrame:
    """Each document as the files have it: doc_id, start (in the whole), n_tokens, and ids (binary,
    little-endian, 32 bits) or, with checksum, only their crc32."""
    last = ("ids_crc32", pa.int64()) if checksum else ("ids", pa.binary())
    schema = pa.schema([*_DOCS, pa.field(*last)])

    def run(batches):
        for batch in batches:
            for ids_file, docs_file, base in zip(*(c.to_pylist() for c in batch.columns)):
                ids = Sequences(ids_file)
                fs, path = _fs(docs_file)
                with fs.open_input_file(path) as f:
                    for docs in pa.ipc.open_stream(f):
                        start, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        raws = (ids.tokens(a, a + k).astype("<u4").tobytes() for a, k in zip(start.tolist(), n.tolist()))
                        got = pa.array([zlib.crc32(x) for x in raws] if checksum else list(raws), last[1])
                        yield pa.record_batch([docs.column(0), pa.array(start + base), docs.column(2), got], schema=schema)

    files = spark.createDataFrame([(p.ids_file, p.docs_file, p.start) for p in parts], "ids_file string, docs_file string, start long")
    return files.repartition(max(1, len(parts))).mapInArrow(run, f"doc_id long, start long, n_tokens long, {last[0]} {'long' if checksum else 'binary'}")
