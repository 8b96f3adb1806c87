"""Token ids in Arrow stream files of equal-length sequences.

A shard is two Arrow IPC streams: ``tokens-NAME.arrows`` with record batches of fixed-size lists
(``ids``, in the narrowest unsigned type the vocabulary fits, and ``mask``, false on padding),
and ``docs-NAME.arrows`` (doc_id, start, n_tokens: a document's place among the shard's ids). All
batches but the last hold equally many sequences, so that sequence i lies in batch
``i // ROWS`` at row ``i % ROWS``; buffers are uncompressed and a memory-mapped shard is read
without a copy. Documents lie in ascending order of id across and within shards. A shard ends
with the document that brings it to ``shard_ids`` ids; a task writes as many as it needs.

Defined results: null or empty text is the end id alone; null ids come first; equal ids are
ordered by their texts' hashes; a very long text makes its shard longer, as no document is cut;
further columns of the documents are not read; an empty table gives no rows. Every attempt of a
task writes files of its own name, the driver's table lists those of the attempt that counted,
and what others left is removed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import blocks, shared_dir, texts_of, tidy
from kelpie.llm.tokens import encoder

SEQUENCE, ROWS, END = 2048, 256, 0
#: Ids of a shard, about: a reader on a remote store holds two bytes an id.
SHARD_IDS = 1 << 25


class ShardWriter:
    def __init__(self, out, id_type: np.dtype, length: int):
        self.length, self.dtype = length, id_type
        item = pa.from_numpy_dtype(id_type)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.n += len(ids)
        if self.n >= 4 * ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        size = ROWS * self.length
        whole = len(ids) if last else len(ids) // size * size
        for at in range(0, whole, size):
            part = ids[at : min(at + size, whole)]
            mask = np.ones(-(-len(part) // self.length) * self.length, bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(len(mask) - len(part), self.dtype)])
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.waiting, self.n = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


class ShardReader:
    """Sequences of a shard by number; local files are mapped, not read."""

    def __init__(self, folder: str, shard: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        name = f"{path}/tokens-{shard}.arrows"
        source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(len(b) for b in self.batches)

    def _column(self, name: str, i: int) -> pa.Array:
        return self.batches[i // ROWS].column(name)[i % ROWS].values

    def ids(self, i: int) -> np.ndarray:
        return self._column("ids", i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> np.ndarray:
        return self._column("mask", i).to_numpy(zero_copy_only=False)


class Shard:
    """A shard's two files while they are written."""

    def __init__(self, fs: pafs.FileSystem, root: str, name: str, id_type: np.dtype, length: int, key: pa.DataType):
        self.name, self.n_docs, self.at = name, 0, 0
        self.files = [fs.open_output_stream(f"{root}/{x}-{name}.arrows") for x in ("tokens", "docs")]
        self.tokens = ShardWriter(self.files[0], id_type, length)
        self.rows = pa.ipc.new_stream(self.files[1], pa.schema([("doc_id", key), ("start", pa.int64()), ("n_tokens", pa.int64())]))

    def add(self, keys: pa.Array, coded: list[np.ndarray]) -> None:
        sizes = np.array([len(x) + 1 for x in coded], np.int64)
        starts = self.at + np.cumsum(sizes) - sizes
        self.rows.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(sizes)], ["doc_id", "start", "n_tokens"]))
        for x in coded:
            self.tokens.add(np.append(x, np.uint32(END)))
        self.at, self.n_docs = self.at + int(sizes.sum()), self.n_docs + len(coded)

    def close(self) -> None:
        self.tokens.close()
        self.rows.close()
        for f in self.files:
            f.close()


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, length: int = SEQUENCE, keeps_space: bool = True, vocabulary: int = 50_257, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode and write; gives the shards: shard (its name), first (ids before it), n_docs, n_tokens, folder."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    id_type, call = np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32), uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        enc, done, shard = encoder(path, keeps_space), [], None
        for b in batches:
            keys, texts = b.column("doc_id"), texts_of(b)
            for lo, hi in blocks(texts, 700_000):
                coded = enc.batch(texts[lo:hi])
                at = 0
                while at < len(coded):  # up to the document that fills the shard
                    shard = shard or Shard(fs, root, f"{call}-{part:06d}-{len(done):05d}-{attempt}", id_type, length, keys.type)
                    full = shard.at + np.cumsum([len(x) + 1 for x in coded[at:]])
                    n = min(int(np.searchsorted(full, shard_ids)) + 1, len(coded) - at)
                    shard.add(keys.slice(lo + at, n), coded[at : at + n])
                    at += n
                    if shard.at >= shard_ids:
                        shard.close()
                        done.append(shard)
                        shard = None
        if shard:
            shard.close()
            done.append(shard)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x.name for x in done]), pa.array([x.n_docs for x in done], pa.int64()), pa.array([x.at for x in done], pa.int64())], ["shard", "n_docs", "n_tokens"])

    order = ["doc_id", "order"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("order")).repartitionByRange(*order).sortWithinPartitions(*order)
    shards = sorted(map(tuple, dealt.select("doc_id", "text").mapInArrow(tidy(run), "shard string, n_docs long, n_tokens long").collect()))  # a row a shard
    first, rows = 0, []
    for shard, n_docs, n in shards:
        rows.append((shard, first, n_docs, n, folder))
        first += n
    sweep(folder, call, {r[0] for r in rows})
    return spark.createDataFrame(rows, "shard string, first long, n_docs long, n_tokens long, folder string")


def sweep(folder: str, call: str, shards: set[str]) -> None:
    """Remove what the call's attempts that didn't count have left; one that still writes is in nobody's way."""
    fs, root = pafs.FileSystem.from_uri(folder)
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        name = f.base_name.removesuffix(".arrows").partition("-")[2]
        if name.startswith(f"{call}-") and name not in shards:
            fs.delete_file(f.path)


def read_tokens(shards: DataFrame, id_type: str = "long") -> DataFrame:
    """A row a document from the files: doc_id (of the type it was written with), start, n_tokens, ids_crc32, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from read_shard(row["folder"], row["shard"], row["first"])

    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInArrow(tidy(run), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, shard string")


def read_shard(folder: str, shard: str, first: int) -> Iterator[pa.RecordBatch]:
    fs, path = pafs.FileSystem.from_uri(folder)
    sequences = ShardReader(folder, shard)
    flat = [b.column("ids").flatten().to_numpy(zero_copy_only=True) for b in sequences.batches]
    size = ROWS * sequences.length
    with fs.open_input_file(f"{path}/docs-{shard}.arrows") as f:
        for b in pa.ipc.open_stream(f):
            starts, sizes = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
            crcs = []
            for at, end in zip(starts.tolist(), (starts + sizes).tolist(), strict=True):
                crc = 0
                while at < end:
                    k, own = divmod(at, size)
                    part = flat[k][own : own + end - at]
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    at += len(part)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(starts + first), b.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array([shard] * len(starts), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(shards).select("doc_id", "start", "n_tokens", "ids_crc32")
