"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where a local session names none (as in tests) a temporary folder is set; a cluster's must name one.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='kelpie-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def blocks(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, to bound a kernel's memory."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, which gives freed memory back to the system after a partition: workers live on and share an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def crc32_mod(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string")) % n


def code_points(text: str) -> np.ndarray:
    """Code points as unsigned integers; lone surrogates pass."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Longer texts, in bytes, teach nothing (they are scored like any), so that a sample's size is bounded.
TEACH_BYTES = 32_768


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, holdout: Column, per_class: int, max_bytes: int = TEACH_BYTES) -> DataFrame:
    """At most per_class labelled documents of either class, by a hash of the id, of at most max_bytes each.

    Texts are read only for the chosen ids, whose number the parameter bounds. Rows with a
    null label, and repeated ids beyond the first (of documents the smallest text), teach nothing.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(~holdout & F.col("y").isin(0, 1)).dropDuplicates(["doc_id"])
    picks = [own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = picks[0].union(picks[1])
    short = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes)
    rows = short.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one a task and id before anything moves
