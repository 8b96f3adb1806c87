"""Dense vectors for texts: a deterministic offline default and a hook for real models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kelpie.functions.batches import pieces, tidy
from kelpie.functions.sparse import term_number_of, tokens_of

DIMENSION = 64
#: Bytes of text that are with the model at a time, but for a single text of more.
PIECE_BYTES = 4_000_000
Embedder = Callable[[Sequence[str]], np.ndarray]


def hashing_embedder(texts: Sequence[str]) -> np.ndarray:
    """Signed hashing of tokens to 64 dimensions, unit length; a text without tokens is the zero vector."""
    out = np.zeros((len(texts), DIMENSION))
    cache: dict[str, int] = {}
    for row, t in zip(out, texts, strict=True):
        for w in tokens_of(t):
            n = cache.get(w)
            if n is None:
                n = cache[w] = term_number_of(w)
            row[n % DIMENSION] += 1 if n // DIMENSION % 2 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def with_retry(model: Embedder, retryable: type[Exception] | tuple = Exception, tries: int = 5, wait: float = 10.0, longest: float = 120.0) -> Embedder:
    """The model, tried again after doubling waits when it fails in a way that may pass, as a service does at its rate limit."""

    def run(texts: Sequence[str]) -> np.ndarray:
        pause = wait
        for left in range(tries - 1, -1, -1):
            try:
                return model(texts)
            except retryable:
                if not left:
                    raise
                time.sleep(pause)
                pause = min(2 * pause, longest)
        raise AssertionError

    return run


def embed(df: DataFrame, text: str = "content", embedder: Embedder = hashing_embedder, batch: int = 100) -> DataFrame:
    """Adds embedding; the model is called with up to ``batch`` texts at a time, fewer where they are long, on the executors."""
    schema = df.drop("embedding").schema.add("embedding", T.ArrayType(T.DoubleType()))
    names = [c for c in df.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, pc.binary_length(whole.column(text)), PIECE_BYTES, batch)):
            rows = np.asarray(embedder([t or "" for t in b.column(text).to_pylist()]), float).tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(rows, pa.list_(pa.float64()))], [*names, "embedding"])

    return df.mapInArrow(tidy(run), schema)
