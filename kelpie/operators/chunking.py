"""Table functions over files (file_path, content): symbols, relations, errors, bounded chunks.

Each file is split by itself in an Arrow kernel; a file that fails gives an error row and no
other file is touched. Null and blank contents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators import chunkers

RECORD = "file_path string, record string, name string, node_type string, content string, parent string, namespace string, fqn string, start_line int, end_line int, chunk_index int, total_chunks int, source string, target string"
FIELDS = [x.split() for x in RECORD.split(", ")]
ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in FIELDS])


def records(files: DataFrame) -> DataFrame:
    """Symbols, edges and errors of all files in one table, told apart by ``record``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    parsed = chunkers.parse(path or "", text or "")
                except Exception as e:  # one file's fault stays its own
                    rows.append({"file_path": path, "record": "error", "content": f"{type(e).__name__}: {e}"})
                    continue
                n = len(parsed.symbols)
                rows += [{"file_path": path, "record": "symbol", "name": s.name, "node_type": s.node_type, "content": s.content, "parent": s.parent, "namespace": s.namespace, "fqn": s.fqn, "start_line": s.start_line, "end_line": s.end_line, "chunk_index": k, "total_chunks": n} for k, s in enumerate(parsed.symbols)]
                rows += [{"file_path": path, "record": "edge", "node_type": e.type, "source": e.source, "target": e.target} for e in parsed.edges]
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.select("file_path", "content").mapInArrow(run, RECORD)


def symbols(files: DataFrame) -> DataFrame:
    return records(files).filter("record = 'symbol'").drop("record", "source", "target")


def relations(files: DataFrame) -> DataFrame:
    return records(files).filter("record = 'edge'").select("file_path", F.col("node_type").alias("type"), "source", "target")


def token_chunks(files: DataFrame, limit: int, overlap: int = 50) -> DataFrame:
    """file_path, chunk_index (from 1), total_chunks, content: chunks of at most limit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                parts = chunkers.bounded_chunks(path or "", text or "", limit, overlap)
                rows += [{"file_path": path, "chunk_index": k, "total_chunks": len(parts), "content": p} for k, p in enumerate(parts, 1)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_path", pa.string()), ("chunk_index", pa.int32()), ("total_chunks", pa.int32()), ("content", pa.string())]))

    return files.select("file_path", "content").mapInArrow(run, "file_path string, chunk_index int, total_chunks int, content string")


def two_phase(files: DataFrame, covered: DataFrame) -> DataFrame:
    """Records of the files that no project analyser's artifact (file_path) covers; the artifacts' own come in elsewhere."""
    return records(files.join(covered.select("file_path").distinct(), "file_path", "left_anti"))
