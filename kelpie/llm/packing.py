"""Best-fit packing planned over the histogram of lengths.

The plan sees only how many pieces have each length (at most ``capacity`` counts), places them
by best fit, longest first, and says where the r-th piece of a length goes. Documents then take
their slots by rank within their length. Ranks come from counts of (length, bucket), so that a
length that a third of all pieces share is spread over buckets of bounded size. A piece of the
whole capacity needs no rank: it is a sequence by itself.

Defined results: null or empty text is the end id alone; a very long text is cut into as many
pieces as it needs; repeated rows are packed once each; pieces of one length are ranked by id and
place, then by the checksum of their ids, and pieces that are still equal are the same rows; further columns of the documents are left out; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.llm.common import blocks, stored, texts_of, tidy
from kelpie.llm.tokens import encoder

CAPACITY, END = 2048, 0
#: Pieces that are ranked in one task's group, about.
PER_BUCKET = 1_000


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of slots, rows of (length, first rank, last rank + 1, first sequence, offset, pieces a sequence).

    Bins that look alike are one group (first sequence, how many) under the room they have left.
    Equal pieces fill the tightest group until it has no room, as best fit does one by one.
    """
    room: list[int] = []  # ascending, with groups
    groups: dict[int, list[tuple[int, int]]] = {}
    runs, bins = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in groups:
                groups[left] = []
                insort(room, left)
            groups[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(room, length)
            if at < len(room):
                left = room[at]
                first, n = groups[left].pop()
                if not groups[left]:
                    del groups[left]
                    room.pop(at)
            else:
                left, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            each = min(left // length, todo)
            use = min(n, todo // each)
            runs.append((length, rank, rank + use * each, first, capacity - left, each))
            rank, todo = rank + use * each, todo - use * each
            put(left - each * length, first, use)
            put(left, first + use, n - use)
    return np.array(runs, np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; only documents above the capacity are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        for b in batches:
            ids, texts = b.column("doc_id"), texts_of(b)
            for lo, hi in blocks(texts, 700_000):
                rows, end = [], np.array([END], "<u4").tobytes()
                for i, x in enumerate(enc.batch(texts[lo:hi])):
                    x, step = x.astype("<u4").tobytes() + end, 4 * capacity
                    rows += [(lo + i, at // step, at // 4, len(part := x[at : at + step]) // 4, zlib.crc32(part)) for at in range(0, len(x), step)]
                cols = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *(pa.array(c) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds rank, from 0 within the length. Lengths, and so the broadcast table, are at most the capacity's number."""
    spark = pieces.sparkSession
    buckets = F.broadcast(spark.createDataFrame([(k, -(-n // PER_BUCKET)) for k, n in counts.items()], "length long, buckets long"))
    dealt = pieces.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    order = ("doc_id", "piece", "start", "ids_crc32")  # what is still equal then is the same row, whichever slot it takes
    own = dealt.withColumn("own", F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order)))
    return own.join(before.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("own") - 1 + F.coalesce("before", F.lit(0))).drop("own", "before", "bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    counts.pop(capacity, None)
    runs = plan_best_fit(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    places = ranked(pieces.filter(F.col("length") < capacity), counts).select(*names, "rank")
    used = max((int(r[3] + -(-(r[2] - r[1]) // r[5])) for r in runs), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((runs[:, 1], runs[:, 0]))
        length, first_rank, _, seq, offset, each = runs[order].T
        keys = length * (1 << 48) + first_rank
        for b in batches:
            own, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, own * (1 << 48) + rank, "right") - 1
            nth = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * own)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    shared = places.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = pieces.filter(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)  # stored pieces are numbered alike whenever a task runs again


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(token_pieces(docs, path, capacity), "pieces"), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
