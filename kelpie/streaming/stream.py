"""Structured streaming: files into the index as they arrive, and event-time statistics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpie.functions import sparse
from kelpie.sources import scan, trace
from kelpie.sources.store import ChangeLog, Table, stored


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upserts(stream: DataFrame, table: Table, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the rows of its keys; a batch that runs again gives the same table."""

    def one(batch: DataFrame, _: int) -> None:
        table.replace(keys, batch.dropDuplicates(keys))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_changes(stream: DataFrame, log: ChangeLog, checkpoint: str) -> StreamingQuery:
    """Documents (file_path, content) that arrive: unchanged ones are skipped, changed ones' files and postings replaced.

    A micro-batch writes in proportion to what changes; one that runs again finds nothing to do.
    """

    def one(batch: DataFrame, _: int) -> None:
        own = batch.dropDuplicates(["file_path"]).withColumn("file_hash", F.md5(F.coalesce("content", F.lit(""))))
        status = stored(scan.delta(own, log.read("files").join(own.select("file_path"), "file_path", "left_semi")), "delta")
        fresh = stored(own.join(status.filter("status IN ('new', 'changed')"), "file_path", "left_semi"), "fresh")
        if not fresh.isEmpty():
            gone = status.filter("status = 'changed'").select("file_path")
            log.commit(gone, {"postings": sparse.postings(fresh, "file_path", "content"), "files": fresh.select("file_path", "file_hash")})

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(stream: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Tumbling or sliding counts by event type; what comes later than the watermark is dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def search_records(stream: DataFrame, late: str = "10 minutes", idle_minutes: int = 60) -> DataFrame:
    """trace.RECORD of each search, once it closes: with its end, when that can't be overtaken any more, or after an idle hour.

    The stream is a trace (search_id, timestamp, event, data). A search's events may come in any
    order within the watermark: they are held as (time, event, latency) until the watermark has
    passed its end, and those after the end are left out. A search without an end closes as open
    when nothing has come for idle_minutes. Its state is then gone.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for b in batches:
            for at, event, data in zip(b["timestamp"], b["event"], b["data"], strict=True):
                try:
                    latency = float(json.loads(data or "{}").get("latency_ms") or 0) if event == "llm_call" else 0.0
                except (ValueError, AttributeError):
                    latency = 0.0
                held.append([int(at.value // 1000), event, latency])
        ends = [t for t, e, _ in held if e == "end"]
        if not state.hasTimedOut:
            state.update((json.dumps(held),))
            due = min(ends) // 1000 + 1 if ends else max(t for t, *_ in held) // 1000 + idle_minutes * 60_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
            return
        state.remove()
        own = [x for x in held if not ends or x[0] <= min(ends)]
        count = lambda e: sum(x[1] == e for x in own)
        times = [pd.Timestamp(f(x[0] for x in own), unit="us") for f in (min, max)]
        yield pd.DataFrame({"search_id": [key[0]], "began": [times[0]], "ended": [times[1]], "iterations": [count("iteration")], "llm_calls": [count("llm_call")], "latency_ms": [sum(x[2] for x in own)], "closed": [bool(ends)]})

    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return timed.groupBy("search_id").applyInPandasWithState(one, trace.RECORD, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def to_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
