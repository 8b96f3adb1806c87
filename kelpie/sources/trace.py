"""The search trace: JSON lines in, event statistics out."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "timestamp string, search_id string, event string, data string"


class Trace:
    """Appends events of a search to a local JSON-lines file; a failure to write is no failure to search."""

    def __init__(self, path: str | None):
        self.path = path

    def __call__(self, search_id: str, event: str, **data: object) -> None:
        if not self.path:
            return
        try:
            with Path(self.path).open("a", encoding="utf-8") as f:
                f.write(json.dumps({"timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"), "search_id": search_id, "event": event, "data": json.dumps(data, ensure_ascii=False, default=str)}, ensure_ascii=False) + "\n")
        except OSError:
            pass


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path).withColumn("timestamp", F.to_timestamp("timestamp"))


def hourly(events: DataFrame) -> DataFrame:
    """hour, event_type, n, users, total."""
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """user_id, session (from 1), n, began, ended: a longer gap than gap_minutes begins a session."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(order)
    first = F.when(gap <= F.expr(f"INTERVAL '{gap_minutes}' MINUTE"), 0).otherwise(1)
    own = events.select("user_id", "ts", "event_id").withColumn("first", first).withColumn("session", F.sum("first").over(order))
    return own.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


RECORD = "search_id string, began timestamp, ended timestamp, iterations long, llm_calls long, latency_ms double, closed boolean"


def searches(trace: DataFrame) -> DataFrame:
    """RECORD of each search in a trace (search_id, timestamp, event, data): what happened up to its first end.

    A search without an end is open, and ends with its last event so far. What a trace has of a
    search after its end isn't counted.
    """
    end = F.when(F.col("event") == "end", F.col("timestamp"))
    ends = trace.groupBy("search_id").agg(F.min(end).alias("first_end"))
    own = trace.join(ends, "search_id").filter("first_end IS NULL OR timestamp <= first_end")
    latency = F.when(F.col("event") == "llm_call", F.get_json_object("data", "$.latency_ms").cast("double"))
    return own.groupBy("search_id").agg(
        F.min("timestamp").alias("began"), F.max("timestamp").alias("ended"), F.count_if(F.col("event") == "iteration").alias("iterations"), F.count_if(F.col("event") == "llm_call").alias("llm_calls"),
        F.coalesce(F.sum(latency), F.lit(0.0)).alias("latency_ms"), F.bool_or(F.col("event") == "end").alias("closed"),
    )
