import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from kelpie.operators import evidence, retrieval
from kelpie.sources import trace
from kelpie.sources.cache import EmbeddingCache
from kelpie.streaming import stream


def test_merged_analyses_do_not_depend_on_order(spark):
    schema = "search_id string, persona string, priority int, subject string, actors array<struct<name:string,role:string>>, covered array<string>, gaps array<string>, reasoning string"
    rows = [
        ("s", "risk", 2, "late subject", [("A", "late"), ("C", "x")], ["c3", "c1"], ["g1"], "why"),
        ("s", "flow", 1, "", [("A", "first"), ("B", "y"), (None, "nobody")], ["c1", "c2", ""], [], None),
        ("s", "data", 1, "first subject", None, None, ["g2", "g1"], "because"),
    ]
    want = ("s", "first subject", [("A", "first"), ("B", "y"), ("C", "x")], ["c1", "c2", "c3"], ["g2", "g1"], "[data] because | [risk] why")
    for order in itertools.permutations(rows):
        (r,) = evidence.merge_analyses(spark.createDataFrame([*order, ("t", "flow", 1, None, [], [], [], "")], schema)).filter("search_id = 's'").collect()
        assert (r["search_id"], r["subject"], [tuple(a) for a in r["actors"]], r["covered"], r["gaps"], r["reasoning"]) == want
    (t,) = evidence.merge_analyses(spark.createDataFrame([("t", "flow", 1, None, [], None, [], "")], schema)).collect()
    assert tuple(t) == ("t", "", [], [], [], "")


def test_one_model_a_worker_and_rules_without_one(spark, tmp_path):
    hits = spark.createDataFrame([(k, "word " * (k % 7), 1.0) for k in range(60)], "doc_id long, text string, score double").repartition(12)
    folder = str(tmp_path)

    def make():
        (tmp_path.__class__(folder) / f"{os.getpid()}-{os.urandom(4).hex()}").touch()
        return lambda pairs: [len(t) for _, t in pairs]

    rank = retrieval.make_reranker("lengths", make, needs=["json"])
    best = rank(hits, "word", m=5)
    want = sorted(((k % 7) * 5.0 for k in range(60)), reverse=True)[:5]
    assert [r["score_rerank"] for r in best.collect()] == want
    made = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(made) == len(set(made)) < 12
    with pytest.warns(UserWarning, match="no_such_module_at_all"):
        rules = retrieval.make_reranker("lengths", make, needs=["no_such_module_at_all"])
    assert rules(hits, "word", m=3).count() == 3 and retrieval.make_reranker(None)(hits, "word", m=2).count() == 2


def test_cache_counts_what_goes_to_the_model(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "c"), "m")
    rows = spark.createDataFrame([("abcd efgh",), ("abcd efgh",), ("x",), (None,)], "content string")
    assert cache.embed(rows).count() == 4
    assert cache.counters == {"embedded": 3, "tokens": 2}
    assert cache.embed(spark.createDataFrame([("abcd efgh",), ("new text",)], "content string")).count() == 2
    assert cache.counters == {"embedded": 4, "tokens": 4}


EVENTS = [
    ("a", "2024-01-01 10:00:00", "start", None), ("a", "2024-01-01 10:00:02", "llm_call", '{"latency_ms": 12.5}'), ("a", "2024-01-01 10:00:01", "iteration", "{}"), ("b", "2024-01-01 10:00:30", "start", None),
    ("a", "2024-01-01 10:00:03", "end", None), ("a", "2024-01-01 10:00:09", "llm_call", '{"latency_ms": 99}'), ("b", "2024-01-01 10:01:00", "iteration", "not json"), ("b", "2024-01-01 10:01:00", "llm_call", "not json"),
    ("c", "2024-01-01 12:30:00", "start", None), ("c", "2024-01-01 12:30:01", "end", None), ("d", "2024-01-01 18:00:00", "start", None),
]


def test_streamed_search_records_equal_the_batch(spark, tmp_path):
    schema = "search_id string, timestamp timestamp, event string, data string"
    whole = spark.createDataFrame(EVENTS, "search_id string, timestamp string, event string, data string").withColumn("timestamp", F.to_timestamp("timestamp"))
    for k, (lo, hi) in enumerate(((0, 4), (4, 8), (8, 10), (10, 11))):
        part = spark.createDataFrame(EVENTS[lo:hi], "search_id string, timestamp string, event string, data string").withColumn("timestamp", F.to_timestamp("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(max((tmp_path / "in").glob("part-*.parquet"), key=os.path.getmtime), (10**9 + k, 10**9 + k))
    got = []
    q = stream.to_batches(stream.search_records(stream.parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)), lambda b, _: got.extend(map(tuple, b.collect())), str(tmp_path / "cp"))
    q.awaitTermination(240)
    want = {r["search_id"]: tuple(r) for r in trace.searches(whole).collect()}
    assert want["a"][3:] == (1, 1, 12.5, True) and want["b"][3:] == (1, 1, 0.0, False)
    closed = {r[0]: r for r in got}
    assert len(got) == len(closed) and set(closed) >= {"a", "b"} and "d" not in closed
    assert all(want[k] == r for k, r in closed.items())


def test_a_trace_is_read_into_records(spark, tmp_path):
    log = trace.Trace(str(tmp_path / "t.jsonl"))
    for event, data in (("start", {"query": "é"}), ("iteration", {}), ("llm_call", {"latency_ms": 3}), ("end", {"success": True})):
        log("s1", event, **data)
    (r,) = trace.searches(trace.read(spark, log.path)).collect()
    assert (r["search_id"], r["iterations"], r["llm_calls"], r["latency_ms"], r["closed"]) == ("s1", 1, 1, 3.0, True)
