"""Filtered top-k retrieval by terms, vectors and substrings; fusion and merging of results.

Queries are a small relation (query_ord, query, ...) on the driver's side; every function plans
one DataFrame over all of them. Top-k windows keep at most k rows a query and task before they
shuffle (Spark's window group limit). Ties go to the smaller key.
"""

from __future__ import annotations

import importlib.util
import warnings
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.sparse import term_number_of, tokens_of

#: Queries that go to all tasks together at most; more run in blocks.
MAX_QUERIES = 4096


def filters(spec: Mapping[str, object] | None) -> Column:
    """All keys must hold; a list means any of its values; None is skipped."""
    own = [(F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v) for k, v in (spec or {}).items() if v is not None]
    return reduce(lambda a, b: a & b, own, F.lit(True))


def top_k(hits: DataFrame, k: int, key: str, score: str = "score", by: str = "query_ord") -> DataFrame:
    """The k best rows of each query, with rank from 1."""
    order = W.partitionBy(by).orderBy(F.desc(score), key)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def query_terms(spark: SparkSession, queries: Sequence[tuple[int, str]]) -> DataFrame:
    """(query_ord, term, q_tf) of the queries' tokens."""
    rows = [(i, t, n) for i, q in queries for t, n in Counter(map(term_number_of, tokens_of(q))).items()]
    return spark.createDataFrame(rows, "query_ord int, term int, q_tf long")


def keyword_scores(postings: DataFrame, idf: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(query_ord, key, score): sums of query frequency x whole-number idf x document frequency.

    The idf of the queries' few terms reaches the postings by a join on term, and scores add up
    before they shuffle.
    """
    weighted = terms.join(idf.select("term", "idf_q"), "term").select("query_ord", "term", (F.col("q_tf") * F.col("idf_q")).alias("w"))
    return postings.join(weighted, "term").groupBy("query_ord", key).agg(F.sum(F.col("w") * F.col("tf")).alias("score"))


def keyword_top_k(postings: DataFrame, idf: DataFrame, terms: DataFrame, key: str, k: int) -> DataFrame:
    return top_k(keyword_scores(postings, idf, terms, key), k, key)


def semantic_top_k(vectors: DataFrame, key: str, vector: str, queries: Sequence[tuple[int, Sequence[float]]], k: int, where: Column | None = None) -> DataFrame:
    """Exact cosine top-k of all queries over all vectors, scores rounded to six digits.

    A task multiplies its batch by the matrix of queries and hands on at most k rows a query
    and batch, so what shuffles follows queries and tasks and not vectors.
    """
    spark, out = vectors.sparkSession, None
    source = vectors.filter(where) if where is not None else vectors
    for lo in range(0, max(1, len(queries)), MAX_QUERIES):
        part = queries[lo : lo + MAX_QUERIES]
        ords = np.array([q[0] for q in part], np.int32)
        q = np.array([q[1] for q in part], np.float64).reshape(len(part), -1)
        shared = spark.sparkContext.broadcast((ords, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ords, q = shared.value
            for b in batches:
                if not b.num_rows or not len(ords):
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = np.round(q @ v.T, 6)
                order = np.stack([np.lexsort((ids, -row))[:k] for row in s])
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ords, n)), pa.array(ids[order.ravel()]), pa.array(np.take_along_axis(s, order, 1).ravel())], ["query_ord", key, "score"])

        kind = vectors.schema[key].dataType.simpleString()
        own = source.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"query_ord int, {key} {kind}, score double")
        out = own if out is None else out.unionByName(own)
    return top_k(out, k, key)


def reciprocal_rank_fusion(legs: Sequence[DataFrame], key: str, n: int, k: int = 60) -> DataFrame:
    """Sum over the legs of 1 / (k + rank), rounded to nine digits; the n best of each query."""
    ranks = reduce(DataFrame.unionByName, [x.select("query_ord", key, "rank") for x in legs])
    fused = ranks.groupBy("query_ord", key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    return top_k(fused, n, key)


def exact_top_k(candidates: DataFrame, texts: DataFrame, key: str, queries: Sequence[tuple[int, str]], n: int, preview: int | None = None) -> DataFrame:
    """Candidates (query_ord, key, rank) whose text, or its first preview characters, holds the query in any case come first.

    Quotes around a query are dropped. Where fewer than half of n are hits, other candidates fill
    up to n, marked exact_match = false.
    """
    spark = candidates.sparkSession
    needles = spark.createDataFrame([(i, q.strip("\"'`").lower()) for i, q in queries], "query_ord int, needle string")
    found = candidates.join(F.broadcast(needles), "query_ord").join(texts.select(key, F.lower(F.substring("text", 1, preview) if preview else F.col("text")).alias("head")), key)
    found = found.withColumn("exact_match", F.coalesce(F.contains("head", F.col("needle")), F.lit(False)))
    by = W.partitionBy("query_ord")
    found = found.withColumn("hits", F.count_if("exact_match").over(by))
    found = found.filter(F.col("exact_match") | (F.col("hits") < n // 2))
    order = by.orderBy(F.desc("exact_match"), "rank", key)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("query_ord", key, "exact_match", F.col("place").alias("rank"))


def merge(hits: DataFrame, key: str) -> DataFrame:
    """Of each key the first query's hit, all of them by score and then as they came."""
    first = W.partitionBy(key).orderBy("query_ord", "rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.orderBy(F.desc("score"), "query_ord", "rank")


def quota(top_n: int, n_queries: int, default: int = 100) -> int:
    """Each query's share of the results asked for; none left means the default."""
    return top_n // max(1, n_queries) or default


def simple_rerank(hits: DataFrame, query: str, text: str = "text", score: str = "score", m: int | None = 20, key: str = "doc_id") -> DataFrame:
    """Adds score_rerank: the score, 0.1 for each distinct query term and 0.3 for the whole query found in the text."""
    q = query.lower()
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    terms = F.array(*map(F.lit, sorted(set(q.split())))) if q.split() else F.array().cast("array<string>")
    bonus = F.size(F.filter(terms, lambda x: F.contains(t, x))) * 0.1 + F.when(F.contains(t, F.lit(q)), 0.3).otherwise(0.0)
    out = hits.withColumn("score_rerank", F.round(F.coalesce(F.col(score).cast("double"), F.lit(0.0)) + bonus, 6))
    return out.orderBy(F.desc("score_rerank"), key).limit(m) if m else out


def model_rerank(hits: DataFrame, query: str, make_scorer: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], text: str = "text", m: int | None = 20, key: str = "doc_id", batch: int = 32, head: int = 512) -> DataFrame:
    """Adds score_rerank by a model of (query, text's head) pairs, made once a task, called on batches; the best m."""
    names = [c for c in hits.columns if c != "score_rerank"]
    schema = hits.select(*names).schema.add("score_rerank", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for b in batches:
            pairs = [(query, (t or "")[:head]) for t in b.column(text).to_pylist()]
            scores = [float(s) for k in range(0, len(pairs), batch) for s in scorer(pairs[k : k + batch])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score_rerank"])

    out = hits.select(*names).mapInArrow(run, schema).orderBy(F.desc("score_rerank"), key)
    return out.limit(m) if m else out


#: Models of this process, which serves one task after another.
_MODELS: dict[str, object] = {}


def once_a_worker(name: str, make: Callable[[], object]) -> Callable[[], object]:
    """Gives the model of a name, made when a worker first needs it and kept for its later tasks."""

    def get() -> object:
        from kelpie.operators import retrieval  # the module that lives on in the worker, not a copy of its names

        if name not in retrieval._MODELS:
            retrieval._MODELS[name] = make()
        return retrieval._MODELS[name]

    return get


def make_reranker(name: str | None, make_scorer: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]] | None = None, needs: Sequence[str] = ()) -> Callable[..., DataFrame]:
    """A reranker (hits, query, text, m, key): by a model, one in each worker, or by rules.

    Which one is settled when the plan is made: without a model, or where a module that it needs
    can't be found, rules rank, and a warning names the module.
    """
    lost = [m for m in needs if importlib.util.find_spec(m) is None]
    if lost:
        warnings.warn(f"reranking by rules, as {name} needs {', '.join(lost)}", stacklevel=2)
    if name is None or make_scorer is None or lost:
        return lambda hits, query, text="text", m=20, key="doc_id": simple_rerank(hits, query, text, m=m, key=key)
    return lambda hits, query, text="text", m=20, key="doc_id": model_rerank(hits, query, once_a_worker(name, make_scorer), text, m, key)


def category_counts(chunks: DataFrame, categories: Sequence[str], column: str = "category") -> DataFrame:
    """Rows by category, zero where there are none."""
    fixed = chunks.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    return F.broadcast(fixed).join(chunks.groupBy(column).agg(F.count("*").alias("n")), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
