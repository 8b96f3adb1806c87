"""Learned sparse vectors: impact-quantised postings in blocks with upper bounds, and exact top-k that skips blocks.

An expander, which stands for a model, turns a text's tokens into weighted features; weights are
quantised to whole impacts of one byte. Documents are dealt into blocks of a bounded number by
their strongest term, so that a block's documents are alike, and a block's postings of a term are
one row with its largest impact. For a query the sum of its terms' largest impacts bounds every
score in a block. The blocks with the best bounds are scored first; the k-th best score there is
a threshold that any block whose bound is below it can't reach, so its postings are never opened.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.batches import pieces, tidy
from kelpie.functions.sparse import VOCABULARY, term_number_of, tokens, tokens_of
from kelpie.operators.retrieval import top_k

Expander = Callable[[Sequence[str]], Mapping[str, float]]
MODES = ("bm25", "learned", "disabled")
#: Impacts a unit of weight, and the largest; documents of a block; blocks of a query that are scored first.
SCALE, MOST, BLOCK_DOCS, SEEDS = 32, 255, 256, 4
HEAD = 4
#: Tokens that are Python's strings at a time in a task, but for a single text of more.
PIECE_TOKENS = 100_000


def by_heads(words: Sequence[str]) -> dict[str, float]:
    """The offline expander: each word, and at half the weight the first letters of longer words, so that inflections meet."""
    own = Counter(words)
    heads = Counter(f"~{w[:HEAD]}" for w in words if len(w) > HEAD)
    return {w: math.log1p(n) for w, n in own.items()} | {h: 0.5 * math.log1p(n) for h, n in heads.items()}


def quantised(features: Mapping[str, float]) -> dict[int, int]:
    """Impacts by term number; features of one number add up. Weights of 0 and less say nothing."""
    out: Counter = Counter()
    for f, w in features.items():
        if w > 0:
            out[term_number_of(f)] += min(MOST, max(1, round(SCALE * w)))
    return {t: min(MOST, n) for t, n in out.items()}


def impact_postings(df: DataFrame, key: str, text: str, expander: Expander = by_heads) -> DataFrame:
    """(key, term, impact) of texts whose keys are unique; a model is called in the tasks, a text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, pc.list_value_length(whole.column(1)), PIECE_TOKENS)):
            row, term, impact = [], [], []
            for k, words in enumerate(b.column(1).to_pylist()):
                own = quantised(expander(words or []))
                row += [k] * len(own)
                term += own.keys()
                impact += own.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(term, pa.int32()), pa.array(impact, pa.int32())], [key, "term", "impact"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tokens(text).alias("tokens")).mapInArrow(tidy(run), f"{key} {kind}, term int, impact int")


def query_impacts(spark: SparkSession, queries: Sequence[tuple[int, str]], expander: Expander = by_heads) -> DataFrame:
    """(query_ord, term, weight) of the queries; a query without words has no row."""
    rows = [(i, t, n) for i, q in queries for t, n in quantised(expander(tokens_of(q))).items()]
    return spark.createDataFrame(rows, "query_ord int, term int, weight int")


@dataclass
class BlockIndex:
    """Rows of (block, term, most, keys, impacts), and the name of the keys."""

    blocks: DataFrame
    key: str


def build(postings: DataFrame, key: str, block_docs: int = BLOCK_DOCS) -> BlockIndex:
    """The postings (key, term, impact) in blocks, stored in the shared folder.

    Strongest terms are counted first: their number is bounded by the vocabulary, and a term that
    many documents have as their strongest gets as many blocks as it needs.
    """
    from kelpie.sources.store import stored

    postings = stored(postings.select(key, "term", "impact"), "postings")
    heads = stored(postings.groupBy(key).agg(F.max_by("term", F.struct("impact", "term")).alias("head")), "heads")
    counts = heads.groupBy("head").agg(F.ceil(F.count("*") / block_docs).cast("long").alias("parts"))
    placed = heads.join(F.broadcast(counts), "head")  # a row a term of the vocabulary
    placed = placed.select(key, (F.col("head") + VOCABULARY * F.pmod(F.xxhash64(key), "parts")).alias("block"))
    own = postings.join(placed, key)
    rows = own.groupBy("block", "term").agg(F.max("impact").alias("most"), F.collect_list(F.struct(F.col(key).alias("key"), "impact")).alias("entries"))
    return BlockIndex(stored(rows.repartitionByRange("block").sortWithinPartitions("block", "term"), "blocks"), key)


def scores(index: BlockIndex, terms: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """(query_ord, key, score) over all blocks, or those (query_ord, block) that are named."""
    met = index.blocks.join(F.broadcast(terms), "term")
    if some is not None:
        met = met.join(some.select("query_ord", "block"), ["query_ord", "block"], "left_semi")
    each = met.select("query_ord", "weight", F.explode("entries").alias("e"))
    return each.groupBy("query_ord", F.col("e.key").alias(index.key)).agg(F.sum(F.col("weight") * F.col("e.impact")).cast("long").alias("score"))


def bounds(index: BlockIndex, terms: DataFrame) -> DataFrame:
    """(query_ord, block, bound): what no document of a block can exceed; entries aren't read for it."""
    return index.blocks.select("block", "term", "most").join(F.broadcast(terms), "term").groupBy("query_ord", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))


def reachable_blocks(index: BlockIndex, terms: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
    """(query_ord, block) of blocks that can hold one of the best k: all whose bound reaches the threshold of the first ones."""
    from kelpie.sources.store import stored

    own = stored(bounds(index, terms), "bounds")
    first = own.withColumn("n", F.row_number().over(W.partitionBy("query_ord").orderBy(F.desc("bound"), "block"))).filter(F.col("n") <= seeds)
    best = top_k(scores(index, terms, first), k, index.key)
    least = best.groupBy("query_ord").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
    reach = own.join(F.broadcast(least.select("query_ord", "least")), "query_ord", "left")  # a row a query
    return stored(reach.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_ord", "block"), "reachable")


def impact_top_k(index: BlockIndex, terms: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
    """(query_ord, key, score, rank): each query's best k, as scoring everything gives them."""
    return top_k(scores(index, terms, reachable_blocks(index, terms, k, seeds)), k, index.key)
