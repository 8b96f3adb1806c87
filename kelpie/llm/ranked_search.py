"""Ranked lexical search over inverted treaps.

Documents are dealt into shards of a bounded number of postings. In a shard each term has a treap:
its postings are a search tree by document and a heap by impact, so that the root of any range of
documents is that range's largest impact. A search descends the treaps of all its terms together,
from the range of documents whose maxima have the largest sum; a range whose sum can't enter the
best k is left out with all below it, and short ranges are scored exactly. Shards are searched
where they lie; only their best k of each item move.

Impacts need the number and mean length of all documents, so an index is made in two passes: one
reads the texts and writes postings, the next, over the postings alone, adds impacts and treaps.
A term's weight depends on its document frequency alone and is applied to whole treaps when they
are searched.

Defined results: null texts and texts without a term aren't counted and never found; a very long
text is one document, read in pieces; items without a known term find nothing; items of one id
and equal text are one item, others of one id are ranked each for itself; repeated rows are
documents of their own; equal scores go by ascending doc_id, null first, and rows that are still
equal are alike; further columns are left out; an empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kelpie.llm.common import stored, table, tidy

#: Postings and documents of a shard at most, but for its last document's; documents of a range that is scored at once.
SHARD_POSTINGS, SHARD_DOCS, LEAF = 1 << 20, 1 << 17, 1024
#: Distinct terms of a block of items, which go to every task.
BLOCK_TERMS = 200_000
#: Groups that an item's candidates are first reduced in.
GROUPS = 64
#: Every other byte of UTF-8 is part of a term.
APART = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SPELL = bytes(32 if b in APART and not 0x41 <= b <= 0x5A else b | 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SHARD = "n_docs long, n_terms long, terms array<binary>, dfs array<long>, doc_ids array<long>, lens binary, docs binary, tfs binary"
TREAPS = "terms array<binary>, dfs array<long>, doc_ids array<long>, docs binary, impacts binary, lefts binary, rights binary, roots binary"


def pieces_of(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A long text in turn, cut where no term is."""
    at = 0
    while len(data) - at > size:
        end = data.find(b" ", at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    for piece in pieces_of(text.translate(SPELL)):
        yield piece.split()


def ints(kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind)


class Filling:
    """A shard while documents come in."""

    def __init__(self):
        self.local: dict[bytes, int] = {}
        self.terms, self.tfs, self.sizes, self.lens, self.ids = array("i"), array("i"), array("q"), array("q"), []

    def add(self, doc_id: int | None, n: int, counts: Counter) -> None:
        local = self.local
        self.terms.extend([local.setdefault(t, len(local)) for t in counts])
        self.tfs.extend(counts.values())
        self.sizes.append(len(counts))
        self.lens.append(n)
        self.ids.append(doc_id)

    def full(self) -> bool:
        return len(self.terms) >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        names = sorted(self.local)
        place = np.empty(len(names), np.int32)
        place[[self.local[t] for t in names]] = np.arange(len(names))
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        term, doc = place[np.array(self.terms, np.int32)] if names else np.zeros(0, np.int32), np.repeat(rank, np.array(self.sizes))
        by = np.lexsort((doc, term))
        dfs, lens = np.bincount(term, minlength=len(names)), np.array(self.lens)[order]
        cols = [
            pa.array([len(order)], pa.int64()), pa.array([int(lens.sum())], pa.int64()), pa.array([names], pa.list_(pa.binary())), pa.array([dfs.tolist()], pa.list_(pa.int64())),
            pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (lens, doc[by].astype("<i4"), np.array(self.tfs, "<i4")[by])),
        ]
        return pa.RecordBatch.from_arrays(cols, ["n_docs", "n_terms", "terms", "dfs", "doc_ids", "lens", "docs", "tfs"])


def postings(docs: DataFrame, asked: frozenset[bytes] | None = None) -> DataFrame:
    """A row for each shard: all documents' ids and lengths, and the postings of the asked terms (None: of all)."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        shard = Filling()
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                n, counts = 0, Counter()
                for terms in terms_of(text.as_py() or b""):
                    n += len(terms)
                    counts.update(terms if wanted is None else filter(wanted.__contains__, terms))
                if n:
                    shard.add(i, n, counts)
                    if shard.full():
                        yield shard.row()
                        shard = Filling()
        if shard.ids:
            yield shard.row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), SHARD)


def treaps_of(impacts: list[int], starts: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Left and right children of each posting, -1 for none, and each term's root: of equal impacts the first is above."""
    lefts, rights, roots = [-1] * len(impacts), [-1] * len(impacts), []
    for a, b in itertools.pairwise(starts):
        path: list[int] = []  # from the root along right children
        for i in range(a, b):
            below, v = -1, impacts[i]
            while path and impacts[path[-1]] < v:
                below = path.pop()
            lefts[i] = below
            if path:
                rights[path[-1]] = i
            path.append(i)
        roots.append(path[0])
    return lefts, rights, roots


def impacts_of(tfs: np.ndarray, lens: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's share of the score at weight 1, from tf and its document's length."""
    m = np.array([100 - 90 + 90 * n * n_docs // n_terms for n in lens.tolist()], np.int64)
    tf = tfs.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class TreapIndex:
    """Shards with treaps, document frequencies, and the numbers that weights and impacts need."""

    shards: DataFrame
    dfs: DataFrame
    n_docs: int
    n_terms: int

    def weights(self, terms: list[bytes]) -> dict[bytes, int]:
        """Weights of those terms that the index holds; a block's terms are few enough for a broadcast."""
        spark = self.dfs.sparkSession
        rows = self.dfs.join(F.broadcast(spark.createDataFrame([(t,) for t in terms], "term binary")), "term", "left_semi")
        return {bytes(r["term"]): math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * r["df"] + 1))) for r in rows.collect()}


def build_index(docs: DataFrame, asked: frozenset[bytes] | None = None) -> TreapIndex:
    """An index in the shared folder, over all terms or those that are asked for."""
    first = stored(postings(docs, asked), "postings")
    total = first.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                lens, docs_, tfs, dfs = ints("<i8", row["lens"][0].as_py()), ints("<i4", row["docs"][0].as_py()), ints("<i4", row["tfs"][0].as_py()), row["dfs"][0].as_py()
                impacts = impacts_of(tfs, lens[docs_], n_docs, n_terms)
                found = treaps_of(impacts.tolist(), [0, *itertools.accumulate(dfs)])
                new = [pa.array([np.array(x, "<i4").tobytes()], pa.binary()) for x in (impacts, *found)]
                yield pa.RecordBatch.from_arrays([*(row[c] for c in ("terms", "dfs", "doc_ids", "docs")), *new], ["terms", "dfs", "doc_ids", "docs", "impacts", "lefts", "rights", "roots"])

    dfs = first.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    return TreapIndex(stored(first.mapInArrow(tidy(run), TREAPS), "treaps"), stored(dfs, "dfs"), n_docs, n_terms)


class Best:
    """The best k of an item so far; of equal scores the smaller id is better, null first."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> tuple[int, tuple]:
        """What a document must reach: at least this score, and at this score an id before that one."""
        if len(self.rows) < self.k:
            return 1, (2, 0)
        score, key = self.rows[-1]
        return -score, key

    def add(self, found: list[tuple[int, tuple]]) -> None:
        self.rows = heapq.nsmallest(self.k, self.rows + [(-score, key) for score, key in found])


class Shard:
    """A shard's treaps as arrays; documents are numbers in order of their ids."""

    def __init__(self, row: pa.RecordBatch, leaf: int = LEAF):
        self.terms = {t: k for k, t in enumerate(row["terms"][0].as_py())}
        self.ids = row["doc_ids"][0].as_py()
        self.docs, self.impacts, self.lefts, self.rights, self.roots = (ints("<i4", row[c][0].as_py()) for c in ("docs", "impacts", "lefts", "rights", "roots"))
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) * len(self.ids), row["dfs"][0].as_py()) + self.docs
        self.leaf, self.seen = leaf, 0

    def key(self, doc: int) -> tuple:
        i = self.ids[doc]
        return (i is not None, i or 0)

    def split(self, terms: np.ndarray, nodes: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
        """The roots of the postings before a document, and from it on; -1 for none."""
        at = np.searchsorted(self.keys, terms * len(self.ids) + doc)
        a, b = nodes.copy(), nodes.copy()
        while (late := a >= at).any():
            a[late] = self.lefts[a[late]]
        while (early := (b < at) & (b >= 0)).any():
            b[early] = self.rights[b[early]]
        return a, b

    def scores(self, terms: np.ndarray, weights: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Every document's score in a range."""
        a, b = (np.searchsorted(self.keys, terms * len(self.ids) + x) for x in (lo, hi))
        size = b - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out = np.zeros(hi - lo, np.int64)
        np.add.at(out, self.docs[at] - lo, np.repeat(weights, size) * self.impacts[at])
        self.seen += len(at)
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Take this shard's documents into an item's best ones."""
        nodes = self.roots[terms]
        todo = [(-int((weights * self.impacts[nodes]).sum()), 0, len(self.ids), terms, weights, nodes)]
        while todo:
            bound, lo, hi, terms, weights, nodes = heapq.heappop(todo)
            least, key = best.least()
            if -bound < least:
                break  # so are all the others
            if -bound == least and self.key(lo) >= key:
                continue
            if hi - lo <= self.leaf:
                found = self.scores(terms, weights, lo, hi)
                best.add([(int(found[d]), self.key(lo + d)) for d in np.flatnonzero(found >= least).tolist()])
                continue
            quarter = (hi - lo) // 4
            strongest = int(self.docs[nodes[np.argmax(weights * self.impacts[nodes])]])
            cut = min(max(strongest, lo + quarter), hi - quarter)
            for part, a, b in zip(self.split(terms, nodes, cut), (lo, cut), (cut, hi), strict=True):
                own = part >= 0
                if own.any():
                    t, w, n = terms[own], weights[own], part[own]
                    heapq.heappush(todo, (-int((w * self.impacts[n]).sum()), a, b, t, w, n))


@dataclass
class Block:
    """Some items: their ids, and the distinct terms of each."""

    ids: list
    terms: list[list[bytes]]

    def asked(self) -> frozenset[bytes]:
        return frozenset().union(*self.terms)


def blocks_of(items: DataFrame) -> Iterator[Block]:
    """Items block by block; a block's rows, of bounded terms together, come to the driver one at a time."""
    block, size = Block([], []), 0
    for r in items.select("item_id", "text").distinct().toLocalIterator():
        terms = {t for some in terms_of((r["text"] or "").encode("utf-8", "surrogatepass")) for t in some}
        block.ids.append(r["item_id"])
        block.terms.append(sorted(terms))
        size += len(terms)
        if size >= BLOCK_TERMS:
            yield block
            block, size = Block([], []), 0
    if block.ids:
        yield block


def search(index: TreapIndex, block: Block, item_type, k: int = 10, leaf: int = LEAF) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best k documents of score above 0."""
    spark = index.shards.sparkSession
    weights = index.weights(sorted(block.asked()))
    known = [[(t, weights[t]) for t in terms if weights.get(t, 0) > 0] for terms in block.terms]
    shared = spark.sparkContext.broadcast((block.ids, known))
    arrow = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = shared.value
        best = [Best(k) for _ in ids]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1), leaf)
                for own, terms in zip(best, known, strict=True):
                    here = [(shard.terms[t], w) for t, w in terms if t in shard.terms]
                    if here:
                        t, w = np.array(here, np.int64).T
                        shard.search(t, w, own)
        rows = [(n, i, key[1] if key[0] else None, -score) for n, (i, own) in enumerate(zip(ids, best, strict=True)) for score, key in own.rows]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), arrow, pa.int64(), pa.int64()), strict=True)], ["item", "item_id", "doc_id", "score"])

    found = index.shards.mapInArrow(tidy(run), f"item long, item_id {item_type.simpleString()}, doc_id long, score long").withColumn("group", F.spark_partition_id() % GROUPS)
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    few = found.withColumn("rank", F.row_number().over(W.partitionBy("item", "group").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10, leaf: int = LEAF) -> DataFrame:
    """Each item's best k documents. For each block of items the documents are read once, for its terms alone."""
    out, kind = None, items.schema["item_id"].dataType
    for block in blocks_of(items):
        found = search(build_index(docs, block.asked()), block, kind, k, leaf)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
lens AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lens),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term), total),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lens USING (doc_id), total
    GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
