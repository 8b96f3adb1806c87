import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kelpie.llm import ranked_search as r

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item, rank, doc, score) by scoring everything."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        rows = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                rows.append((-score, (i is not None, i or 0)))
        out += [(item, k + 1, key[1] if key[0] else None, -s) for k, (s, key) in enumerate(sorted(rows)[:k])]
    return out


def rows_of(df):
    return sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    common, rare = [f"w{k}" for k in range(12)], [f"Rare{k}é" for k in range(300)]
    return [(rng.randrange(10_000), rng.choice(["-", " ", ", "]).join(rng.choices(common, k=rng.randrange(30)) + rng.choices(rare, k=rng.randrange(4)))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [1, 3, 1024])
def test_equals_scoring_everything(spark, leaf):
    rows = corpus(1, 900)
    rows += [(None, None), (None, "w1 RARE5é"), (5, ""), (6, "!!!"), (7, "w3 rare7é")] + [(8, "w3 rare7é")] * 40 + [(9, "rare9é " * 400_000)]
    items = [(k, " ".join(random.Random(k).choices([f"w{j}" for j in range(12)] + [f"rare{j}é" for j in range(300)], k=14))) for k in range(25)]
    items += [(100, "rare7é w3"), (100, "rare7é w3"), (100, "rare9é"), (None, "w1"), (101, None), (102, "unknown")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS item_id").repartition(5)
    bench = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "2 AS doc_id")
    assert rows_of(r.search_documents(docs, bench, leaf=leaf)) == sorted(brute(rows, items), key=str)


def test_one_index_many_searches(spark):
    rows = corpus(2, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = r.build_index(docs)
    for items in ([(1, "w1 rare1é")], [(2, "rare2é w5 w6"), (3, "w7")]):
        bench = spark.createDataFrame(items, "item_id string, text string")
        (block,) = r.blocks_of(bench)
        assert rows_of(r.search(index, block, bench.schema["item_id"].dataType, 4)) == sorted(brute(rows, [(str(i), t) for i, t in items], 4), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert r.search_documents(docs.limit(0), items).count() == 0
    assert r.search_documents(docs, items.limit(0)).count() == 0
    assert rows_of(r.search_documents(docs, items)) == brute([(1, "a b")], [(1, "a")])


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(3)
    impacts = rng.integers(0, 9, 60).tolist()
    starts = [0, 1, 20, 60]
    left, right, roots = r.treaps_of(impacts, starts)

    def walk(k):
        return [] if k < 0 else [*walk(left[k]), k, *walk(right[k])]

    for root, (a, b) in zip(roots, itertools.pairwise(starts), strict=True):
        assert walk(root) == list(range(a, b))
    assert all(c < 0 or impacts[c] <= impacts[k] for k in range(60) for c in (left[k], right[k]))


def test_subtrees_are_left_out():
    shard = r.Filling()
    for i in range(4000):
        shard.add(i, 50, Counter({b"often": 1} | ({b"seldom": 3} if i in (17, 3100) else {})))
    row = shard.row()
    impacts = r.impacts_of(r.ints("<i4", row["tfs"][0].as_py()), np.full(4002, 50), 4000, 200_000)
    found = r.treaps_of(impacts.tolist(), [0, *itertools.accumulate(row["dfs"][0].as_py())])
    cols = {"terms": row["terms"], "dfs": row["dfs"], "doc_ids": row["doc_ids"], "docs": row["docs"]} | {n: [np.array(x, "<i4").tobytes()] for n, x in zip(("impacts", "lefts", "rights", "roots"), (impacts, *found), strict=True)}
    s = r.Shard(pa.RecordBatch.from_pydict(cols), leaf=16)
    best = r.Best(2)
    s.search(np.array([s.terms[b"often"], s.terms[b"seldom"]]), np.array([1, 6000]), best)
    assert [key[1] for _, key in best.rows] == [17, 3100]
    assert s.seen < 100  # of 4,002 postings


def test_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(map(tuple, c.sql(f"SELECT item_id, rank, doc_id, score FROM ({r.OP11_SQL})").fetchall()), key=str)
    assert want
    assert rows_of(r.op11_ranked_search(spark, sf)) == want
