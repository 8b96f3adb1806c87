import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.llm import near_duplicates as nd


def brute(rows, threshold=0.8):
    """Per row: class, copy and number of links, from all pairs of different texts."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    own = list(texts)
    sets = []
    for t in own:
        w = t.encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    root, links = list(range(len(own))), [0] * len(own)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for a, s in enumerate(sets):
        near = defaultdict(int)
        for g in s:
            for b in where[g]:
                near[b] += 1
            where[g].append(a)
        for b, n in near.items():
            if n / (len(s) + len(sets[b]) - n) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    members = defaultdict(list)
    for a, t in enumerate(own):
        members[find(a)] += texts[t]
    return sorted(((i, low(members[find(a)]), low(texts[t]), links[a]) for a, t in enumerate(own) for i in texts[t]), key=str)


def got(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    return sorted(map(tuple, nd.near_duplicates(df, **k).collect()), key=str)


def near_copies(n, seed, words=60, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own) + f" end{k}")
    return out


def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize(("cluster", "block", "broadcast"), [(4096, 512, 10**6), (4096, 7, 10**6), (6, 4, 0)])
def test_odd_rows_and_groups(spark, monkeypatch, cluster, block, broadcast):
    monkeypatch.setattr(nd, "CLUSTER", cluster)
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "BROADCAST_ROWS", broadcast)
    texts = near_copies(40, 1) + near_copies(9, 2) + near_copies(3, 3, 400) + ["same text of seven words is here"] * 5
    texts += [None, "", " \n", "one", "one", "two words", "five words are in here", "long " * 30_000 + "end", "long " * 30_000 + "fin"]
    rows = list(enumerate(texts)) + [(None, "null id"), (None, texts[0]), (3, "same id, other text"), (3, texts[3])]
    assert got(spark, rows) == brute(rows)


def test_what_moves_follows_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(nd, "CLUSTER", 20)
    monkeypatch.setattr(nd, "BLOCK", 16)
    moved, whole, store = {}, nd.whole_texts, nd.stored

    def counted(docs, rows):
        moved["texts"] = moved.get("texts", 0) + whole(docs, rows).count()
        return whole(docs, rows)

    def kept(df, what):
        out = store(df, what)
        moved["rows"] = moved.get("rows", 0) + out.count()
        return out

    monkeypatch.setattr(nd, "whole_texts", counted)
    monkeypatch.setattr(nd, "stored", kept)
    sizes = []
    for n in (80, 240):
        moved.clear()
        rows = list(enumerate(near_copies(n, 12)))
        assert got(spark, rows) == brute(rows)
        assert moved["texts"] == n
        sizes.append(moved["rows"])
    assert sizes[1] < 4 * sizes[0]


def test_a_crowd_without_ids(spark):
    texts = near_copies(30, 14) + ["alone in the crowd of rows without any id at all"] * 20 + near_copies(12, 15)
    rows = [(None, t) for t in texts] + [(7, texts[0]), (7, texts[31]), (7, "seven")]
    assert got(spark, rows) == brute(rows)


def test_unmet_recall_is_told():
    with pytest.warns(UserWarning, match="recall"):
        assert nd.depth_for(0.5, 0.9999) == nd.SHORTEST


def test_across_equals_similarities():
    sets = [nd.shingles(t) for t in near_copies(9, 3, 40)]
    whole = nd.similarities(sets)
    assert np.allclose(nd.across(sets[:4], sets[4:]), whole[:4, 4:])
    assert np.allclose(nd.across(sets[:2], [sets[0][:0], sets[5]], width=4)[:, 1], whole[:2, 5])


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 1, 1, 0)]


def test_signatures_estimate_similarity():
    a, b = near_copies(2, 5, 300, 30)
    s, t = nd.shingles(a), nd.shingles(b)
    j = nd.similarities([s, t])[0, 1]
    three = nd.similarities([s, t, s[:5]])
    assert three[0, 1] == j and abs(three[0, 2] - 5 / len(s)) < 1e-12
    est = np.mean([(nd.minima(x[i::1]) == nd.minima(y[i::1])).mean() for i, (x, y) in enumerate([(s, t)])])
    assert abs(est - j) < 0.15
    assert (nd.minima(s) == nd.minima(s, step=16)).all()
    assert (np.diff(nd.found_at(np.linspace(0, 1, 50), 4)) >= 0).all()


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_a_hot_group_sets_no_depth_for_others(spark):
    def pair(k):  # 40 of 50 shingles shared
        w = [f"p{k}x{j}" for j in range(49)]
        return [" ".join(w), " ".join(w[:-5] + [f"q{k}x{j}" for j in range(5)])]

    texts = near_copies(60, 4, 300)
    for k in (466, 1015, 1196, 1794):  # no whole label of six minima in common
        a, b = map(nd.shingles, pair(k))
        assert nd.similarities([a, b])[0, 1] == 0.8
        assert not (nd.minima(a) == nd.minima(b)).reshape(nd.TREES, nd.DEPTH).all(1).any()
        texts += pair(k)
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


def test_prefixes_are_shortened_where_clusters_grow(spark, monkeypatch):
    monkeypatch.setattr(nd, "CLUSTER", 30)
    monkeypatch.setattr(nd, "BLOCK", 16)

    def pair(k):  # 40 of 50 shingles shared, and no whole path in common
        w = [f"p{k}x{j}" for j in range(49)]
        return [" ".join(w), " ".join(w[:-5] + [f"q{k}x{j}" for j in range(5)])]

    close = near_copies(2, 21, 400)
    texts = [*close, *pair(466), *pair(1015), *near_copies(80, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = nd.stored(nd.signatures(docs).withColumnRenamed("doc_id", "copy_id").withColumn("node", F.col("copy_id")), "nodes")
    depth = {r["node"]: r["depth"] for r in nd.forest_links(docs, nodes, 0.8, 0.9999).filter("links > 0").collect()}
    assert {depth[k] for k in (0, 1)} == {nd.DEPTH} and {depth[k] for k in (2, 3, 4, 5)} == {5}
    assert len(depth) > 40 and {d for k, d in depth.items() if k >= 6} == {nd.SHORTEST}
    assert got(spark, list(enumerate(texts))) == brute(list(enumerate(texts)))


def test_blocks_are_bounded_in_shingles(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 2000)
    rows = list(enumerate(near_copies(30, 5, 300)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = nd.stored(nd.signatures(docs).withColumnRenamed("doc_id", "copy_id").withColumn("node", F.col("copy_id")), "nodes")
    assert nd.clusters(nodes, 5).first()["load"] > 5 * nd.BLOCK / 2
    assert got(spark, rows) == brute(rows)
