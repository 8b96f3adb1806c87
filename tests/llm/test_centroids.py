import hashlib

import duckdb
import numpy as np
import pytest

from kelpie.llm import centroids as c


def brute(rows, dim, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(v))) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) and abs(v) < 1 << 17 for v in x)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [x for _, x in hashed[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(centers))

    for _ in range(rounds):
        to = [near(x)[1] for _, x in kept]
        groups = [[x for (_, x), t in zip(kept, to, strict=True) if t == j] for j in range(len(centers))]
        centers = [[sum(v) // len(g) for v in zip(*g, strict=True)] if g else m for g, m in zip(groups, centers, strict=True)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = sum(d for *_, d in found)
    by = {j: sum(d for _, t, d in found if t == j) for j in range(len(centers))}
    return sorted(((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2L AS distance")


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_equals_comparing_everything(spark, spread, monkeypatch):
    monkeypatch.setattr(c, "TREE", 100)
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(9, 6))
    rows = [(k, (heads[k % 9] + spread * rng.normal(size=6)).tolist()) for k in range(700)]
    rows += [(1000 + k, [0.25] * 6) for k in range(300)] + [(5000, [-0.125] * 6)] * 20 + [(None, [0.5] * 6), (None, [0.5] * 6)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 7), (2004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2005, [float("nan")] * 6), (2006, [float("inf")] + [0.0] * 5), (2007, [-1e30] + [0.0] * 5), (2008, [100_000.5] * 6)]
    assert rows_of(c.cluster(table(spark, rows).repartition(3), dim=6)) == brute(rows, 6)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [1.0, -1.0])]
    assert rows_of(c.cluster(table(spark, rows), dim=2)) == brute(rows, 2)
    assert c.cluster(table(spark, [(1, None)]), dim=2).count() == 0
    assert c.cluster(table(spark, rows).limit(0), dim=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_balls_are_assigned_whole():
    rng = np.random.default_rng(6)
    heads = rng.integers(-20_000, 20_000, (8, 16))
    points = (heads[rng.integers(0, 8, 5000)] + rng.integers(-90, 90, (5000, 16))).astype(np.int32)
    tree, order = c.BallTree.of(points)
    whole, rest = tree.filtered(heads)
    assert sorted(order.tolist()) == list(range(5000))
    assert sum(tree.bounds[n, 1] - tree.bounds[n, 0] for n, _ in whole) + len(rest) == 5000
    assert len(rest) < 500 and len(whole) < 200
    for (a, b), sums, (*mean, radius) in zip(tree.bounds, tree.sums, tree.balls, strict=True):
        assert (tree.points[a:b].sum(0) == sums).all()
        assert np.sqrt(((tree.points[a:b] - np.array(mean)) ** 2).sum(1)).max() <= radius + 1e-6
    to, far = tree.assigned(heads)
    all_far = ((tree.points[:, None].astype(np.int64) - heads[None]) ** 2).sum(2)
    assert (to == all_far.argmin(1)).all() and (far == all_far.min(1)).all()


def test_ties_and_large_numbers():
    points = np.array([[0, 0], [2, 0], [1 << 27, -(1 << 27)]], np.int32)
    middle = np.array([[1, 0], [-1, 0], [1, 0]], np.int64)
    assert c.nearest(points[:2], middle).tolist() == [0, 0]
    tree, _ = c.BallTree.of(points)
    to, far = tree.assigned(np.array([[-(1 << 27), 1 << 27], [1, 0]], np.int64))
    assert sorted(zip(to.tolist(), far.tolist(), strict=True)) == [(1, 1), (1, 1), (1, ((1 << 27) - 1) ** 2 + (1 << 54))]


def test_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(map(tuple, duck.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({c.OP12_SQL})").fetchall()), key=str)
    assert want
    assert rows_of(c.op12_centroids(spark, sf)) == want
