"""Centroid clustering over vectors of whole numbers, filtered through ball trees.

Each task builds metric trees over the vectors of its partition, a bounded number a tree, once; a
node stores its vectors' number, their sum in whole numbers, and the radius around their mean. In
a round each tree is walked from its root with all centroids: those that the triangle inequality
shows to be farther than another from every vector of a ball are dropped, and a ball with one
centroid left is assigned whole, by its stored sum. Otherwise its children follow, and at the
leaves vectors are compared one by one in exact arithmetic. Only a row for each task and centroid
moves in a round; centroids are k short rows on the driver.

Defined results: vectors that are null, of another length, or with a component that is null or not
finite are left out, as are those with a component of 2**17 or more, as distances between such
vectors fit no long; repeated rows count once each; of equal distances the smaller number wins;
first centroids of equal hash go by components, those without an id last; with fewer kept vectors
than k there are as many centroids as vectors; an inertia beyond a long is null; further columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import stored, table, tidy

#: Vectors of a tree and of a leaf; rows compared at once.
TREE, LEAF, STEP = 8192, 32, 16_384
SCALE, BOUND = 1024, 1 << 27
PARTS = {"ids": pa.list_(pa.int64()), "points": pa.binary(), "bounds": pa.binary(), "links": pa.binary(), "balls": pa.binary(), "sums": pa.binary()}


@dataclass
class BallTree:
    """Nodes over consecutive points: each one's range, children (-1: none), mean and radius, and sum."""

    points: np.ndarray
    bounds: np.ndarray
    links: np.ndarray
    balls: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
        """A tree, and the order that it puts the points in."""
        order, bounds, links, balls, sums = np.arange(len(points)), [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, above, side = todo.pop()
            own = points[order[a:b]].astype(np.float64)
            total = points[order[a:b]].sum(0, dtype=np.int64)
            away = np.sqrt(((own - total / (b - a)) ** 2).sum(1))
            if above >= 0:
                links[above][side] = len(bounds)
            if b - a > leaf and (own != own[0]).any():
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(1).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (other - one), half)]
                todo += [(a, a + half, len(bounds), 0), (a + half, b, len(bounds), 1)]
            bounds.append((a, b))
            links.append([-1, -1])
            balls.append(np.append(total / (b - a), away.max()))
            sums.append(total)
        return cls(points[order], np.array(bounds, np.int64), np.array(links, np.int64), np.array(balls), np.array(sums)), order

    def filtered(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(node, centroid) of balls that have one centroid, and the places of points left to compare."""
        near = centroids.astype(np.float64)
        nodes, maybe = np.zeros(1, np.int64), np.ones((1, len(near)), bool)
        whole, rest = [], []
        while len(nodes):
            mean, radius = self.balls[nodes, :-1], self.balls[nodes, -1:]
            far = np.stack([np.sqrt(((mean - c) ** 2).sum(1)) for c in near], 1)
            far[~maybe] = np.inf
            least = far.min(1, keepdims=True)
            maybe &= far - radius <= (least + radius) * (1 + 1e-9) + 1e-6  # what rounding can hide
            one = maybe.sum(1) == 1
            whole += zip(nodes[one].tolist(), maybe[one].argmax(1).tolist(), strict=True)
            ends = ~one & (self.links[nodes, 0] < 0)
            rest += [np.arange(*self.bounds[k]) for k in nodes[ends]]
            more = ~one & ~ends
            nodes, maybe = self.links[nodes[more]].ravel(), np.repeat(maybe[more], 2, 0)
        return whole, np.concatenate(rest) if rest else np.zeros(0, np.int64)

    def summed(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many points each centroid has, and their sum."""
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, rest = self.filtered(centroids)
        for node, k in whole:
            n[k] += self.bounds[node, 1] - self.bounds[node, 0]
            sums[k] += self.sums[node]
        for lo in range(0, len(rest), STEP):
            own = self.points[rest[lo : lo + STEP]]
            to = nearest(own, centroids)
            n += np.bincount(to, minlength=len(n))
            for k in np.unique(to):
                sums[k] += own[to == k].sum(0, dtype=np.int64)
        return n, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's centroid and squared distance."""
        to = np.zeros(len(self.points), np.int64)
        whole, rest = self.filtered(centroids)
        for node, k in whole:
            to[slice(*self.bounds[node])] = k
        for lo in range(0, len(rest), STEP):
            to[rest[lo : lo + STEP]] = nearest(self.points[rest[lo : lo + STEP]], centroids)
        return to, ((self.points.astype(np.int64) - centroids[to]) ** 2).sum(1)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The first of the nearest centroids, in whole numbers."""
    largest = max(np.abs(points).max(), np.abs(centroids).max(), 1)
    if points.shape[1] * int(largest) ** 2 < 1 << 50:  # then doubles hold every sum exactly
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((c * c).sum(1) - 2 * (p @ c.T)).argmin(1)
    p = points.astype(np.int64)
    return np.stack([((p - c) ** 2).sum(1) for c in centroids], 1).argmin(1)


def whole_numbers(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and x, the kept vectors' components as whole numbers."""
    scaled = F.transform("embedding", lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < BOUND / SCALE))
    kept = vectors.select(F.col("vec_id").cast("long"), "embedding").filter((F.size("embedding") == dim) & F.coalesce(good, F.lit(False)))
    return kept.select("vec_id", scaled.cast("array<int>").alias("x"))


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    hashed = points.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["x"] for r in hashed.orderBy(F.asc_nulls_last("hash"), "x").limit(k).collect()], np.int64)


def trees_of(points: DataFrame, dim: int) -> DataFrame:
    """The partitions' trees, a row each."""

    def row(ids: list, points: np.ndarray) -> pa.RecordBatch:
        tree, order = BallTree.of(points)
        parts = [pa.array([[ids[k] for k in order]], PARTS["ids"])]
        parts += [pa.array([x.tobytes()], pa.binary()) for x in (tree.points.astype("<i4"), tree.bounds, tree.links, tree.balls, tree.sums)]
        return pa.RecordBatch.from_arrays(parts, list(PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, TREE):
                part = b.slice(lo, TREE)
                ids += part["vec_id"].to_pylist()
                rows.append(part["x"].flatten().to_numpy().reshape(-1, dim))
                n += len(rows[-1])
                if n >= TREE:
                    yield row(ids, np.concatenate(rows))
                    ids, rows, n = [], [], 0
        if n:
            yield row(ids, np.concatenate(rows))

    return points.mapInArrow(tidy(run), "ids array<long>, points binary, bounds binary, links binary, balls binary, sums binary")


def read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, BallTree]]:
    for b in batches:
        for k in range(b.num_rows):
            raw = {c: b[c][k].as_py() for c in PARTS if c != "ids"}
            arrays = [np.frombuffer(raw[c], t).reshape(-1, n) for c, t, n in (("points", "<i4", dim), ("bounds", "<i8", 2), ("links", "<i8", 2), ("balls", "<f8", dim + 1), ("sums", "<i8", dim))]
            yield b["ids"].slice(k, 1).flatten(), BallTree(*arrays)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, tree in read(batches, dim):
            more, further = tree.summed(centroids)
            n, sums = n + more, sums + further
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.mapInArrow(tidy(run), "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums")).collect()  # k at most
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(vectors: DataFrame, dim: int = 64, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    spark, schema = vectors.sparkSession, "vec_id long, cluster int, distance long"
    points = whole_numbers(vectors, dim)
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = stored(trees_of(points, dim), "trees")
    for _ in range(rounds):
        before, centroids = centroids, moved(trees, centroids)
        if (before == centroids).all():
            break  # further rounds would change nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in read(batches, dim):
            to, far = tree.assigned(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    out = stored(trees.mapInArrow(tidy(run), schema), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k at most
    fit = lambda x: x if x < 1 << 63 else None
    rows = [(c, fit(s), fit(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 10) -> str:
    nearest = """SELECT vec_id, any_value(x) AS x, arg_min(cluster, d * 8 + cluster)::INTEGER AS cluster, min(d)::BIGINT AS distance
    FROM (SELECT vec_id, x, cluster, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM kept, c{r})
    GROUP BY vec_id"""
    move = """SELECT cluster, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
        SELECT cluster, list(v ORDER BY i) AS c FROM (
            SELECT cluster, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
            FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i)
        GROUP BY cluster) n USING (cluster)"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED ({move.format(r=r)})")
    return (
        """WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, x AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),
"""
        + ",\n".join(steps)
        + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
    )


OP12_SQL = _sql()
