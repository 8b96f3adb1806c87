"""Jaccard self-join on word shingles through a MinHash LSH forest.

Equal texts are one node. A node's signature is ``TREES`` labels of ``DEPTH`` minima, each label
a path in its tree; nodes that share a prefix of a path meet in that trie node. A link of
similarity s is found at depth d with probability 1 - (1 - s^d)^TREES.

Matching begins with whole paths and shortens the prefix step by step, until a link right at the
threshold has the target recall, so that every link has it, whatever others the table holds.
Nodes that meet form candidate clusters. A cluster of bounded size is verified whole, in pairs of
blocks; one that a shorter prefix leaves as it is keeps what was verified, and only those that
grow are verified again. In a larger cluster (very many near copies of one text, or chance
chains) only pairs that share a trie node are compared, so there the prefix is shortened further,
to ``SHORTEST``: each text goes once to a block of its largest trie node, which keeps the shingle
sets in a file, and blocks that share trie nodes are compared as references to their files. Blocks
are bounded in texts and in shingles. Links are counted where they are verified and are never
written out as pairs; only links between blocks' components are, for the connected classes. Exact
similarities come from whole shingle sets.

Defined results: words are runs of characters other than ASCII white space; a text of one to
four words is one shingle; texts without words link to nothing, but equal ones are copies (null
counts as empty); very long texts count by all their shingles; a similarity right at the threshold
is a link; a class is a connected component of links and copies, named by its smallest doc_id
(nulls last); repeated and null ids are judged by their texts; further columns of the documents
are not read; an empty table gives no rows. Where even the shortest prefix misses the recall, a
warning says so.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import shared_dir, stored, texts_of, tidy
from kelpie.operators.joins import skew_join

TREES, DEPTH, SHORTEST, WORDS = 24, 6, 4, 5
#: Members of clusters that are verified whole, in pairs of blocks of so many; a bound for the rows a join may broadcast (about 100 bytes each).
CLUSTER, BLOCK, BROADCAST_ROWS = 4096, 512, 300_000
#: Shingles of a block, about (a longer text is a block's by itself); rows of one text in one task.
BLOCK_SHINGLES, HOT_TEXTS = 4_000_000, 1_000_000
_RANDOM = np.random.default_rng(11)
TIMES = _RANDOM.integers(1, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RANDOM.integers(1, 1 << 63, TREES * DEPTH, np.uint64)


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word n-grams, sorted."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(own: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The signature of a shingle set: for each function the smallest value's upper half."""
    out = np.full(len(TIMES), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(own), step):
        part = own[lo : lo + step]
        for f in range(0, len(TIMES), 8):  # a few functions at a time stay in the cache
            out[f : f + 8] = np.minimum(out[f : f + 8], (part[None, :] * TIMES[f : f + 8, None] + PLUS[f : f + 8, None]).min(1))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and a 64-bit digest, by which texts are found again whatever their ids."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, copy (128 bits of the text), digest, signature (null without words), width (shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies, rows, widths = [], [], []
            for t in texts_of(b):
                copies.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
                own = shingles(t)
                rows.append(minima(own) if len(own) else None)
                widths.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(copies, pa.binary()), b.column("digest"), pa.array(rows, pa.list_(pa.int32())), pa.array(widths, pa.int64())], ["doc_id", "copy", "digest", "signature", "width"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_digest(docs).mapInArrow(tidy(run), f"doc_id {kind}, copy binary, digest long, signature array<int>, width long")


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of all pairs of some sets, as a matrix."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        both[1] = both[1, ::-1]
    else:
        values, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = n > 1  # a shingle of one set alone meets nothing
        column = np.cumsum(shared) - 1
        who = np.repeat(np.arange(len(sets)), size)
        keep = shared[back]
        who, col = who[keep], column[back[keep]]
        both = np.zeros((len(sets), len(sets)))
        width = 1 << 14
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        for lo in range(0, int(shared.sum()), width):
            a, z = np.searchsorted(col, [lo, lo + width])
            m = np.zeros((len(sets), min(width, int(shared.sum()) - lo)), np.float32)
            m[who[a:z], col[a:z] - lo] = 1
            both += m @ m.T
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def found_at(s: np.ndarray, depth: int) -> np.ndarray:
    return 1 - (1 - np.minimum(s, 1) ** depth) ** TREES


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its connected component, for edges (a, b) of numbers.

    Each round every vertex takes its smallest neighbour, then that one's own choice; edges are
    renamed to the choices and loops and repetitions go, so that they shrink round by round. The
    choices of all rounds are then followed one after another. All rounds are written to the
    shared folder.
    """
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    edges, rounds = stored(pair(edges), "edges"), []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        choice = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"), "choice")
        far = choice.select(F.col("node").alias("to"), F.col("to").alias("root"))
        rounds.append(stored(choice.join(far, "to").select("node", "root"), "choice"))
        name = lambda c, own=rounds[-1]: own.select(F.col("node").alias(c), F.col("root").alias(f"{c}2"))
        edges = stored(pair(edges.join(name("a"), "a").join(name("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds.pop()
    while rounds:  # what an earlier round chose may have moved on
        later = out.select(F.col("node").alias("root"), F.col("root").alias("far"))
        out = rounds.pop().join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    return stored(out, "roots")


def depth_for(threshold: float, recall: float) -> int:
    """The longest prefix at which each link has the recall, or, with a warning, the shortest one that there is."""
    for d in range(DEPTH, SHORTEST - 1, -1):
        if found_at(np.array(threshold), d) >= recall:
            return d
    warnings.warn(f"links of similarity {threshold} are found with a recall of {float(found_at(np.array(threshold), SHORTEST)):.4f}, not {recall}", stacklevel=2)
    return SHORTEST


def meeting(nodes: DataFrame, depth: int) -> DataFrame:
    """node, width, tree and its prefix's key: the rows that share the prefix with another node.

    How many nodes share a prefix is counted before it shuffles; where the shared ones are few
    enough, they go to the nodes, otherwise nodes' rows shuffle to them.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.slice("signature", t * DEPTH + 1, depth)).alias("key")))
    rows = nodes.filter("signature IS NOT NULL").select("node", "width", F.explode(keys).alias("x")).select("node", "width", "x.*")
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared")
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    return stored(rows.join(shared, "key"), "met")


def load_of(rows: Column) -> Column:
    """How many texts a group counts for when it is cut into blocks: as many as it has, or more where they are long."""
    return F.greatest(rows, F.ceil(F.sum("width") * (BLOCK / BLOCK_SHINGLES)))


def genuine(text: str, copy: bytes) -> bool:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")) == copy


def smallest_reachable(link: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric matrix of links the smallest row in its component."""
    root = np.arange(len(link))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(link)).min(1, initial=len(link)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(threshold: float):
    """Kernel over rows ordered by group: node, copy, text, group, side (a block pair's half, or 0)."""

    def judged(rows: list[dict]) -> Iterator[tuple[int, int, int]]:
        rows = list({(r["node"], r["side"]): r for r in rows if genuine(r["text"], r["copy"])}.values())
        if len(rows) < 2:
            return
        link = similarities([shingles(r["text"]) for r in rows]) >= threshold - 1e-12
        np.fill_diagonal(link, False)
        if rows[0]["group"]["i"] != rows[0]["group"]["j"]:  # of two different blocks only what lies across
            side = np.array([r["side"] for r in rows])
            link &= side[:, None] != side[None, :]
        root = smallest_reachable(link)
        node = np.array([r["node"] for r in rows])
        n = link.sum(1)
        for i in np.flatnonzero(n):
            own = root == root[i]
            yield int(node[i]), int(n[i]), int(node[own].min())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            done = []
            for r in b.to_pylist():
                if r["group"] != group:
                    done += judged(held)
                    group, held = r["group"], []
                held.append(r)
            yield found_rows(done)
        yield found_rows(list(judged(held)))

    return run


FOUND = "node long, links long, root long"


def found_rows(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "root"])


def whole_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (node, copy_id, digest, ...) with their texts. Ids and digests meet, so that no id is hot.

    Most texts have no near copy and stay where they are; of repeated rows each task hands on one.
    """
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    texts = with_digest(docs).select(F.col("doc_id").alias("_id"), "text", F.col("digest").alias("_digest"))
    both = rows.join(texts, (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("copy_id"))).drop("_id", "_digest", "copy_id", "digest")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keys = list(zip(b.column("node").to_pylist(), map(str, b.column("group").to_pylist()), strict=True))
            new = [k not in seen and not seen.add(k) for k in keys]
            yield b.filter(pa.array(new, pa.bool_()))

    return both.mapInArrow(once, both.schema)


class BlockFile:
    """A block of a large cluster: its nodes, their trie keys by tree, shingle sets and components within the block."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as f:
            t = pa.ipc.open_stream(f).read_all()
        self.node, self.root = t["node"].to_numpy(), t["root"].to_numpy()
        self.keys = np.array(t["keys"].to_pylist(), np.int64).reshape(-1, TREES)
        self.met = np.array(t["met"].to_pylist(), bool).reshape(-1, TREES)
        self.sets = [np.array(x.as_py(), np.uint64) if x.values is None else x.values.to_numpy() for x in t["shingles"]]


def meet(a: BlockFile, b: BlockFile) -> np.ndarray:
    """Which nodes of two blocks share a trie node."""
    out = np.zeros((len(a.node), len(b.node)), bool)
    for t in range(TREES):
        out |= (a.keys[:, None, t] == b.keys[None, :, t]) & a.met[:, None, t] & b.met[None, :, t]
    return out


def across(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Jaccard similarities of the sets of one list and those of another."""
    flat = [np.concatenate(x) for x in (a, b)]
    values = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    parts = []
    for sets, x in zip((a, b), flat, strict=True):
        at = np.minimum(np.searchsorted(values, x), max(0, len(values) - 1))
        ok = values[at] == x if len(values) else np.zeros(len(x), bool)
        who, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]
        order = np.argsort(col, kind="stable")
        parts.append((who[order], col[order]))
    both = np.zeros((len(a), len(b)))
    for lo in range(0, len(values), width):
        m = []
        for sets, (who, col) in zip((a, b), parts, strict=True):
            x, z = np.searchsorted(col, [lo, lo + width])
            m.append(np.zeros((len(sets), min(width, len(values) - lo)), np.float32))
            m[-1][who[x:z], col[x:z] - lo] = 1
        both += m[0] @ m[1].T
    size = [np.array([len(s) for s in x]) for x in (a, b)]
    return both / np.maximum(size[0][:, None] + size[1][None, :] - both, 1)


def write_blocks(threshold: float, folder: str):
    """Kernel over rows ordered by block: node, copy, text, group (the block's number), keys, met.

    Gives block, file and the block's own links: node, links, root.
    """

    def written(rows: list[dict]) -> Iterator[tuple]:
        rows = list({r["node"]: r for r in rows if genuine(r["text"], r["copy"])}.values())
        if not rows:
            return
        sets, node = [shingles(r["text"]) for r in rows], np.array([r["node"] for r in rows])
        keys, met = np.array([r["keys"] for r in rows]), np.array([r["met"] for r in rows])
        share = np.zeros((len(rows), len(rows)), bool)
        for t in range(TREES):
            share |= (keys[:, None, t] == keys[None, :, t]) & met[:, None, t] & met[None, :, t]
        link = share & (across(sets, sets) >= threshold - 1e-12)
        np.fill_diagonal(link, False)
        root = node[smallest_reachable(link)]
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"block-{uuid.uuid4().hex}.arrows"
        t = pa.table({"node": node, "root": root, "keys": pa.array(keys.tolist(), pa.list_(pa.int64())), "met": pa.array(met.tolist(), pa.list_(pa.bool_())), "shingles": pa.array(sets, pa.list_(pa.uint64()))})
        with fs.open_output_stream(f"{path}/{name}") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
        for k, n in enumerate(link.sum(1).tolist()):
            yield rows[0]["group"], f"{folder}/{name}", int(node[k]), n, int(root[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["block", "file", "node", "links", "root"])

        group, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["group"] != group:
                    yield out(list(written(held)))
                    group, held = r["group"], []
                held.append(r)
        yield out(list(written(held)))

    return run


def compare_blocks(threshold: float):
    """Kernel over (file, other) ordered by file: a file's links into all others, and the components that they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lru_cache(maxsize=4)(BlockFile)
        file, own, n = None, None, None

        def done() -> pa.RecordBatch:
            return found_rows([(int(own.node[k]), int(n[k]), int(own.root[k])) for k in np.flatnonzero(n)])

        for b in batches:
            for x, y in zip(b.column("file").to_pylist(), b.column("other").to_pylist(), strict=True):
                if x != file:
                    if own is not None:
                        yield done()
                    file, own = x, BlockFile(x)
                    n = np.zeros(len(own.node), np.int64)
                other = load(y)
                share = meet(own, other)
                rows, cols = np.flatnonzero(share.any(1)), np.flatnonzero(share.any(0))
                if not len(rows):
                    continue
                link = share[np.ix_(rows, cols)] & (across([own.sets[k] for k in rows], [other.sets[k] for k in cols]) >= threshold - 1e-12)
                n[rows] += link.sum(1)
                if x < y:  # the other way round says the same
                    i, j = np.nonzero(link)
                    yield found_rows([(int(p), 0, int(q)) for p, q in {*zip(own.root[rows[i]].tolist(), other.root[cols[j]].tolist(), strict=True)}])
        if own is not None:
            yield done()

    return run


def crowd_links(docs: DataFrame, big: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """Links of the nodes of large clusters that share a trie node: node, links, root. Each text moves once."""
    own = met.join(big.select("node"), "node", "left_semi")
    top = own.groupBy("node").agg(F.max(F.struct("n", "tree", "key")).alias("top"), F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("path"))  # at most one a tree
    at = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.try_element_at("path", t))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("top.n") / BLOCK))
    placed = big.join(top, "node").select(
        "node", "copy", "copy_id", "digest", F.xxhash64("top.tree", "top.key", part).alias("group"),
        F.transform(at, lambda x: F.coalesce(x, F.lit(0))).alias("keys"), F.transform(at, lambda x: x.isNotNull()).alias("met"),
    )
    placed = stored(placed, "placed")
    rows = whole_texts(docs, placed).repartition("group").sortWithinPartitions("group")
    blocks = stored(rows.mapInArrow(tidy(write_blocks(threshold, shared_dir(docs.sparkSession, "blocks"))), f"block long, file string, {FOUND}"), "blocks")
    files = blocks.select("block", "file").distinct()
    seen = placed.select(F.col("group").alias("block"), F.posexplode(F.arrays_zip("keys", "met")).alias("tree", "x")).filter("x.met").select("block", "tree", F.col("x.keys").alias("key")).distinct()
    pairs = seen.join(seen.withColumnRenamed("block", "against"), ["tree", "key"]).filter("block <> against").select("block", "against").distinct()
    jobs = pairs.join(files, "block").join(files.select(F.col("block").alias("against"), F.col("file").alias("other")), "against").select("file", "other")
    more = stored(jobs.repartition("file").sortWithinPartitions("file", "other").mapInArrow(tidy(compare_blocks(threshold)), FOUND), "across")
    return blocks.select("node", "links", "root").unionByName(more)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, copy_id (the smallest id of the same text), n_links (of the text to different ones)."""
    return classes_of(docs, threshold, recall).select("doc_id", "class_id", "copy_id", "n_links")


def with_copies(df: DataFrame) -> DataFrame:
    """Add copy, 128 bits of the text, as classes have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(copies, pa.binary())], [*b.schema.names, "copy"])

    return df.mapInArrow(tidy(run), type(df.schema)([*df.schema.fields]).add("copy", "binary"))


def classes_of(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of near_duplicates with copy and root, which tell texts and classes apart where ids are repeated or null."""
    signed = stored(signatures(docs), "signatures")
    nodes = signed.groupBy("copy").agg(F.min("doc_id").alias("copy_id"), F.first("digest").alias("digest"), F.first("signature").alias("signature"), F.first("width").alias("width"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so ids hold
    found = stored(forest_links(docs, nodes, threshold, recall), "links")
    # a node may have several rows; their roots join in the classes
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "copy", "copy_id").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stored(known.drop("node"), "known")
    classes = known.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = known.join(classes, "root").select("copy", "root", "copy_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return skew_join(signed.select("doc_id", "copy"), known, ["copy"], "inner", HOT_TEXTS).select("doc_id", "copy", "root", "class_id", "copy_id", "n_links")


def clusters(nodes: DataFrame, depth: int) -> DataFrame:
    """node, root, size, load, copy, copy_id, digest of the nodes that meet others at a depth: their candidate clusters."""
    keys = meeting(nodes, depth)
    low = keys.groupBy("tree", "key").agg(F.count("*").alias("n"), F.min("node").alias("low")).filter("n > 1").drop("n")
    edges = keys.join(low, ["tree", "key"]).filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    roots = components(edges).join(nodes.select("node", "width", "copy", "copy_id", "digest"), "node")
    roots = stored(roots, "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"), load_of(F.count("*")).alias("load"))
    return stored(roots.join(sizes, "root"), "members")


def verified(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Links within clusters of bounded size, each row once for each pair of blocks that its block is in."""
    small = members.withColumn("blocks", F.ceil(F.col("load") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    small = small.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    small = stored(small.select("node", "copy", "copy_id", "digest", F.struct("root", i.alias("i"), j.alias("j")).alias("group"), F.when(F.col("block") == i, F.lit(0)).otherwise(F.lit(1)).alias("side")), "rows")
    return whole_texts(docs, small).repartition("group").sortWithinPartitions("group").mapInArrow(tidy(verify(threshold)), FOUND)


def unchanged(members: DataFrame, before: DataFrame) -> DataFrame:
    """root of clusters that have just the nodes of one verified cluster of the depth before."""
    old = before.select("node", F.col("root").alias("was"), F.col("size").alias("had"))
    both = members.select("node", "root", "size").join(old, "node", "left").groupBy("root")
    both = both.agg(F.first("size").alias("size"), F.count("was").alias("known"), F.min("was").alias("a"), F.max("was").alias("b"), F.max("had").alias("had"))
    return both.filter("known = size AND a = b AND had = size").select("root")


def forest_links(docs: DataFrame, nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Verified links: node, links, root, depth (of the prefixes that brought its cluster together), in one or more rows a node."""
    before, kept = None, None
    for depth in range(DEPTH, depth_for(threshold, recall) - 1, -1):
        members = clusters(nodes, depth)
        small = members.filter((F.col("size") <= CLUSTER) & (F.col("load") <= CLUSTER))
        if before is not None:
            same = stored(unchanged(small, before), "unchanged")
            kept = kept.join(members.join(same, "root", "left_semi").select("node"), "node", "left_semi")
            new = small.join(same, "root", "left_anti")
        else:
            new = small
        new = verified(docs, new, threshold).withColumn("depth", F.lit(depth))
        kept = stored(new if kept is None else kept.unionByName(new), "verified")
        before = small
    crowd = members.join(small.select("root").distinct(), "root", "left_anti").drop("root", "size", "load", "width")
    if crowd.isEmpty():
        return kept
    own = nodes.join(crowd.select("node"), "node", "left_semi")
    keys = meeting(own, SHORTEST)
    tries = keys.groupBy("tree", "key").agg(F.count("*").alias("rows"), load_of(F.count("*")).alias("n")).filter("rows > 1").drop("rows")
    met = stored(keys.drop("width").join(tries, ["tree", "key"]), "tries")
    return kept.unionByName(crowd_links(docs, stored(crowd, "crowd"), met, threshold).withColumn("depth", F.lit(SHORTEST)))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)


OP9_SQL = r"""
WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS copy_id FROM documents GROUP BY 1),
words AS (SELECT copy_id, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM texts),
grams AS (SELECT DISTINCT copy_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT copy_id, count(*) AS n FROM grams GROUP BY ALL),
shared AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.copy_id = a JOIN sizes y ON y.copy_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT copy_id AS node, copy_id AS root FROM texts UNION SELECT b, root FROM reach JOIN links ON a = node),
classes AS (SELECT node AS copy_id, min(root) AS class_id FROM reach GROUP BY ALL),
counts AS (SELECT a AS copy_id, count(*) AS n_links FROM links GROUP BY ALL)
SELECT doc_id, class_id, copy_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents JOIN texts ON t = coalesce(text, '') JOIN classes USING (copy_id) LEFT JOIN counts USING (copy_id)
"""
