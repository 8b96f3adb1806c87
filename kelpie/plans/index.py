"""The index over a source tree: incremental builds, status, and searching by operator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import embed, paths, sparse
from kelpie.operators import chunking, graph, impacts, resolve, retrieval
from kelpie.sources import artifacts, projects, scan
from kelpie.sources.cache import EmbeddingCache
from kelpie.sources.store import ChangeLog, stored

CHUNKS = "chunk_id string, file_path string, file_hash string, category string, language string, name string, node_type string, fqn string, content string, chunk_index int, total_chunks int, start_line int, end_line int, embedding array<double>"
POSTINGS = "chunk_id string, file_path string, term int, tf long"
FILES = "file_path string, file_hash string, category string, language string, project_root string, project_type string, analyser string"
#: A solution's hash lies with the file that stands for it.
SOLUTIONS = "file_path string, solution_hash string"
EDGES = "project string, type string, source string, target string, file_path string"


class Index:
    """Tables below one folder that change together (files, chunks, postings, edges), and the embedding cache."""

    def __init__(self, spark: SparkSession, path: str, identity: str = "hashing-64", embedder: embed.Embedder = embed.hashing_embedder, project: str = "default", analysers: str = "1", sparse_mode: str = "bm25", expander: impacts.Expander = impacts.by_heads):
        """analysers is the version of whatever writes artifacts; with another one all solutions count as changed.

        sparse_mode is bm25, learned (vectors by the expander) or disabled (no sparse vectors: keywords
        find nothing, and hybrid searches rank by meaning alone).
        """
        if sparse_mode not in impacts.MODES:
            raise ValueError(f"sparse_mode must be one of {impacts.MODES}")
        self.spark, self.path, self.identity, self.embedder, self.project, self.analysers = spark, path, identity, embedder, project, analysers
        self.sparse_mode, self.expander = sparse_mode, expander
        self._blocks: tuple[int, impacts.BlockIndex] | None = None
        self._dimension: int | None = None
        self._resolved: tuple[int, DataFrame] | None = None
        self.log = ChangeLog(spark, f"{path}/log", {"files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "edges": EDGES, "solutions": SOLUTIONS}, ["file_path"])
        self.cache = EmbeddingCache(spark, f"{path}/cache", identity, embedder)

    def table(self, name: str) -> DataFrame:
        return self.log.read(name)

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def needs_rebuild(self) -> bool:
        """Whether the index was made by another model or another kind of sparse vectors."""
        about = self.log.state()["about"]
        return bool(about) and (about["identity"], about["sparse"], about["dimension"]) != (self.identity, self.sparse_mode, self.dimension())

    def dimension(self) -> int:
        """The length of the embedder's vectors."""
        if self._dimension is None:
            self._dimension = len(self.embedder(["dimension"])[0])
        return self._dimension

    def index(self, root: str, artifacts_path: str | None = None) -> dict[str, int]:
        """Take in what changed below the root; a second call on the same tree finds nothing to do.

        Changed files that an analyser's artifact covers come in from there, others are split here.
        """
        if self.needs_rebuild():
            self.log.drop()
        found = scan.scan(self.spark, root).withColumn("root", F.lit(root.rstrip("/")))
        files = found.withColumn("file_path", F.concat_ws("/", "root", "file_path")).drop("root")
        known = self.table("files")
        status = stored(scan.delta(files, known, root.rstrip("/") + "/"), "delta")
        counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        marks = scan.named_files(self.spark, root, sorted({*scan.SOLUTIONS, *(m for ms in projects.MARKERS.values() for m in ms)}))
        marks = marks.withColumn("file_path", F.concat_ws("/", F.lit(root.rstrip("/")), "file_path"))
        around = stored(files.select("file_path", "file_hash").unionByName(marks).distinct(), "around")
        members = projects.nearest_solution(around)
        known_solutions = self.table("solutions").withColumnRenamed("file_path", "solution")
        hashes = stored(projects.solution_hashes(members, self.analysers), "hashes")
        solved = stored(projects.changed_solutions(hashes, known_solutions), "solutions")
        lost = known_solutions.filter(F.col("solution").startswith(root.rstrip("/") + "/")).join(hashes, "solution", "left_anti")
        out = {"indexed": counts.get("new", 0) + counts.get("changed", 0), "deleted": counts.get("deleted", 0), "skipped": counts.get("same", 0), "errors": 0}
        if not out["indexed"] and not out["deleted"] and solved.isEmpty():
            return out
        # besides what changed itself: the files that stand for changed solutions, and those of their files that an artifact covers
        again = solved.select(F.col("solution").alias("file_path"))
        covered = None
        if artifacts_path:
            covered = artifacts.below(artifacts.read(self.spark, artifacts_path), root)
            covered = covered.withColumn("file_path", F.concat_ws("/", F.lit(root.rstrip("/")), "file_path"))
            theirs = members.join(solved.select("solution"), "solution", "left_semi").select("file_path")
            again = again.unionByName(theirs.join(covered.select("file_path"), "file_path", "left_semi"))
        wanted = stored(status.filter("status IN ('new', 'changed')").select("file_path").unionByName(again).distinct(), "wanted")
        gone = status.filter("status = 'deleted'").select("file_path").unionByName(wanted).unionByName(lost.select(F.col("solution").alias("file_path")))
        about_files = projects.nearest_project(around).join(wanted, "file_path", "left_semi")
        fresh = stored(projects.routed(files.join(wanted, "file_path", "left_semi")).join(about_files, "file_path"), "fresh")
        records = chunking.records(fresh)
        if covered is not None:
            covered = covered.join(fresh.select("file_path"), "file_path", "left_semi")
            records = chunking.two_phase(fresh, covered).unionByName(artifacts.records(covered, self.project), allowMissingColumns=True)
        records = stored(records, "records")
        out["errors"] = records.filter("record = 'error'").count()
        own = records.filter("record = 'symbol'").join(fresh.select("file_path", "file_hash", "category", "language"), "file_path")
        own = own.withColumn("chunk_id", F.sha2(F.concat_ws("\x00", "file_path", F.col("chunk_index").cast("string"), "content"), 256))
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        new = stored(self.cache.embed(own).select(*names), "chunks")
        new_postings = self._postings(new).join(new.select("chunk_id", "file_path"), "chunk_id").select("chunk_id", "file_path", "term", "tf")
        edges = records.filter("record = 'edge'").select(F.lit(self.project).alias("project"), F.col("node_type").alias("type"), "source", "target", "file_path")
        # one change: what breaks off before its end is as if it had never begun, and is taken in again
        about = {"identity": self.identity, "sparse": self.sparse_mode, "dimension": self.dimension()}
        rows = {"chunks": new, "postings": new_postings, "edges": edges, "files": fresh, "solutions": solved.withColumnRenamed("solution", "file_path")}
        self.log.commit(gone, rows, about)
        return out

    def _postings(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, term, tf) of new chunks; tf is the impact where vectors are learned."""
        if self.sparse_mode == "learned":
            return impacts.impact_postings(chunks, "chunk_id", "content", self.expander).select("chunk_id", "term", F.col("impact").cast("long").alias("tf"))
        own = chunks if self.sparse_mode == "bm25" else chunks.limit(0)
        return sparse.postings(own, "chunk_id", "content")

    def _keyword_leg(self, queries: Sequence[tuple[int, str]], chunks: DataFrame, where: Column | None, n: int) -> DataFrame | None:
        """(query_ord, chunk_id, score, rank) by sparse vectors, None where there are none."""
        if self.sparse_mode == "disabled":
            return None
        postings = self.table("postings")
        own = postings.join(chunks.filter(where).select("chunk_id"), "chunk_id", "left_semi") if where is not None else postings
        if self.sparse_mode == "bm25":
            weights = sparse.idf(postings, "chunk_id", chunks.count())
            return retrieval.keyword_top_k(own, weights, retrieval.query_terms(self.spark, queries), "chunk_id", n).withColumn("score", F.col("score") / 1_000_000.0)
        terms = impacts.query_impacts(self.spark, queries, self.expander)
        if where is not None:  # blocks are made over all chunks
            met = own.join(F.broadcast(terms), "term").groupBy("query_ord", "chunk_id").agg(F.sum(F.col("weight") * F.col("tf")).alias("score"))
            return retrieval.top_k(met, n, "chunk_id").withColumn("score", F.col("score").cast("double"))
        number = self.log.state()["number"]
        if self._blocks is None or self._blocks[0] != number:
            self._blocks = (number, impacts.build(postings.select("chunk_id", "term", F.col("tf").cast("int").alias("impact")), "chunk_id"))
        return impacts.impact_top_k(self._blocks[1], terms, n).withColumn("score", F.col("score").cast("double"))

    def status(self) -> dict[str, object]:
        chunks = self.chunks()
        by = retrieval.category_counts(chunks, paths.CATEGORIES).collect()
        return {"files": self.table("files").count(), "chunks": chunks.count(), "identity": self.identity, "categories": {r["category"]: r["n"] for r in by}}

    def symbols(self) -> DataFrame:
        c = self.chunks().filter("fqn IS NOT NULL")
        return graph.with_endpoints(c.select(F.lit(self.project).alias("project"), "fqn", "name", F.col("node_type").alias("kind"), "file_path").dropDuplicates(["project", "fqn"]), self.edges())

    def edges(self) -> DataFrame:
        """The relations of all files, with targets as the symbols that they mean; worked out once for each state of the index."""
        number = self.log.state()["number"]
        if self._resolved is None or self._resolved[0] != number:
            own = graph.clean_edges(self.table("edges"))
            imports = own.filter("type = 'IMPORTS'")
            symbols = self.chunks().filter("fqn IS NOT NULL").select(F.lit(self.project).alias("project"), "fqn")
            named = resolve.resolve(own.filter("type <> 'IMPORTS'"), symbols, imports).drop("how")
            self._resolved = (number, stored(graph.clean_edges(named.unionByName(imports)), "edges"))
        return self._resolved[1]

    def _ranked(self, queries: Sequence[tuple[int, str]], operator: str, filters: dict | None, n: int) -> DataFrame:
        """(query_ord, chunk_id, score, rank) of queries that share an operator and filters."""
        chunks = self.chunks()
        where = retrieval.filters(filters)
        legs = []
        if operator in ("keyword", "hybrid", "exact") and (leg := self._keyword_leg(queries, chunks, where if filters else None, n)) is not None:
            legs.append(leg)
        if operator in ("semantic", "hybrid", "exact"):
            distinct = list(dict.fromkeys(q for _, q in queries))  # each text goes to the model once
            vectors = dict(zip(distinct, self.embedder(distinct).tolist(), strict=True))
            legs.append(retrieval.semantic_top_k(chunks, "chunk_id", "embedding", [(i, vectors[q]) for i, q in queries], n, where if filters else None))
        if not legs:
            return self.spark.createDataFrame([], "query_ord int, chunk_id string, score double, rank int")
        out = legs[0] if len(legs) == 1 else retrieval.reciprocal_rank_fusion(legs, "chunk_id", n)
        if operator == "exact":
            texts = chunks.select("chunk_id", F.col("content").alias("text"))
            hits = retrieval.exact_top_k(out, texts, "chunk_id", queries, max(1, n // 2))
            out = hits.join(out.select("query_ord", "chunk_id", "score"), ["query_ord", "chunk_id"])
        return out.select("query_ord", "chunk_id", "score", "rank")

    def batch(self, queries: Sequence[tuple[str, str, dict | None]], n: int) -> DataFrame:
        """Queries (text, operator, filters) in one plan; each chunk by its first query, all by score."""
        groups: dict[tuple, list[tuple[int, str]]] = {}
        for k, (q, op, f) in enumerate(queries):
            op = op if op in ("semantic", "keyword", "exact", "hybrid") else "hybrid"
            key = (op, repr(sorted((f or {}).items())))
            groups.setdefault(key, []).append((k, q))
        parts = []
        for (op, _), own in groups.items():
            parts.append(self._ranked(own, op, queries[own[0][0]][2], (n or 100) * (2 if op == "exact" else 1)))
        hits = stored(reduce(DataFrame.unionByName, parts), "hits")
        return retrieval.merge(hits.join(self.chunks().drop("embedding"), "chunk_id"), "chunk_id")

    def search(self, query: str, operator: str = "hybrid", filters: dict | None = None, top_n: int = 100) -> DataFrame:
        return self.batch([(query, operator, filters)], top_n or 100)

    def by_path(self, path: str, limit: int = 5) -> DataFrame:
        return self.chunks().filter(F.col("file_path") == path).orderBy("chunk_index").limit(limit).withColumn("score", F.lit(0.5))

    def by_category(self, name: str, limit: int = 100) -> DataFrame:
        return self.chunks().filter(F.col("category") == name).orderBy("file_path", "chunk_index").limit(limit)
