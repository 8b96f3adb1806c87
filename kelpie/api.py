"""The tool surface: what a caller does with an index, as functions of one engine."""

from __future__ import annotations

import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.text import snippet
from kelpie.operators import chunking, graph, retrieval
from kelpie.plans import search
from kelpie.plans.index import Index
from kelpie.sources import artifacts, projects, scan
from kelpie.sources.store import stored

SECRET = re.compile(r"key|token|secret|password|credential", re.I)


class Engine:
    def __init__(self, spark: SparkSession, path: str, **options):
        self.spark, self.idx = spark, Index(spark, path, **options)

    def index(self, root: str, artifacts_path: str | None = None) -> dict[str, int]:
        return self.idx.index(root, artifacts_path)

    def index_status(self) -> dict[str, object]:
        return self.idx.status()

    def quick_search(self, query: str, operator: str = "hybrid", top_k: int = 10, filters: dict | None = None) -> DataFrame:
        """Twice as many hits as asked for, reranked, with 300 characters of each."""
        hits = self.idx.search(query, operator, filters, 2 * top_k)
        best = retrieval.simple_rerank(hits, query, "content", m=top_k, key="chunk_id")
        return best.select("chunk_id", "file_path", "name", "score", "score_rerank", snippet("content", 300).alias("preview"))

    def search(self, query: str, max_iterations: int = 5, planner: search.Planner | None = None, with_graph: bool = True) -> search.Result:
        """The whole loop; the number of rounds holds for this call alone."""
        nodes, edges = (self.idx.symbols(), self.idx.edges()) if with_graph else (None, None)
        return search.run(self.idx, query, planner, search.Budget(max_iterations=max_iterations), nodes, edges)

    def analyze(self, root: str, output: str | None = None, extensions: tuple[str, ...] = (), artifacts_path: str | None = None) -> dict[str, object]:
        """Counts of what a tree would give, its kind, and the first errors; artifacts go to the output folder.

        Files that other analysers' artifacts cover count by these, the rest by the built-in splitters.
        """
        files = scan.scan(self.spark, root)
        if extensions:
            files = files.filter(F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(*extensions))
        records = chunking.records(files)
        if artifacts_path:
            covered = artifacts.below(artifacts.read(self.spark, artifacts_path), root).join(files.select("file_path"), "file_path", "left_semi")
            records = chunking.two_phase(files, covered).unionByName(artifacts.records(covered, self.idx.project), allowMissingColumns=True)
        records = stored(records, "records")  # each file is split once
        if output:
            artifacts.write(records, output)
        counts = {r["record"]: r["count"] for r in records.groupBy("record").count().collect()}
        errors = [r.asDict() for r in records.filter("record = 'error'").select("file_path", "content").limit(10).collect()]
        return {"project_type": projects.project_type(files).first()[0], "files": files.count(), "symbols": counts.get("symbol", 0), "relations": counts.get("edge", 0), "errors": errors}

    def graph_neighbors(self, name: str, depth: int = 1, direction: str = "both", types: list[str] | None = None) -> DataFrame:
        nodes = self.idx.symbols()
        return graph.neighbors(nodes, self.idx.edges(), graph.seed(nodes, name), depth, direction, types)

    def graph_query(self, sql: str, args: dict | None = None) -> DataFrame:
        return graph.query(self.spark, sql, self.idx.symbols(), self.idx.edges(), self.idx.table("files"), args)

    def graph_status(self) -> DataFrame:
        return graph.stats(self.idx.symbols(), self.idx.table("files"), self.idx.edges())

    def graph_projects(self) -> DataFrame:
        return graph.projects(self.idx.symbols())

    def debug(self) -> dict[str, str]:
        """Settings; anything that looks secret is left out."""
        return {k: "***" if SECRET.search(k) else v for k, v in sorted(os.environ.items()) if k.startswith(("INDEX_", "SPARK_"))}


def resolve(value: str) -> str:
    """${NAME} and ${NAME:-default} from the environment."""
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1]) or m[2] or "", value)


def main(argv: list[str]) -> int:
    """python -m kelpie.api INDEX QUERY..."""
    spark = SparkSession.builder.appName("kelpie").getOrCreate()
    for r in Engine(spark, argv[0]).quick_search(" ".join(argv[1:])).collect():
        print(f"{r['score_rerank']:.3f} {r['file_path']} {r['name']}\n    {r['preview']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
