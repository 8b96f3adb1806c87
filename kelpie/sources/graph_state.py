"""The symbol graph of many projects as changes beside one another, keyed by project and file.

A file owns the symbols that it defines and the relations that it states. Putting files replaces
what they owned; deleting files or a whole project leaves tombstones for their keys, in proportion
to what goes, and rows of other projects are neither read nor written for it. A relation lives as
long as a file that states it. Its ends live as long as any relation or file needs them: an end
that no file of its project defines any more is shown as a placeholder, and as the symbol again
once a file defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.operators import graph
from kelpie.sources import scan
from kelpie.sources.store import ChangeLog

KEYS = ["project", "file_path"]
SYMBOLS = "project string, file_path string, fqn string, name string, kind string"
EDGES = "project string, file_path string, type string, source string, target string"
FILES = "project string, file_path string, file_hash string"


class GraphState:
    """Symbols, relations and file hashes below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, ChangeLog(spark, path, {"files": FILES, "symbols": SYMBOLS, "edges": EDGES}, KEYS)

    def _own(self, table: str, project: str | None) -> DataFrame:
        rows = self.log.read(table)
        return rows if project is None else rows.filter(F.col("project") == project)

    def hashes(self, project: str) -> DataFrame:
        """(file_path, file_hash) of a project's files that have a hash."""
        return self._own("files", project).filter("file_hash IS NOT NULL").select("file_path", "file_hash")

    def delta(self, project: str, current: DataFrame) -> DataFrame:
        """(file_path, status) of a project's files as they are now (file_path, file_hash)."""
        return scan.delta(current, self.hashes(project))

    def put(self, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict[str, int]:
        """Replace what these files (project, file_path, file_hash) owned; rows that belong to none of them are left out.

        Returns how many keys and rows were written.
        """
        keys = files.select(*KEYS)
        own = lambda rows: rows.join(keys, KEYS, "left_semi")
        # several files may state one relation, which outlives any of them
        clean = graph.clean_edges(edges, ["file_path"])
        return self.log.commit(keys, {"files": files, "symbols": own(symbols.filter("fqn IS NOT NULL")), "edges": own(clean)})

    def delete_files(self, project: str, paths: DataFrame) -> int:
        """Remove files (file_path) and what they owned; how many there were."""
        known = self._own("files", project).select(*KEYS).join(paths.select("file_path"), "file_path", "left_semi")
        return self.log.commit(known, {})["gone"]

    def delete_project(self, project: str) -> int:
        return self.log.commit(self._own("files", project).select(*KEYS), {})["gone"]

    def edges(self, project: str | None = None) -> DataFrame:
        """(project, type, source, target), each once however many files state it."""
        return self._own("edges", project).select("project", "type", "source", "target").distinct()

    def nodes(self, project: str | None = None) -> DataFrame:
        """(project, fqn, name, kind, file_path): symbols, of several definitions the one of the first file, and placeholders for other ends."""
        named = self._own("symbols", project).groupBy("project", "fqn").agg(F.min(F.struct("file_path", "name", "kind")).alias("x"))
        named = named.select("project", "fqn", "x.name", "x.kind", "x.file_path")
        return graph.with_endpoints(named, self.edges(project)).select("project", "fqn", "name", "kind", "file_path")

    def projects(self) -> DataFrame:
        return self.log.read("files").select("project").distinct()
