"""What kind of project a tree is, which project and solution each file belongs to, and which analyser takes it.

A file belongs to the nearest folder above it that holds a marker, and to the nearest solution of
its language: files are exploded into their ancestor folders, which meet markers by equality, and
the deepest one wins. A solution's hash is made from sums over its files, so that no task sees all
of a solution's paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions import paths
from kelpie.operators.joins import HOT_ROWS, skew_join
from kelpie.sources import scan

# Files that mark a project, and the analyser by extension.
MARKERS = {"dotnet": (".sln", ".csproj"), "java-maven": ("pom.xml",), "java-gradle": ("build.gradle", "build.gradle.kts"), "node": ("package.json",), "python": ("pyproject.toml", "setup.py", "requirements.txt"), "go": ("go.mod",)}
ANALYSERS = {".cs": "roslyn", ".java": "spoon", ".md": "markdown", ".markdown": "markdown", ".yaml": "yaml", ".yml": "yaml"}


def project_type(files: DataFrame) -> DataFrame:
    """One row (project_type): none of the markers is unknown, one that one, several mixed.

    A Maven file beside no Gradle file is Maven alone.
    """
    name = paths.file_name("file_path")
    seen = [F.coalesce(F.bool_or(F.coalesce(*(F.when(name.endswith(m) if m.startswith(".") else name == m, F.lit(True)) for m in marks), F.lit(False))), F.lit(False)).alias(k) for k, marks in MARKERS.items()]
    found = F.array_compact(F.array(*(F.when(F.col(f"`{k}`"), F.lit(k)) for k in MARKERS)))
    return files.agg(*seen).select(F.when(F.size(found) == 0, "unknown").when(F.size(found) == 1, found[0]).otherwise("mixed").alias("project_type"))


def routed(files: DataFrame, available: tuple[str, ...] = ()) -> DataFrame:
    """Adds analyser: the file type's own where it is available, else the built-in splitters."""
    pairs = [F.lit(x) for kv in ANALYSERS.items() for x in kv]
    own = F.element_at(F.create_map(*pairs), paths.extension("file_path"))
    external = own.isin("roslyn", "spoon") & ~own.isin(*available) if available else own.isin("roslyn", "spoon")
    return files.withColumn("analyser", F.when(external | own.isNull(), "built-in").otherwise(own))


def marks(name: Column) -> Column:
    """The kinds of project that a file of this name marks."""
    found = [F.when(F.greatest(*(name.endswith(m) if m.startswith(".") else name == m for m in marks), F.lit(False)), F.lit(k)) for k, marks in MARKERS.items()]
    return F.array_compact(F.array(*found))


def project_roots(files: DataFrame) -> DataFrame:
    """(folder, project_type) of folders that hold a marker: one kind is that one, several are mixed."""
    each = files.select(scan.folder("file_path").alias("folder"), F.explode(marks(paths.file_name("file_path"))).alias("kind"))
    return each.groupBy("folder").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).select("folder", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("project_type"))


def nearest_project(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(file_path, project_root, project_type): the deepest folder above a file that holds a marker, else the root, unknown."""
    up = files.select("file_path", F.explode(scan.ancestors("file_path")).alias("folder"))
    met = skew_join(up, project_roots(files), ["folder"], "left", hot_rows)
    deepest = F.max_by(F.struct("folder", "project_type"), F.when(F.col("project_type").isNotNull(), F.length("folder")).otherwise(-1))
    one = met.groupBy("file_path").agg(deepest.alias("x"))
    known = F.col("x.project_type").isNotNull()
    return one.select("file_path", F.when(known, F.col("x.folder")).otherwise("").alias("project_root"), F.coalesce("x.project_type", F.lit("unknown")).alias("project_type"))


def nearest_solution(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(file_path, file_hash, solution): the deepest solution of its language above a file, the first by name of several in one folder."""
    met = scan.solution_files(files, hot_rows).withColumn("depth", F.length(scan.folder("solution")))
    return met.groupBy("file_path", "file_hash").agg(F.min_by("solution", F.struct(-F.col("depth"), "solution")).alias("solution"))


def solution_hashes(members: DataFrame, version: str = "") -> DataFrame:
    """(solution, files, solution_hash) from (solution, file_path, file_hash); another version of the analyser is another hash.

    The hash of a set is made from how many files it has and two sums over their hashes, in any order.
    """
    digest = F.md5(F.concat_ws(":", "file_path", "file_hash"))
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 14), 16, 10).cast("decimal(38,0)"))
    sums = members.groupBy("solution").agg(F.count("*").alias("files"), part(1).alias("a"), part(15).alias("b"))
    return sums.select("solution", "files", F.md5(F.concat_ws(":", F.lit(version), F.col("files").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))).alias("solution_hash"))


def changed_solutions(current: DataFrame, known: DataFrame) -> DataFrame:
    """(solution, solution_hash) of solutions that are new or have another hash than was known of them."""
    old = known.select("solution", F.col("solution_hash").alias("old"))
    return current.join(old, "solution", "left").filter("old IS NULL OR old <> solution_hash").select("solution", "solution_hash")
