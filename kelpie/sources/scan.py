"""Scanning a source tree, hashes, and what has changed since the last index."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import paths
from kelpie.operators.joins import HOT_ROWS, skew_join


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Indexable files below a folder: file_path (relative), file_hash, content (text), category, language.

    Bytes are read by the executors; excluded paths are dropped before any file is opened.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    below = base.removeprefix("file://").removeprefix("file:") + "/"
    relative = F.substr("path", F.locate(below, F.col("path")) + F.lit(len(below)))
    own = files.select(relative.alias("file_path"), "content", "length").filter(~paths.is_excluded("file_path"))
    return own.select("file_path", F.md5("content").alias("file_hash"), decoded(F.col("content")).alias("content"), paths.category("file_path").alias("category"), paths.language("file_path").alias("language"))


def named_files(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """(file_path, file_hash) of files below a folder that are called so or, where a name begins with a dot, end so; excluded paths too."""
    base = root.rstrip("/")
    glob = "{" + ",".join(f"*{n}" if n.startswith(".") else n for n in names) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    below = base.removeprefix("file://").removeprefix("file:") + "/"
    relative = F.substr("path", F.locate(below, F.col("path")) + F.lit(len(below)))
    return files.select(relative.alias("file_path"), F.md5("content").alias("file_hash"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, without a byte-order mark, or UTF-16 where one says so."""
    mark = F.hex(F.substring(content, 1, 2))
    utf16 = mark.isin("FFFE", "FEFF")
    return F.when(utf16, F.decode(content, "UTF-16")).otherwise(F.regexp_replace(content.cast("string"), "^\ufeff", ""))


def aggregate_hash(files: DataFrame, path: str = "file_path", file_hash: str = "file_hash", by: tuple[str, ...] = ()) -> DataFrame:
    """md5 over ``path:hash`` lines in path order, of all files or of each group (a solution's files)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(file_hash).alias("h"))))
    lines = F.transform(rows, lambda x: F.concat(x["p"], F.lit(":"), x["h"], F.lit("\n")))
    return files.groupBy(*by).agg(F.md5(F.array_join(lines, "")).alias("hash"))


def directory_hash(root: str) -> str:
    """md5 of all bytes below a local folder in path order: the version of a tool, not of data."""
    h = hashlib.md5()
    for p in sorted(Path(root).rglob("*")):
        if p.is_file():
            h.update(p.read_bytes())
    return h.hexdigest()


def delta(current: DataFrame, known: DataFrame, root: str | None = None) -> DataFrame:
    """(file_path, status): new, changed, deleted or same, by hash; with a root only what lies below it can be deleted."""
    old = known.select("file_path", F.col("file_hash").alias("old_hash"))
    if root:
        old = old.filter(F.col("file_path").startswith(root))
    both = current.select("file_path", "file_hash").join(old, "file_path", "full_outer")
    status = (
        F.when(F.col("old_hash").isNull() & F.col("file_hash").isNotNull(), "new")
        .when(F.col("file_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("file_hash"), "changed")
        .otherwise("same")
    )
    return both.select("file_path", status.alias("status"))


def known_hashes(chunks: DataFrame) -> DataFrame:
    """(file_path, file_hash) of indexed files."""
    return chunks.groupBy("file_path").agg(F.min("file_hash").alias("file_hash"))


SOLUTIONS = {".sln": (".cs",), "pom.xml": (".java",), "build.gradle": (".java",)}


def folder(path: Column | str) -> Column:
    """A path's folder with a slash at its end; the root is empty."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def ancestors(path: Column | str) -> Column:
    """All folders that a path lies in, the root first."""
    parts = F.split(folder(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    return F.array_distinct(above)


def solutions(files: DataFrame) -> DataFrame:
    """(solution, ext, folder): files that stand for a solution, with their files' extension."""
    marks = [(F.col("file_path").endswith(k), v) for k, v in SOLUTIONS.items()]
    ext = F.coalesce(*(F.when(m, F.lit(v[0])) for m, v in marks))
    return files.select(F.col("file_path").alias("solution"), ext.alias("ext"), folder("file_path").alias("folder")).filter("ext IS NOT NULL")


def solution_files(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(solution, file_path, file_hash): each solution's files, those below its folder with its extension.

    Every file looks up its own ancestors, so that no file meets every solution; the root, which
    all files share, is dealt over several tasks.
    """
    own = files.select("file_path", "file_hash", paths.extension("file_path").alias("ext"), F.explode(ancestors("file_path")).alias("folder"))
    return skew_join(own, solutions(files), ["ext", "folder"], "inner", hot_rows).select("solution", "file_path", "file_hash")
