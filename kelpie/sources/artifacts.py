"""Analysis artifacts of external analysers: JSON files of symbols and relationships, in and out.

An artifact is {file_path, language, symbols: [...], relationships: [...]}; compilers' analysers
for C# and Java write such files elsewhere, and this module takes them in.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "struct<file_path:string,namespace:string,line:int,queue_name:string>"
SYMBOL = f"struct<name:string,node_type:string,content:string,start_line:int,end_line:int,metadata:{META}>"
RELATION = f"struct<type:string,source:string,target:string,kind:string,target_name:string,metadata:{META}>"
SCHEMA = f"file_path string, language string, symbols array<{SYMBOL}>, relationships array<{RELATION}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts that name a file and have symbols."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).filter("file_path IS NOT NULL AND symbols IS NOT NULL")


def file_name(path: str) -> str:
    """An artifact's own name: the file's base name and eight digits of its path's md5."""
    return f"{path.rsplit('/', 1)[-1]}_{hashlib.md5(path.encode()).hexdigest()[:8]}.json"


def write(records: DataFrame, path: str) -> None:
    """Artifacts from the chunkers' records, a JSON row a file."""
    symbols = F.collect_list(F.when(F.col("record") == "symbol", F.struct(F.col("fqn").alias("name"), "node_type", "content", "start_line", "end_line")))
    edges = F.collect_list(F.when(F.col("record") == "edge", F.struct(F.col("node_type").alias("type"), "source", "target")))
    records.groupBy("file_path").agg(symbols.alias("symbols"), edges.alias("relationships")).write.mode("overwrite").json(path)


def short_name(fqn):
    """The last dotted part before any parameter list."""
    return F.element_at(F.split(F.substring_index(fqn, "(", 1), r"\."), -1)


def nodes(artifacts: DataFrame, project: str, source_root: str | None = None, zero_based: bool = False) -> DataFrame:
    """Graph nodes; paths below /src/ move below the source root, zero-based lines are moved up by one."""
    s = artifacts.select("file_path", F.explode("symbols").alias("s"))
    path = F.coalesce("s.metadata.file_path", "file_path")
    if source_root is not None:
        path = F.regexp_replace(path, "^/src/", source_root.rstrip("/") + "/")
    shift = 1 if zero_based else 0
    return s.select(
        F.lit(project).alias("project"), F.col("s.name").alias("fqn"), short_name(F.col("s.name")).alias("name"), F.lower("s.node_type").alias("kind"), path.alias("file_path"),
        F.col("s.metadata.namespace").alias("namespace"), (F.col("s.start_line") + shift).alias("start_line"), (F.col("s.end_line") + shift).alias("end_line"),
    )


def below(artifacts: DataFrame, root: str) -> DataFrame:
    """Artifacts with their files' paths relative to the root: given below it, below /src/, or relative."""
    p, start = F.col("file_path"), root.rstrip("/") + "/"
    own = F.when(p.startswith(start), F.substr(p, F.lit(len(start) + 1))).otherwise(F.regexp_replace(p, "^/(src/)?", ""))
    return artifacts.withColumn("file_path", own)


def records(artifacts: DataFrame, project: str) -> DataFrame:
    """Artifacts as the chunkers' records, so that an index takes both in alike; a symbol without content has its name."""
    s = artifacts.select("file_path", F.size("symbols").alias("total_chunks"), F.posexplode("symbols").alias("chunk_index", "s"))
    symbols = s.select(
        "file_path", F.lit("symbol").alias("record"), short_name(F.col("s.name")).alias("name"), F.lower("s.node_type").alias("node_type"), F.coalesce("s.content", "s.name").alias("content"),
        F.col("s.metadata.namespace").alias("namespace"), F.col("s.name").alias("fqn"), "s.start_line", "s.end_line", "chunk_index", "total_chunks",
    )
    links = edges(artifacts, project).select("file_path", F.lit("edge").alias("record"), F.col("type").alias("node_type"), "source", "target")
    return symbols.unionByName(links, allowMissingColumns=True)


def edges(artifacts: DataFrame, project: str) -> DataFrame:
    """Graph edges: the artifacts', callees without parameter lists resolved to the methods that have them, and enums' members."""
    r = artifacts.select("file_path", F.explode("relationships").alias("r")).select("file_path", F.upper("r.type").alias("type"), "r.source", "r.target", "r.kind", "r.target_name", F.col("r.metadata.line").alias("line"), F.col("r.metadata.queue_name").alias("queue_name"))
    names = artifacts.select(F.explode("symbols").alias("s")).select(F.col("s.name").alias("full"), F.substring_index("s.name", "(", 1).alias("bare")).filter(F.col("full") != F.col("bare"))
    one = names.groupBy("bare").agg(F.min("full").alias("full"))
    calls = (F.col("type") == "CALLS") & (F.col("target") == F.col("bare"))
    r = r.join(one, calls, "left").withColumn("target", F.coalesce("full", "target")).drop("bare", "full")
    members = artifacts.select("file_path", F.explode("symbols").alias("s")).filter("lower(s.node_type) = 'enum_member'")
    members = members.select("file_path", F.lit("MEMBER_OF").alias("type"), F.col("s.name").alias("source"), F.regexp_extract("s.name", r"^(.*)\.[^.]*$", 1).alias("target"))
    return r.unionByName(members, allowMissingColumns=True).withColumn("project", F.lit(project)).filter("source <> target")
