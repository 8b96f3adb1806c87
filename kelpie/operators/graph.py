"""The symbol graph as two tables: nodes (project, fqn, name, kind, file_path) and edges (project, type, source, target).

Writes are upserts, reads are joins over edges. Traversals go hop by hop from a frontier of
distinct nodes; a path uses no edge twice, which only matters for coming back to the start.
Which of several equally named symbols starts, and which neighbours a limit keeps, goes by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The relations that are stored, those that help a search, and names that say nothing.
EDGE_TYPES = (
    "MEMBER_OF", "INHERITS", "IMPLEMENTS", "IMPORTS", "CALLS", "USES_TYPE", "DEFINED_IN", "CREATES", "OVERRIDES", "REFERENCES", "SUBSECTION_OF", "PUBLISHES_TO", "SUBSCRIBES_TO",
    "ANNOTATED_BY",
)
USEFUL_TYPES = ("INHERITS", "IMPLEMENTS", "MEMBER_OF", "USES_TYPE", "CALLS", "CREATES")
NOISE_PREFIXES = ("System", "Microsoft", "Newtonsoft", "AutoMapper", "Flurl", "NLog", "Casbin", "Serilog", "Swashbuckle", "Hangfire")
#: Symbols that a join may broadcast.
BROADCAST_ROWS = 100_000
NODE_LABELS = {"class": "Class", "interface": "Interface", "enum": "Enum", "struct": "Struct", "method": "Method", "constructor": "Constructor", "property": "Property", "record": "Record"}


def latest(rows: DataFrame, keys: Sequence[str], order: str = "version") -> DataFrame:
    """Of each key the last version, property by property: a null doesn't overwrite."""
    by = W.partitionBy(*keys).orderBy(F.desc(order))
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = [c for c in rows.columns if c not in keys and c != order]
    filled = rows.select(*keys, order, *(F.first(c, ignorenulls=True).over(whole).alias(c) for c in rest), F.row_number().over(by).alias("_n"))
    return filled.filter("_n = 1").drop("_n")


def upsert_symbols(nodes: DataFrame, new: DataFrame) -> DataFrame:
    both = nodes.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["project", "fqn"]).drop("version")


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files (project, path, ...) with the new ones' properties; a missing hash doesn't overwrite one."""
    both = files.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["project", "path"]).drop("version")


def clean_edges(edges: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Upper-case known types, one edge a (project, type, source, target) and what else tells edges apart."""
    typed = edges.withColumn("type", F.upper("type")).filter(F.col("type").isin(*EDGE_TYPES))
    return typed.filter("source IS NOT NULL AND target IS NOT NULL").dropDuplicates(["project", "type", "source", "target", *also])


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and placeholders for edges' ends that no node has: targets are external, sources have no kind."""
    name = F.coalesce("target_name", "target") if "target_name" in edges.columns else F.col("target")
    ends = edges.select("project", F.col("target").alias("fqn"), name.alias("name"), F.lit("external").alias("kind"), F.lit(0).alias("_o"))
    ends = ends.unionByName(edges.filter("type <> 'IMPORTS'").select("project", F.col("source").alias("fqn"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(1).alias("_o")))
    one = ends.groupBy("project", "fqn").agg(F.min_by("name", "_o").alias("name"), F.min_by("kind", "_o").alias("kind"))
    return nodes.unionByName(one.join(nodes, ["project", "fqn"], "left_anti"), allowMissingColumns=True)


def delete_file(nodes: DataFrame, edges: DataFrame, project: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Without a file's symbols and all edges that touch them."""
    gone = nodes.filter((F.col("project") == project) & (F.col("file_path") == path)).select("project", "fqn")
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("fqn", end), ["project", end], "left_anti")
    return nodes.join(gone, ["project", "fqn"], "left_anti"), edges


def uniqueness_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def defined_in(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """DEFINED_IN edges from symbols to the files of their paths."""
    own = files.select("project", F.col("path").alias("file_path"))
    return symbols.join(own, ["project", "file_path"], "left_semi").select("project", F.lit("DEFINED_IN").alias("type"), F.col("fqn").alias("source"), F.col("file_path").alias("target"))


def seed(nodes: DataFrame, name: str, project: str | None = None) -> DataFrame:
    """The first symbol, by fqn, that is called so: by its full name, its short name or its name's end."""
    n = F.col("fqn")
    found = nodes.filter((n == name) | (F.col("name") == name) | n.endswith(f".{name}"))
    if project is not None:
        found = found.filter(F.col("project") == project)
    return found.orderBy(F.when(n == name, 0).otherwise(1), "fqn", "project").limit(1)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(project, type, from, to, edge) along, against or in both directions; edge names the stored edge."""
    edge = F.concat_ws("|", "type", "source", "target").alias("edge")
    out = edges.select("project", "type", F.col("source").alias("from"), F.col("target").alias("to"), edge)
    back = edges.select("project", "type", F.col("target").alias("from"), F.col("source").alias("to"), edge)
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbors(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 1, direction: str = "both", types: Sequence[str] | None = None, limit: int | None = 50) -> DataFrame:
    """(project, fqn, name, kind, hops): symbols within one to three hops that aren't external, by hops and name.

    Paths reach as far as they do without the limit; only the report is cut. Edges, starts and each
    hop's frontier are written to the shared folder, so that no hop is done again for the next.
    """
    from kelpie.sources.store import stored

    depth = min(3, max(1, depth))
    if types:
        edges = edges.filter(F.col("type").isin(*(t.upper() for t in types)))
    start = stored(start.select("project", "fqn"), "start")
    steps = directed(stored(edges.select("project", "type", "source", "target"), "steps"), direction)
    front = start.select("project", F.col("fqn").alias("from"))
    seen, reached = front.withColumn("hops", F.lit(0)), []
    for hop in range(1, depth + 1):  # a node counts where it is first reached, so hubs don't multiply paths
        front = front.join(steps, ["project", "from"]).select("project", F.col("to").alias("from")).distinct().join(seen, ["project", "from"], "left_anti")
        front = stored(front, "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("hops", F.lit(hop)))
        reached.append(front.select("project", F.col("from").alias("fqn"), F.lit(hop).alias("hops")))
    reached.append(returns(start, steps, depth))
    found = reduce(DataFrame.unionByName, reached)
    inner = nodes.filter("kind <> 'external'").select("project", "fqn", "name", "kind")
    out = found.join(inner, ["project", "fqn"]).select("project", "fqn", "name", "kind", "hops").orderBy("hops", "fqn", "project")
    return out.limit(limit) if limit else out


def returns(start: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """(project, fqn, hops) of starts that a path of up to three hops leads back to without using an edge twice."""
    one = steps.join(start.select("project", F.col("fqn").alias("from")), ["project", "from"])
    loops = one.filter(F.col("to") == F.col("from")).select("project", F.col("from").alias("fqn"), F.lit(1).alias("hops"))
    away = one.filter(F.col("to") != F.col("from")).select("project", F.col("from").alias("fqn"), F.col("to").alias("x"), F.col("edge").alias("e1"))
    back = steps.join(start.select("project", F.col("fqn").alias("to")), ["project", "to"]).filter(F.col("to") != F.col("from")).select("project", F.col("to").alias("fqn"), F.col("from").alias("y"), F.col("edge").alias("e3"))
    two = away.join(back.withColumnRenamed("y", "x"), ["project", "fqn", "x"]).filter("e1 <> e3").select("project", "fqn", F.lit(2).alias("hops"))
    middle = steps.select("project", F.col("from").alias("x"), F.col("to").alias("y"), F.col("edge").alias("e2"))
    # of a neighbour's edges only those to another neighbour can lead back, so that a hub's neighbours' other edges meet nothing
    middle = middle.join(away.select("project", "x").distinct(), ["project", "x"], "left_semi").join(back.select("project", "y").distinct(), ["project", "y"], "left_semi")
    three = away.join(middle, ["project", "x"]).join(back, ["project", "fqn", "y"]).filter("e1 <> e2 AND e2 <> e3 AND e1 <> e3").select("project", "fqn", F.lit(3).alias("hops"))
    return reduce(DataFrame.unionByName, [loops, two, three][:depth]).groupBy("project", "fqn").agg(F.min("hops").alias("hops"))


def reachable(spark: SparkSession, edges: DataFrame, start: Sequence[str], max_depth: int) -> DataFrame:
    """(fqn, hops): the fewest hops along the edges (source, target) to each node within the depth.

    Each round's frontier meets what earlier rounds reached in an anti-join, and is written to
    the shared folder, so that neither paths nor lineage grow.
    """
    from kelpie.sources.store import stored

    seen = spark.createDataFrame([(s, 0) for s in start], "fqn string, hops int")
    front = seen
    for hop in range(1, max_depth + 1):
        step = front.select(F.col("fqn").alias("source")).join(edges.select("source", "target"), "source").select(F.col("target").alias("fqn")).distinct()
        front = stored(step.join(seen, "fqn", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def call_chain(spark: SparkSession, edges: DataFrame, source: str, target: str, max_depth: int = 5) -> list[str]:
    """A shortest chain of CALLS, by name where several are; empty if none is within the depth (10 at most)."""
    calls = edges.filter(F.col("type") == "CALLS")
    hops = reachable(spark, calls, [source], min(max_depth, 10))
    last = hops.filter(F.col("fqn") == target).orderBy("hops").first()
    if last is None:
        return []
    chain = [target]
    for h in range(last["hops"] - 1, -1, -1):  # at most ten steps back
        prior = calls.filter(F.col("target") == chain[-1]).join(hops.filter(F.col("hops") == h), F.col("source") == F.col("fqn"))
        chain.append(prior.agg(F.min("source")).first()[0])
    return chain[::-1]


def hierarchy(spark: SparkSession, edges: DataFrame, fqn: str, depth: int = 5) -> DataFrame:
    """(role, fqn, hops): parents and children by INHERITS, interfaces by IMPLEMENTS, up to the depth."""
    out = []
    for role, kind, direction in (("parent", "INHERITS", "out"), ("interface", "IMPLEMENTS", "out"), ("child", "INHERITS", "in")):
        steps = directed(edges.filter(F.col("type") == kind), direction).select(F.col("from").alias("source"), F.col("to").alias("target"))
        out.append(reachable(spark, steps, [fqn], depth).filter("hops > 0").withColumn("role", F.lit(role)))
    return reduce(DataFrame.unionByName, out).select("role", "fqn", "hops")


def file_dependencies(nodes: DataFrame, edges: DataFrame, path: str, limit: int | None = 30) -> DataFrame:
    """(file_path, n, links): files whose symbols are one edge away from this file's, those with most distinct links first."""
    own = nodes.filter(F.col("file_path") == path).select("project", F.col("fqn").alias("from"))
    other = nodes.filter((F.col("file_path") != path) & F.col("file_path").isNotNull()).select("project", F.col("fqn").alias("to"), "file_path")
    met = directed(edges, "both").join(own, ["project", "from"]).join(other, ["project", "to"])
    pairs = met.select("file_path", F.concat_ws(":", "type", "to").alias("link")).distinct()
    out = pairs.groupBy("file_path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("link")), ",").alias("links")).orderBy(F.desc("n"), "file_path")
    return out.limit(limit) if limit else out


def stats(nodes: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by label, edges by type, symbols by project."""
    part = lambda df, what, by: df.groupBy(by).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.col(by).alias("name"), "n")
    labels = nodes.withColumn("label", F.lit("Symbol")).select("label").unionByName(files.withColumn("label", F.lit("File")).select("label"))
    return part(labels, "node", "label").unionByName(part(edges, "edge", "type")).unionByName(part(nodes.filter("project IS NOT NULL"), "project", "project"))


def projects(nodes: DataFrame) -> DataFrame:
    return nodes.select("project").filter("project IS NOT NULL").distinct().orderBy("project")


def query(spark: SparkSession, sql: str, nodes: DataFrame, edges: DataFrame, files: DataFrame, args: dict | None = None) -> DataFrame:
    """SQL over the views symbols, edges and files."""
    for name, df in (("symbols", nodes), ("edges", edges), ("files", files)):
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


def is_noise(name: Column) -> Column:
    return name.isNull() | (F.length(name) < 4) | F.substring_index(name, ".", 1).isin(*NOISE_PREFIXES)


def card_symbols(cards: DataFrame, limit: int = 8) -> DataFrame:
    """(symbol, pos): the first symbols that cards (ord, symbol, entities) name, own symbols before entities."""
    names = F.concat(F.array("symbol"), F.coalesce("entities.config_keys", F.array()), F.coalesce("entities.enums", F.array()), F.coalesce("entities.constants", F.array()))
    each = cards.select("ord", F.posexplode(names).alias("place", "symbol")).filter(~is_noise(F.col("symbol")))
    first = each.groupBy("symbol").agg(F.min(F.struct("ord", "place")).alias("pos"))
    return first.orderBy("pos", "symbol").limit(limit)


def expand(symbols: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, seen_paths: DataFrame, top_k: int = 5, per_file: int = 2) -> DataFrame:
    """Chunks of the files that most symbols lead to in one hop: (path, chunk_index, hits), per_file of each, top_k in all."""
    own = symbols.select("symbol").distinct()
    called = [nodes.join(own, F.col(c) == F.col("symbol"), "left_semi").select("project", F.col("fqn").alias("from")) for c in ("name", "fqn")]
    from kelpie.sources.store import stored

    start = stored(called[0].unionByName(called[1]).distinct(), "start")  # a common name may have any number of symbols
    few = F.broadcast(start) if start.count() <= BROADCAST_ROWS else start
    steps = directed(edges.filter(F.col("type").isin(*USEFUL_TYPES)), "both")
    ends = steps.join(few, ["project", "from"]).select("project", F.col("to").alias("fqn"), "edge")
    inner = nodes.filter("kind <> 'external' AND file_path IS NOT NULL").select("project", "fqn", F.col("file_path").alias("path"))
    files = ends.join(inner, ["project", "fqn"]).join(seen_paths.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.count("*").alias("hits"))
    files = files.orderBy(F.desc("hits"), "path").limit(top_k)
    order = W.partitionBy("path").orderBy("chunk_index")
    own = chunks.join(F.broadcast(files), "path").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_file)
    return own.orderBy(F.desc("hits"), "path", "chunk_index").limit(top_k).drop("_n")
