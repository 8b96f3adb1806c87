"""Names in relations resolved to the symbols that they mean, across files.

A splitter sees one file: its relations name targets as the source does, often by a short name. A
name means, in this order: the symbol that is called exactly so; the one in the nearest enclosing
scope of the source, from its own members outwards to the root namespace; one that the file
imports by name, then one in a namespace that the file imports; and the only symbol of the project
whose full name ends with the name. Of several imports the first by name counts, and a name that
several symbols end with stays as it is and is said to be ambiguous.

Scopes, imports and suffixes become candidates with a rank, and candidates meet symbols by
equality, so that no name is compared with every symbol. A reference is worked out once for each
distinct (project, file, scope, name), and what depends on the name alone once for each name.
Edges with their names, references and symbols are stored, as each is read by many of the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.operators.joins import HOT_ROWS, skew_join

# Types that every program has, and namespaces that are never part of one.
PRIMITIVES = (
    "int", "long", "short", "byte", "float", "double", "decimal", "bool", "char", "string", "object", "void", "var", "dynamic",
    "Int32", "Int64", "Int16", "Byte", "Single", "Double", "Decimal", "Boolean", "Char", "String", "Object", "Void",
    "boolean", "Integer", "Long", "Short", "Float", "Character", "Number",
    "List", "Dictionary", "IEnumerable", "IList", "ICollection", "Task", "Action", "Func", "Nullable", "Map", "Set", "Collection", "Optional", "CompletableFuture",
)
EXTERNAL_NAMESPACES = (
    "System", "Microsoft", "Newtonsoft", "NLog", "AutoMapper", "Flurl", "EasyNetQ", "StackExchange",
    "java.", "javax.", "jakarta.", "sun.", "com.sun.", "org.springframework.", "org.slf4j.", "org.apache.", "com.fasterxml.", "io.", "lombok.", "reactor.", "kotlin.",
)
HOW = ("exact", "scope", "import", "namespace", "suffix", "ambiguous", "external", "unknown")


def bare(name: Column | str) -> Column:
    """A full name without a parameter list."""
    return F.substring_index(name, "(", 1)


def type_name(name: Column | str) -> Column:
    """A type as it is named, without nullable marks, type arguments and array brackets."""
    plain = F.regexp_replace(bare(name), r"[?\s]+$", "")
    return F.trim(F.regexp_replace(F.substring_index(plain, "<", 1), r"[\[\]?]+$", ""))


def is_external(name: Column) -> Column:
    """Whether a name is a type that every program has, or lies in a library's namespace."""
    own = "|".join(x.replace(".", r"\.") + ("" if x.endswith(".") else r"(?:\.|\z)") for x in EXTERNAL_NAMESPACES)
    return name.isin(*PRIMITIVES, "") | name.rlike(f"^(?:{own})")  # a filter works out the name again wherever it stands


def prefixes(name: Column) -> Column:
    """A dotted name and all that encloses it, the name itself first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def suffixes(name: Column) -> Column:
    """The ends of a dotted name that begin at a part, but for the name itself."""
    parts = F.split(name, r"\.")
    all_but_first = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    return F.when(F.size(parts) > 1, all_but_first).otherwise(F.array().cast("array<string>"))


def named(symbols: DataFrame) -> DataFrame:
    """(project, full, fqn): each symbol by its name without parameters; of overloads the first by name."""
    return symbols.filter("fqn IS NOT NULL").groupBy("project", bare("fqn").alias("full")).agg(F.min("fqn").alias("fqn"))


def by_name_alone(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, name, fqn, how) of distinct names that are a symbol's own, or the end of one's or of several."""
    exact = names.join(symbols.withColumnRenamed("full", "name"), ["project", "name"]).select("project", "name", "fqn", F.lit(0).alias("place"), F.lit(1).alias("n"))
    ends = symbols.select("project", "fqn", F.explode(suffixes(F.col("full"))).alias("name"))
    ended = ends.groupBy("project", "name").agg(F.min("fqn").alias("fqn"), F.lit(1).alias("place"), F.count("*").alias("n")).join(names, ["project", "name"], "left_semi")
    one = exact.unionByName(ended).groupBy("project", "name").agg(F.min_by(F.struct("fqn", "place", "n"), "place").alias("x"))
    how = F.when(F.col("x.place") == 0, "exact").when(F.col("x.n") == 1, "suffix").otherwise("ambiguous")
    return one.select("project", "name", F.when(how != "ambiguous", F.col("x.fqn")).alias("fqn"), how.alias("how"))


def by_scope(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, scope, name, fqn): the symbol in the nearest scope around a source."""
    own = references.select("project", "scope", "name").distinct()
    each = own.select("project", "scope", "name", F.posexplode(prefixes(F.col("scope"))).alias("away", "around"))
    met = each.withColumn("full", F.concat_ws(".", "around", "name")).join(symbols, ["project", "full"])
    return met.groupBy("project", "scope", "name").agg(F.min_by("fqn", "away").alias("fqn"))


def by_import(references: DataFrame, imports: DataFrame, symbols: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(project, file_path, name, fqn, how): a symbol that the file imports by its name, else one in an imported namespace.

    A name's first part decides whether an import names it, so these meet by equality; namespaces
    meet symbols, and the symbols' own files' names.
    """
    own = references.select("project", "file_path", "name").distinct()
    files = imports.select("project", "file_path", bare("target").alias("imported")).distinct()
    first = F.substring_index("name", ".", 1)
    rest = F.substr("name", F.length(first) + 1)
    typed = own.withColumn("first", first).join(files.withColumn("first", F.substring_index("imported", ".", -1)), ["project", "file_path", "first"])
    typed = typed.select("project", "file_path", "name", F.concat("imported", rest).alias("full"), F.lit(0).alias("place"))
    # what a namespace could give: names that some symbol has right below one, so that no name meets every import of its file
    ends = symbols.select("project", "full", F.explode(suffixes(F.col("full"))).alias("name"))
    ends = ends.withColumn("imported", F.expr("substr(full, 1, length(full) - length(name) - 1)"))
    asked = skew_join(ends, own.select("project", "name").distinct(), ["project", "name"], "left_semi", hot_rows)
    open_to = files.join(asked, ["project", "imported"]).select("project", "file_path", "name", "full")
    spaced = own.join(open_to, ["project", "file_path", "name"]).select("project", "file_path", "name", "full", F.lit(1).alias("place"))
    met = typed.unionByName(spaced).join(symbols, ["project", "full"])
    one = met.groupBy("project", "file_path", "name").agg(F.min(F.struct("place", "fqn")).alias("x"))
    return one.select("project", "file_path", "name", "x.fqn", F.when(F.col("x.place") == 0, "import").otherwise("namespace").alias("how"))


def resolve(edges: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The edges (project, type, source, target, file_path, ...) with target as the full name that it means, and how that was found.

    Targets that aren't found, are ambiguous or external stay as they are. imports are
    (project, file_path, target); a null target, source or file resolves nothing by them.
    """
    from kelpie.sources.store import stored

    rest = [c for c in edges.columns if c not in ("how",)]
    named_edges = edges.select(*rest).withColumns({"name": type_name("target"), "scope": bare("source")})
    if not any(x in f.dataType.simpleString() for f in named_edges.schema.fields for x in ("void", "interval")):  # Parquet has no such columns
        named_edges = stored(named_edges, "named-edges")
    references = stored(named_edges.filter(~is_external(F.col("name"))).select("project", "file_path", "scope", "name").distinct(), "references")
    own = stored(named(symbols), "named-symbols")
    # a target with parameters may be one of several overloads, and then is itself
    whole = symbols.filter("fqn LIKE '%(%'").select("project", F.col("fqn").alias("target")).distinct().withColumn("whole", F.lit(True))
    whole = whole.join(named_edges.select("project", "target").distinct(), ["project", "target"], "left_semi")
    alone = by_name_alone(references.select("project", "name").distinct(), own).select("project", "name", F.col("fqn").alias("alone"), F.col("how").alias("alone_how"))
    scoped = by_scope(references, own).withColumnRenamed("fqn", "scoped")
    out = skew_join(references, alone, ["project", "name"], "left", hot_rows)
    out = out.join(scoped, ["project", "scope", "name"], "left")
    if imports is not None:
        found = by_import(references, imports, own, hot_rows).select("project", "file_path", "name", F.col("fqn").alias("imported"), F.col("how").alias("import_how"))
        out = out.join(found, ["project", "file_path", "name"], "left")
    else:
        out = out.withColumns({"imported": F.lit(None).cast("string"), "import_how": F.lit(None).cast("string")})
    exact = F.col("alone_how") == "exact"
    fqn = F.when(exact, F.col("alone")).otherwise(F.coalesce("scoped", "imported", "alone"))
    how = F.when(exact, F.lit("exact")).when(F.col("scoped").isNotNull(), "scope").otherwise(F.coalesce("import_how", "alone_how", F.lit("unknown")))
    answers = out.select("project", "file_path", "scope", "name", fqn.alias("fqn"), how.alias("how"))
    keys = ["project", "file_path", "scope", "name"]
    with_whole = skew_join(named_edges, whole, ["project", "target"], "left", hot_rows)
    a, b = with_whole.alias("a"), answers.alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    external = is_external(F.col("a.name"))
    target = F.when(F.col("a.whole"), F.col("a.target")).otherwise(F.coalesce("b.fqn", "a.target"))
    said = F.when(F.col("a.whole"), "exact").when(external, "external").otherwise(F.coalesce("b.how", F.lit("unknown")))
    return met.select(*(target.alias(c) if c == "target" else F.col(f"a.{c}") for c in rest), said.alias("how"))
