"""Relations that the registered queries derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards: three rounds by source, a score from the id, tags and kinds from id and path."""
    docs = documents(spark, sf_dir)
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("code", "doc", "config", "sql"))), ((i % 7) % 4 + 1).cast("int"))
    path = F.concat(F.lit("apps/"), F.col("source"), F.lit("/src/main/"), F.col("lang"), F.lit("/"), i.cast("string"), F.lit(".txt"))
    return docs.select(
        i.cast("string").alias("id"), path.alias("path"), F.col("text").alias("chunk_text"),
        text.fingerprint("text", i.cast("string"), path).alias("fingerprint"),
        F.array_sort(F.array_distinct(F.concat(text.tags("text", F.lit("")), F.array(F.concat(F.lit("t"), (i % 11).cast("string")), F.concat(F.lit("s"), F.col("source")))))).alias("tags"),
        kind.alias("source_kind"), text.named_entities("text").alias("entities"),
        ((i * 7919) % 1000 / 1000.0).alias("score_rerank"), (F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3).alias("round_found"), i.alias("ord"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as symbols; a supplier of a key divisible by 10 is external."""
    own = lambda name, fqn, called, kind, path: read(spark, sf_dir, name).select(F.lit("shop").alias("project"), fqn.alias("fqn"), F.col(called).alias("name"), kind.alias("kind"), path.alias("file_path"))
    c = lambda x: F.col(x).cast("string")
    out = own("region", F.concat(F.lit("region."), c("r_regionkey")), "r_name", F.lit("class"), F.lit("geo/regions.cs"))
    out = out.union(own("nation", F.concat(F.lit("nation."), c("n_nationkey")), "n_name", F.lit("class"), F.concat(F.lit("geo/region"), c("n_regionkey"), F.lit(".cs"))))
    out = out.union(own("customer", F.concat(F.lit("customer."), c("c_custkey")), "c_name", F.lit("method"), F.concat(F.lit("customers/"), c("c_nationkey"), F.lit(".cs"))))
    kind = F.when(F.col("s_suppkey") % 10 == 0, "external").otherwise("interface")
    return out.union(own("supplier", F.concat(F.lit("supplier."), c("s_suppkey")), "s_name", kind, F.concat(F.lit("suppliers/"), (F.col("s_suppkey") % 9).cast("string"), F.lit(".cs"))))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships, a tree of suppliers, who calls whom, and customers' uses of suppliers' parts."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}."), c.cast("string"))
    edge = lambda df, kind, a, b: df.select(F.lit("shop").alias("project"), F.lit(kind).alias("type"), a.alias("source"), b.alias("target"))
    c = F.col
    nation, customer, supplier = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    out = edge(nation, "member_of", name("nation", c("n_nationkey")), name("region", c("n_regionkey")))
    out = out.union(edge(customer, "MEMBER_OF", name("customer", c("c_custkey")), name("nation", c("c_nationkey"))))
    s = c("s_suppkey")
    out = out.union(edge(supplier.filter(s > 1), "INHERITS", name("supplier", s), name("supplier", F.floor(s / 2))))
    out = out.union(edge(supplier, "IMPLEMENTS", name("supplier", s), name("nation", c("s_nationkey"))))
    for k in (2, 3):
        out = out.union(edge(supplier, "CALLS", name("supplier", s), name("supplier", s * k % 97 + 1)))
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    used = items.join(orders, c("l_orderkey") == c("o_orderkey")).select("o_custkey", "l_suppkey")
    return out.union(edge(used, "USES_TYPE", name("customer", c("o_custkey")), name("supplier", c("l_suppkey"))))


def code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as namespaces: symbols, references by names of several kinds out of customers' orders, and files' imports."""
    c, text_ = F.col, lambda x: F.replace(F.col(x), F.lit(" "), F.lit("_"))
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("n"), F.concat_ws(".", text_("r_name"), text_("n_name")).alias("ns"), text_("n_name").alias("short"))
    nation = F.broadcast(nation)  # 25 rows
    path = F.concat(F.replace("ns", F.lit("."), F.lit("/")), F.lit(".cs"))
    customer = read(spark, sf_dir, "customer").join(nation, c("c_nationkey") == c("n")).select("c_custkey", "n", "ns", "c_mktsegment", F.concat_ws(".", "ns", "c_mktsegment", "c_name").alias("fqn"), path.alias("file_path"))
    supplier = read(spark, sf_dir, "supplier").join(nation, c("s_nationkey") == c("n")).select(F.concat(c("ns"), F.lit(".suppliers."), c("s_name")).alias("fqn"), path.alias("file_path"))
    common = nation.select(F.concat("ns", F.lit(".suppliers.Common")).alias("fqn"), path.alias("file_path"))
    types = customer.select(F.concat_ws(".", "ns", "c_mktsegment").alias("fqn"), "file_path").distinct()
    symbols = customer.select("fqn", "file_path").union(supplier).union(common).union(types).select(F.lit("shop").alias("project"), "fqn", "file_path")
    after = lambda k: nation.select((c("n") - k + 25).alias("at"), c("ns").alias("next"), c("short").alias("next_short"))
    order = read(spark, sf_dir, "orders").join(customer, c("o_custkey") == c("c_custkey")).join(F.broadcast(after(1)), c("n") == c("at") % 25)
    k, seg = c("o_orderkey") % 7, c("c_mktsegment")
    suppliers = F.format_string("Supplier#%09d", c("o_orderkey") % 97 + 1)
    target = (
        F.when(k == 0, seg).when(k == 1, F.concat_ws(".", "next_short", seg)).when(k == 2, suppliers).when(k == 3, F.concat_ws(".", "next", seg))
        .when(k == 4, F.concat(F.lit("List<"), seg, F.lit(">[]"))).when(k == 5, F.concat(F.lit("System."), seg)).otherwise("Common")
    )
    references = order.select(F.lit("shop").alias("project"), F.lit("USES_TYPE").alias("type"), c("fqn").alias("source"), target.alias("target"), "file_path")
    spaces = nation.join(after(1), c("n") == c("at") % 25).filter(c("n") % 2 == 0).select(path.alias("file_path"), F.concat("next", F.lit(".suppliers")).alias("target"))
    named = nation.join(after(2), c("n") == c("at") % 25).filter(c("n") % 3 == 0).select(path.alias("file_path"), F.concat("next", F.lit(".suppliers.Common")).alias("target"))
    return symbols, references.distinct(), spaces.union(named).select(F.lit("shop").alias("project"), "file_path", "target")


def messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events' kinds, users and numbers as topics that users publish; customers' bindings of several kinds."""
    c = F.col
    events = read(spark, sf_dir, "events")
    topic = F.concat_ws(".", "event_type", (c("user_id") % 12).cast("string"), F.get_json_object("props", "$.k"))
    publishers = events.select(F.lit("shop").alias("project"), F.concat(F.lit("user."), (c("event_id") % 400).cast("string")).alias("publisher"), topic.alias("topic"))
    n, a = c("c_custkey") % 8, (c("c_custkey") % 12).cast("string")
    b = (c("c_custkey") % 50).cast("string")
    kind = F.when(c("c_custkey") % 3 == 0, "click").when(c("c_custkey") % 3 == 1, "purchase").otherwise("view")
    pattern = (
        F.when(n == 0, F.concat_ws(".", kind, a, b)).when(n == 1, F.concat(kind, F.lit(".#"))).when(n == 2, F.concat(F.lit("*."), a, F.lit(".*"))).when(n == 3, F.concat(F.lit("#."), b))
        .when(n == 4, F.concat(kind, F.lit(".#."), b)).when(n == 5, F.concat(F.lit("*.*."), b)).when(n == 6, F.concat(kind, F.lit(".*"))).otherwise(F.concat(F.lit("#."), a, F.lit(".#.*")))
    )
    return publishers, read(spark, sf_dir, "customer").select(F.lit("shop").alias("project"), c("c_name").alias("consumer"), pattern.alias("pattern"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source tree with a file for each customer, below folders of regions, nations and segments, some of which hold solutions or projects."""
    c, clean = F.col, lambda x: F.replace(F.col(x), F.lit(" "), F.lit("_"))
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("n"), clean("r_name").alias("r"), F.concat_ws("/", clean("r_name"), clean("n_name")).alias("at"))
    customer = read(spark, sf_dir, "customer").join(F.broadcast(nation), c("c_nationkey") == c("n"))  # 25 rows
    ext = F.when(c("c_custkey") % 3 == 0, ".java").when(c("c_custkey") % 3 == 1, ".cs").otherwise(".md")
    own = customer.select(F.concat(c("at"), F.lit("/"), c("c_mktsegment"), F.lit("/"), c("c_custkey").cast("string"), ext).alias("file_path"), F.md5(c("c_acctbal").cast("decimal(12,2)").cast("string")).alias("file_hash"))
    marks = [
        nation.select(F.concat("r", F.lit("/All.sln")).alias("file_path")).distinct(), nation.filter("n % 2 = 0").select(F.concat("at", F.lit("/One.sln"))), nation.filter("n % 3 = 0").select(F.concat("at", F.lit("/pom.xml"))),
        nation.filter("n % 6 = 0").select(F.concat("at", F.lit("/build.gradle"))), customer.filter("c_mktsegment = 'BUILDING'").select(F.concat("at", F.lit("/BUILDING/package.json"))).distinct(),
    ]
    for m in marks:
        own = own.union(m.toDF("file_path").withColumn("file_hash", F.md5("file_path")))
    return own
