import random
import re
from collections import Counter

import pytest

from kelpie.operators import joins, messaging, resolve


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, how):
    left = [("hot", k) for k in range(500)] + [(f"k{k % 7}", k) for k in range(60)] + [(None, 1), ("hot", 3)]
    right = [("hot", "a"), ("hot", "b"), ("k1", "c"), ("k9", "d"), (None, "e")]
    a, b = spark.createDataFrame(left, "k string, v int"), spark.createDataFrame(right, "k string, w string")
    want = Counter(map(tuple, a.join(b, ["k"], how).collect()))
    got = joins.skew_join(a, b, ["k"], how, hot_rows=20)
    assert Counter(map(tuple, got.select(*a.join(b, ["k"], how).columns).collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_hot_key_is_dealt_over_tasks(spark):
    a = spark.createDataFrame([("hot", k) for k in range(1000)], "k string, v int")
    b = spark.createDataFrame([("hot", "a")], "k string, w string")
    salted = joins.skew_join(a, b, ["k"], "inner", hot_rows=50)
    assert salted.count() == 1000
    from pyspark.sql import functions as F

    counts = a.groupBy("k").count().filter("count > 50")
    salts = a.join(counts, "k").withColumn("s", F.pmod(F.xxhash64("k", "v"), F.lit(20))).groupBy("s").count().collect()
    assert len(salts) == 20 and max(r["count"] for r in salts) < 150


def symbols_of(rng):
    ns = ["a", "a.b", "a.b.c", "x", "x.b"]
    out = {f"{rng.choice(ns)}.{t}" for t in ("Order", "Item", "Cart", "Store") for _ in range(2)}
    out |= {f"{t}.{m}" for t in list(out) for m in ("run()", "size", "run(int)")[: rng.randrange(4)]}
    return sorted(out)


def plain_resolve(project, source, target, path, symbols, imports):
    if "(" in target and (project, target) in symbols:
        return target, "exact"
    name = re.sub(r"[\[\]?]+$", "", re.sub(r"[?\s]+$", "", target.split("(")[0]).split("<")[0]).strip()
    if name == "" or name in resolve.PRIMITIVES or any(name.startswith(x) if x.endswith(".") else name == x or name.startswith(x + ".") for x in resolve.EXTERNAL_NAMESPACES):
        return target, "external"
    own = {}
    for p, s in symbols:
        if p == project:
            own[s.split("(")[0]] = min(own.get(s.split("(")[0], s), s)
    if name in own:
        return own[name], "exact"
    parts = source.split("(")[0].split(".")
    for k in range(len(parts), 0, -1):
        full = ".".join([*parts[:k], name])
        if full in own:
            return own[full], "scope"
    mine = [t.split("(")[0] for p, f, t in imports if p == project and f == path]
    head, _, rest = name.partition(".")
    typed = sorted(own[f] for t in mine if t.split(".")[-1] == head and (f := t + ("." + rest if rest else "")) in own)
    if typed:
        return typed[0], "import"
    spaced = sorted(own[f"{t}.{name}"] for t in mine if f"{t}.{name}" in own)
    if spaced:
        return spaced[0], "namespace"
    ends = sorted(v for k, v in own.items() if k.endswith("." + name))
    return (ends[0], "suffix") if len(ends) == 1 else (target, "ambiguous") if ends else (target, "unknown")


@pytest.mark.parametrize("seed", range(4))
def test_names_mean_what_plain_lookup_says(spark, seed):
    rng = random.Random(seed)
    symbols = [("p", s) for s in symbols_of(rng)] + [("q", s) for s in symbols_of(rng)]
    names = ["Order", "Item", "Cart?", "Store[]", "List<Order>", "b.Order", "c.Cart.run", "Order.run()", "run", "size", "System.Order", "java.util.Order", "Nowhere", "a.b.Item", "x.Store.size", "", *[s for _, s in symbols if "(" in s][:3]]
    rows = [(rng.choice("pq"), "USES_TYPE", f"{rng.choice([s for _, s in symbols])}", rng.choice(names), rng.choice(["f1", "f2", "f3"])) for _ in range(200)]
    imports = [(rng.choice("pq"), rng.choice(["f1", "f2"]), rng.choice(["a.b", "x", "x.b", "a.b.Item", "a.Order", "x.Cart", "nothing.here"])) for _ in range(8)]
    edges = spark.createDataFrame(rows, "project string, type string, source string, target string, file_path string")
    got = resolve.resolve(edges.selectExpr("*", "target AS asked"), spark.createDataFrame(symbols, "project string, fqn string"), spark.createDataFrame(imports, "project string, file_path string, target string"), hot_rows=30)
    want = Counter((*r, *plain_resolve(r[0], r[2], r[3], r[4], symbols, imports)) for r in rows)
    assert Counter((r["project"], r["type"], r["source"], r["asked"], r["file_path"], r["target"], r["how"]) for r in got.collect()) == want
    assert len({k[-1] for k in want}) >= 5


def test_resolve_keeps_rows_with_nulls(spark):
    edges = spark.createDataFrame([("p", "CALLS", None, "run", None), ("p", "CALLS", "a.B", None, "f"), (None, "CALLS", "a.B", "C", "f"), ("p", "CALLS", "a.B", "C", "f"), ("p", "CALLS", "a.B", "C", "f")], "project string, type string, source string, target string, file_path string")
    symbols = spark.createDataFrame([("p", "a.C"), ("p", None), ("p", "z.run")], "project string, fqn string")
    rows = sorted(map(str, ((r["source"], r["target"], r["how"]) for r in resolve.resolve(edges, symbols).collect())))
    assert rows == sorted(map(str, [(None, "z.run", "suffix"), ("a.B", None, "unknown"), ("a.B", "C", "unknown"), ("a.B", "a.C", "scope"), ("a.B", "a.C", "scope")]))
    assert resolve.resolve(edges.limit(0), symbols).count() == 0


def test_names_are_worked_out_once(spark):
    edges = spark.createDataFrame([("p", "CALLS", "a.b", "List<c>", "f")], "project string, type string, source string, target string, file_path string")
    symbols = spark.createDataFrame([("p", "a.c")], "project string, fqn string")
    imports = spark.createDataFrame([], "project string, file_path string, target string")
    plan = resolve.resolve(edges.withColumn("target", joins.F.replace("target", joins.F.lit("c"), joins.F.lit("d"))), symbols, imports)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # what the joins read is stored


def plain_match(topic, pattern):
    def go(t, p):
        if not p:
            return not t
        if p[0] == "#":
            return go(t, p[1:]) or bool(t) and go(t[1:], p)
        return bool(t) and p[0] in ("*", t[0]) and go(t[1:], p[1:])

    return go(topic.split(".") if topic else [], pattern.split(".") if pattern else [])


def test_patterns_match_as_word_by_word(spark):
    rng = random.Random(3)
    word = lambda ws: ".".join(rng.choices(ws, k=rng.randrange(6)))
    topics = sorted({word(["a", "b", "c", "*x", "a+b", r"q\E"]) for _ in range(120)} | {"", "a..b", ".", "a"})
    patterns = sorted({word(["a", "b", "*", "#", "#", r"q\E", "a+b"]) for _ in range(250)} | {"", "#", "#.#", "*", "*.*", "#.*", "a.#.#.b", "*.#", "a..b"})
    got = messaging.matches(spark.createDataFrame([(t,) for t in topics] * 2 + [(None,)], "topic string"), spark.createDataFrame([(p,) for p in patterns] * 2 + [(None,)], "pattern string"))
    assert Counter(map(tuple, got.collect())) == Counter((t, p) for t in topics for p in patterns if plain_match(t, p))


def test_deliveries_from_a_graph(spark):
    rows = [("p", "PUBLISHES_TO", f"m{k}", "RabbitMQ.Topic.hot.topic") for k in range(300)] + [("p", "PUBLISHES_TO", "m1", "acme.Order"), ("p", "SUBSCRIBES_TO", "c1", "RabbitMQ.Topic.hot.*"), ("p", "SUBSCRIBES_TO", "c2", "RabbitMQ.Topic.hot.*"), ("p", "SUBSCRIBES_TO", "c3", "acme.Order"), ("p", "SUBSCRIBES_TO", "c4", "RabbitMQ.Topic.cold"), ("q", "SUBSCRIBES_TO", "c5", "RabbitMQ.Topic.#")]
    publishers, consumers = messaging.from_edges(spark.createDataFrame(rows, "project string, type string, source string, target string"))
    got = Counter((r["project"], r["source"], r["target"], r["topic"]) for r in messaging.deliveries(publishers, consumers, hot_rows=25).collect())
    assert got == Counter([("p", f"m{k}", "RabbitMQ.Topic.hot.*", "hot.topic") for k in range(300)] + [("p", "m1", "RabbitMQ.Topic.acme.Order", "acme.Order")])
    assert sorted((r["topic"], r["pattern"], r["publishers"], r["consumers"]) for r in messaging.routes(publishers, consumers).filter("project = 'p'").collect()) == [("acme.Order", "acme.Order", 1, 1), ("hot.topic", "hot.*", 300, 2)]
