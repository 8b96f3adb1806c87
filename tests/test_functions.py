import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from kelpie.functions import batches, embed, paths, sparse, text
from kelpie.functions.embed import hashing_embedder


def apply(spark, f, rows, schema="a string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(f).collect()]


def test_fingerprint_ignores_line_numbers_dates_and_the_middle(spark):
    a = "1: first line\n2 | second  line\n"
    b = "first line\nsecond line 2024-01-02T03:04:05.678"
    long = ["x" * 100 + m + "y" * 100 for m in ("abc", "defg")]
    got = apply(spark, text.fingerprint("a", "b", "c"), [(a, "i", "p"), (b, "i", "p"), (long[0], "i", "p"), (long[1], "i", "p"), ("", "i", "p"), (None, "i", "p"), ("12 - ", "i", "p")], "a string, b string, c string")
    assert got[0] == hashlib.md5(b"first line second line").hexdigest()[:16]
    assert got[0] == got[1] and got[2] == got[3]
    assert got[4] == got[5] == hashlib.md5(b"i:p").hexdigest()[:16]
    assert got[6] == hashlib.md5(b"12 -").hexdigest()[:16]


def test_entities(spark):
    code = 'order.timeout.ms = 5; @Value("${a.b}") enum OrderStatus { X } OrderState.Done MAX_RETRY SELECT foo Configuration[Db] appsettings["Key"] GetValue<int>("x.y") MAX_RETRY'
    config, enums, constants = apply(spark, text.named_entities("a"), [code])[0]
    assert config == sorted({"order.timeout.ms", "a.b", "Db", "Key", "x.y"})
    assert enums == ["OrderState", "OrderStatus"]
    assert constants == ["MAX_RETRY"]
    assert apply(spark, text.named_entities("a"), [None])[0] == ([], [], [])


def test_tags_kinds_snippets(spark):
    got = apply(spark, text.tags("a", "b"), [("Await foo.bar(x)", "src/Robot/job.cs"), ("", "x.sql"), (None, None)], "a string, b string")
    assert got == [["async", "callsite", "job", "robot"], ["database"], []]
    kinds = apply(spark, text.source_kind("a"), ["a.SQL", "a.md", "a.yml", "my/config/x.cs", "jira/1", "docs/x.cs", "x.cs", "", None])
    assert kinds == ["sql", "doc", "config", "config", "jira", "doc", "code", "code", "code"]
    assert apply(spark, text.snippet("a"), [" a \n b ", "x" * 201, None]) == ["a b", "x" * 197 + "...", ""]
    assert apply(spark, text.has_causal_verb("a"), ["asset", "nothing", None]) == [True, False, False]
    assert apply(spark, text.covers("a", "call edge"), ["x.y()", "none"]) == [True, False]
    assert apply(spark, text.covers("a", "a+b"), ["A+B", "aab"]) == [True, False]


def test_keyword_variants():
    v = text.keyword_variants("order_status-code")
    assert (v["pascal"], v["snake"], v["camel"]) == ("OrderStatusCode", "order_status_code", "order_status-code")
    assert text.keyword_variants("")["pascal"] == ""


@pytest.mark.parametrize(
    ("path", "want"),
    [("modules/a/x", "modules/a"), ("x/src/main/y", "x/src"), ("src/main/y", "src/main/y"), ("apps/z/q", "apps/z"), ("a/Acme.Core/F.cs", "Acme.Core"), ("", "unknown"), ("a/b/c/d", "a/b/c"), ("modules", "modules"), ("F.cs", "F.cs")],
)
def test_module_key(spark, path, want):
    assert apply(spark, paths.module_key("a"), [path]) == [want]


def test_excluded(spark):
    rows = {"a.cs": False, "bin/a.cs": True, "x/node_modules/y.js": True, "a.Designer.cs": True, "main.87f9f66e.css": True, "A.PY": False, "Dockerfile": False, "noext": True, ".gitignore": False, "a.min.js": True, "x/deadbeef.js": True, "package-lock.json": True}
    assert apply(spark, paths.is_excluded("a"), list(rows)) == list(rows.values())
    assert apply(spark, F.struct(paths.category("a"), paths.language("a")), ["a.cs", "b.sql", "c.unknown"]) == [("source-code", "csharp"), ("database", None), ("other", None)]


def test_environment_widens_the_whitelist(spark, monkeypatch):
    monkeypatch.setenv("INDEX_EXTRA_EXTENSIONS", ".tf, .hcl")
    monkeypatch.setenv("INDEX_REMOVE_EXTENSIONS", ".json")
    monkeypatch.setenv("INDEX_EXTRA_EXCLUDE_DIRS", "tmp")
    assert apply(spark, paths.is_excluded("a"), ["a.tf", "a.json", "tmp/a.tf"]) == [False, True, True]


def test_terms(spark):
    words = ["the", "straße", "x_1", "日本"]
    assert apply(spark, sparse.term_number(F.col("a")), words) == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 30_000 for w in words]
    texts = ["Été à l'Île_2, x-y", "", None]
    assert apply(spark, sparse.tokens("a"), texts) == [re.findall(r"\w+", (t or "").lower()) for t in texts]
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k int, t string")
    assert sorted((r["k"], r["tf"]) for r in sparse.postings(df, "k", "t").collect()) == [(1, 1), (1, 2)]


def test_hashing_embedder():
    v = hashing_embedder(["a b c", "a b c", "", "other words"])
    assert (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-9 and not v[2].any()


def test_tags_equal_whole_patterns(spark):
    words = ["enum OrderStatus", "status enum", "state  machine", "statemachine", "state", "tbl", "tblx", "stored proc", "sp1", "a.b(", ".b(", "a.(", "a::b", "::b", "x.config", "xconfig", "ROBOT", "tımeout", "ſelect", "K", "", None]
    rows = [(i, t) for i, t in enumerate(words)]
    got = {r["i"]: r["tags"] for r in spark.createDataFrame(rows, "i int, t string").select("i", text.tags("t", F.lit("")).alias("tags")).collect()}
    for i, t in rows:
        assert got[i] == sorted(k for k, p in text.TAG_PATTERNS.items() if re.search(p, (t or "").lower(), re.I)), t


def test_pieces_are_bounded_and_whole():
    own = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": [["a"] * n if n is not None else None for n in (3, 0, None, 9, 2, 2, 1)]})
    got = list(batches.pieces(own, pc.list_value_length(own.column(1)), 4))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([own]))
    assert [g.column(0).to_pylist() for g in got] == [[0, 1, 2], [3], [4, 5], [6]]
    assert [len(g) for g in batches.pieces(own, pc.list_value_length(own.column(1)), 100, 3)] == [3, 3, 1]
    assert list(batches.pieces(own.slice(0, 0), pc.list_value_length(own.column(1).slice(0, 0)), 4)) == []


def test_postings_do_not_depend_on_pieces(spark, monkeypatch):
    rows = [(k, None if k % 11 == 5 else " ".join(f"w{k * j % 13}" for j in range(k % 7))) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    want = sorted(map(tuple, sparse.postings(df, "k", "t").collect()))
    monkeypatch.setattr(sparse, "PIECE_TOKENS", 3)
    assert sorted(map(tuple, sparse.postings(df, "k", "t").collect())) == want
    assert sum(n for *_, n in want) == sum(len((t or "").split()) for _, t in rows)


def test_a_model_gets_long_texts_in_smaller_numbers(spark):
    def model(texts):
        return np.array([[float(len(texts)), float(sum(map(len, texts)))] for _ in texts])

    df = spark.range(12).select("id", F.repeat(F.lit("ab "), 500_000).alias("content")).coalesce(1)
    got = [r["embedding"] for r in embed.embed(df, "content", model).collect()]
    assert len(got) == 12 and max(n for _, n in got) <= embed.PIECE_BYTES and max(k for k, _ in got) > 1
