import json

import pytest

from kelpie.api import Engine, resolve
from kelpie.operators import evidence, graph
from kelpie.plans import search
from kelpie.sources import artifacts, projects, scan, trace
from kelpie.sources.store import ChangeLog, Table

FILES = {
    "src/Order.cs": "namespace Acme;\npublic class Order : Base\n{\n    public void Run() { Queue.Send(1); }\n    public int Count { get; set; }\n}\n",
    "src/Base.cs": "namespace Acme;\npublic class Base\n{\n    public void Stop() { }\n    public void Start() { }\n}\n",
    "docs/guide.md": "# Guide\nHow orders are retried, with order.timeout.ms.\n## Queue\nMessages are sent.\n",
    "conf/app.yaml": "order:\n  timeout: 5\nqueue: main\n",
    "node_modules/x.js": "ignored()",
}


@pytest.fixture
def tree(tmp_path):
    for k, v in FILES.items():
        p = tmp_path / "tree" / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(v)
    return tmp_path / "tree"


def test_incremental_index(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    assert e.index(str(tree)) == {"indexed": 4, "deleted": 0, "skipped": 0, "errors": 0}
    assert e.index(str(tree)) == {"indexed": 0, "deleted": 0, "skipped": 4, "errors": 0}
    (tree / "docs/guide.md").write_text("# Guide\nSomething else entirely.\n")
    (tree / "conf/app.yaml").unlink()
    assert e.index(str(tree)) == {"indexed": 1, "deleted": 1, "skipped": 2, "errors": 0}
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.md").write_text("# A\nother tree\n")
    assert e.index(str(other))["deleted"] == 0
    status = e.index_status()
    assert status["files"] == 4 and status["categories"]["source-code"] >= 2 and status["categories"]["devops"] == 0
    assert e.quick_search("something else entirely").first()["file_path"].endswith("guide.md")
    assert e.quick_search("Queue.Send", "exact", 3).first()["file_path"].endswith("Order.cs")
    assert e.quick_search("stop", "keyword", 3, {"category": ["source-code"]}).first()["file_path"].endswith("Base.cs")
    assert e.idx.by_path(str(tree / "src/Base.cs")).count() == 2
    names = {r["fqn"] for r in e.graph_neighbors("Order", 1, "out", ["inherits"]).collect()}
    assert names <= {"Base", "Acme.Base"}
    assert e.graph_query("SELECT count(*) AS n FROM symbols WHERE kind = :k", {"k": "method"}).first()["n"] >= 2
    assert {r["what"] for r in e.graph_status().collect()} == {"node", "edge", "project"}
    assert e.graph_projects().first()["project"] == "default"
    assert e.analyze(str(tree))["project_type"] == "unknown"
    result = e.search("how are orders sent to the Queue", max_iterations=2)
    assert result.success and result.cards and result.iterations <= 2 and result.reason
    assert len({c["fingerprint"] for c in result.cards}) == len(result.cards)
    assert search.to_markdown(result).count("\n- `") == min(10, len(result.cards))


def test_broken_off_index_leaves_no_trace(spark, tree, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "index"))
    write, mark = ChangeLog._write, ChangeLog._mark

    def until(table):
        def broken(self, name, number, gone, tables):
            schemas = dict(self.schemas)
            try:
                if "chunks" in schemas:
                    self.schemas = {k: schemas[k] for k in list(schemas)[: list(schemas).index(table) + 1]}
                write(self, name, number, gone, tables)
            finally:
                self.schemas = schemas
            if "chunks" in schemas:
                raise OSError(table)

        return broken

    def state():
        return {t: sorted(map(str, e.idx.table(t).drop("embedding").collect())) for t in ("files", "chunks", "postings", "edges")}

    before = state()
    for table in ("files", "chunks", "postings", "edges"):
        monkeypatch.setattr(ChangeLog, "_write", until(table))
        with pytest.raises(OSError, match=table):
            e.index(str(tree))
        assert state() == before
    monkeypatch.setattr(ChangeLog, "_write", write)
    monkeypatch.setattr(ChangeLog, "_mark", lambda self, s: mark(self, s) if "chunks" not in self.schemas else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        e.index(str(tree))
    monkeypatch.setattr(ChangeLog, "_mark", mark)
    assert e.index(str(tree)) == {"indexed": 4, "deleted": 0, "skipped": 0, "errors": 0}
    chunks = e.idx.chunks()
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 4
    e.idx.log.vacuum()
    assert e.idx.chunks().count() == chunks.count()


def test_changes_are_written_in_proportion(spark, tmp_path, monkeypatch):
    tree = tmp_path / "many"
    tree.mkdir()
    for k in range(60):
        (tree / f"f{k}.md").write_text(f"# Title {k}\n" + " ".join(f"word{k}x{j}" for j in range(400)))
    e = Engine(spark, str(tmp_path / "index"))
    e.index(str(tree))
    (tree / "f7.md").write_text("# Title 7\nnew words")
    assert e.index(str(tree)) == {"indexed": 1, "deleted": 0, "skipped": 59, "errors": 0}
    first, second = e.idx.log.state()["changes"]
    assert e.idx.log._size([second]) < e.idx.log._size([first]) / 10
    monkeypatch.setattr(ChangeLog, "MOST", 2)
    for k in range(3):  # the small changes are merged, the large one stays
        (tree / "f7.md").write_text(f"# Title 7\nnew words {k}")
        (tree / f"f{10 + k}.md").unlink()
        e.index(str(tree))
    assert first in e.idx.log.state()["changes"] and len(e.idx.log.state()["changes"]) <= 3
    assert e.idx.table("files").count() == 57 == e.idx.chunks().select("file_path").distinct().count()
    assert "new words 2" in e.idx.by_path(str(tree / "f7.md")).first()["content"]
    e.idx.log.merge()
    assert e.idx.table("files").count() == 57 and e.idx.chunks().filter("file_path LIKE '%/f7.md'").count() == 1


def test_stop_rules(spark):
    pool = spark.createDataFrame([], search.POOL)
    b = search.Budget(max_iterations=3, max_tokens=100)
    state = lambda **k: search.State("q", needs=[search.Need("n", ["x"])], **k)
    assert search.should_stop(state(iteration=3), pool, b) == (True, "max_iterations_reached")
    assert search.should_stop(state(tokens=100), pool, b) == (True, "token_budget_exceeded")
    assert search.should_stop(state(no_new=1), pool, b) == (False, "triggering_fallback")
    assert search.should_stop(state(no_new=2), pool, b) == (True, "stuck_after_fallback")
    assert search.should_stop(state(), pool, b) == (False, "")


def test_query_building():
    I = search.Intent  # noqa: E741
    assert [q.query for q in search.build(I("Order.Run", operator="callsite"))] == ['"Order.Run"', '"Order#Run"', '"Order::Run"', '"Run("', "await Run", ".Run("]
    assert [q.query for q in search.build(I("order_run", operator="symbol_ref"))] == ['"order_run"', '"OrderRun"']
    assert search.build(I("x", operator="semantic"))[0].operator == "hybrid"
    assert len(search.build_from_template("entry_point", "pay")) == 14
    assert search.build_from_template("none", "pay")[0].operator == "semantic"
    assert search.extract_json("<think>{no}</think> so {\"a\": 1} end") == {"a": 1}
    assert search.extract_json("{bad") is None
    view = search.Ensemble([lambda q, s: {"subject": "", "gaps": ["g"]}, lambda q, s: 1 / 0, lambda q, s: {"subject": "s", "gaps": ["g", "h"], "reasoning": "r"}])("q", "")
    assert (view["subject"], view["gaps"], view["reasoning"]) == ("s", ["g", "h"], "r")
    assert resolve("${NOT_SET_HERE:-d}/x") == "d/x"


def card(i, **k):
    own = {"fingerprint": f"f{i}", "id": f"id{i}", "path": f"m{i}/x/y.cs", "chunk_text": "x.y()", "tags": ["callsite", "api"], "source_kind": "code", "entities": {"config_keys": ["k"], "enums": [], "constants": []}, "score_rerank": i / 10, "round_found": 0, "ord": i}
    return own | k


CARD = "fingerprint string, id string, path string, chunk_text string, tags array<string>, source_kind string, entities struct<config_keys:array<string>,enums:array<string>,constants:array<string>>, score_rerank double, round_found int, ord long"


def frame(spark, cards):
    return spark.createDataFrame([tuple(c[f.split()[0]] for f in CARD.split(", ")[:6]) + (tuple(c["entities"].values()), c["score_rerank"], c["round_found"], c["ord"]) for c in cards], CARD)


def test_gates(spark):
    reason = lambda cards: evidence.quality_gate(frame(spark, cards)).first()["reason"]
    none = {"config_keys": [], "enums": [], "constants": ["C"]}
    assert reason([]) == "no_evidence"
    assert reason([card(1)]) == "insufficient_code_evidence: 1/2"
    assert reason([card(1, tags=["a"]), card(2, tags=["a"])]) == "insufficient_tag_diversity: 1/2"
    assert reason([card(1, tags=["a", "b"]), card(2)][:1] * 2) == "missing_call_edge_evidence"
    assert reason([card(1, entities=none), card(2, entities=none)]) == "missing_named_entity"
    assert reason([card(1), card(2)]) == "passed"
    pool = frame(spark, [card(1, chunk_text="a.timeout default: 1"), card(2, chunk_text="transition")])
    needs = {"two of three": ["config key", "transition", "zzz"], "three of four": ["config key", "transition", "default value", "zzz"], "free": []}
    assert {r["need"]: r["satisfied"] for r in evidence.accept_coverage(pool, needs).collect()} == {"two of three": False, "three of four": True, "free": True}


def test_working_set_follows_the_sequential_rule(spark):
    import random

    rng = random.Random(6)
    cards = [card(i, path=f"m{rng.randrange(4)}/a/b/c.cs", tags=rng.sample(["a", "b", "c", "d", "e"], rng.randrange(3)), score_rerank=rng.randrange(20) / 20) for i in range(60)]
    seen_m, seen_t, want = set(), set(), []
    for c in sorted(cards, key=lambda c: (-c["score_rerank"], c["ord"])):
        m = "/".join(c["path"].split("/")[:3])
        if len(want) < 20 and (len(want) < 10 or m not in seen_m or set(c["tags"]) - seen_t):
            want.append(c["id"])
            seen_m.add(m)
            seen_t |= set(c["tags"])
    assert [r["id"] for r in evidence.working_set(frame(spark, cards)).orderBy("rank").collect()] == want
    assert evidence.evict(frame(spark, cards), 0, 10).count() == 10
    assert evidence.stats(frame(spark, cards))["total"] == 60
    assert evidence.lookup(frame(spark, cards), ["id7"]).count() == 1


def test_graph_writes(spark):
    nodes = spark.createDataFrame([("p", "a.B", "B", "class", "f1"), ("p", "a.C", "C", None, "f2")], "project string, fqn string, name string, kind string, file_path string")
    new = spark.createDataFrame([("p", "a.C", None, "enum", None), ("p", "a.D", "D", "class", "f3")], nodes.schema)
    merged = {r["fqn"]: (r["name"], r["kind"], r["file_path"]) for r in graph.upsert_symbols(nodes, new).collect()}
    assert merged == {"a.B": ("B", "class", "f1"), "a.C": ("C", "enum", "f2"), "a.D": ("D", "class", "f3")}
    edges = graph.clean_edges(spark.createDataFrame([("p", "calls", "a.B", "x.Y"), ("p", "CALLS", "a.B", "x.Y"), ("p", "unknown", "a.B", "a.C"), ("p", "INHERITS", "q.Z", "a.B")], "project string, type string, source string, target string"))
    assert edges.count() == 2
    kinds = {r["fqn"]: r["kind"] for r in graph.with_endpoints(nodes, edges).collect()}
    assert kinds == {"a.B": "class", "a.C": None, "x.Y": "external", "q.Z": None}
    left, e = graph.delete_file(nodes, edges, "p", "f1")
    assert left.count() == 1 and e.count() == 0
    assert graph.uniqueness_violations(nodes.union(nodes), ["project", "fqn"]).count() == 2
    files = spark.createDataFrame([("p", "f1")], "project string, path string")
    assert [r["source"] for r in graph.defined_in(nodes, files).collect()] == ["a.B"]


def test_artifacts_and_projects(spark, tmp_path):
    art = {"file_path": "/src/S.cs", "language": "csharp", "symbols": [{"name": "a.S.Run(int)", "node_type": "method", "content": "x", "start_line": 0, "end_line": 3, "metadata": {"file_path": "/src/S.cs"}}, {"name": "a.K.V", "node_type": "enum_member", "content": "V", "start_line": 5, "end_line": 5}], "relationships": [{"type": "calls", "source": "a.T", "target": "a.S.Run"}, {"type": "calls", "source": "a.T", "target": "a.T"}]}
    (tmp_path / artifacts.file_name("/src/S.cs")).write_text(json.dumps(art))
    (tmp_path / "bad.json").write_text("{}")
    a = artifacts.read(spark, str(tmp_path))
    n = {r["fqn"]: r for r in artifacts.nodes(a, "p", "solution", True).collect()}
    assert n["a.S.Run(int)"]["name"] == "Run" and n["a.S.Run(int)"]["file_path"] == "solution/S.cs" and n["a.S.Run(int)"]["start_line"] == 1
    assert sorted((r["type"], r["source"], r["target"]) for r in artifacts.edges(a, "p").collect()) == [("CALLS", "a.T", "a.S.Run(int)"), ("MEMBER_OF", "a.K.V", "a.K")]
    files = lambda *xs: spark.createDataFrame([(x, "h") for x in xs], "file_path string, file_hash string")
    kind = lambda *xs: projects.project_type(files(*xs)).first()[0]
    assert (kind("a.txt"), kind("x/pom.xml"), kind("pom.xml", "go.mod"), kind("A.sln", "b.csproj")) == ("unknown", "java-maven", "mixed", "dotnet")
    own = scan.solution_files(files("a/X.sln", "a/b/c.cs", "d/e.cs", "a/pom.xml", "a/F.java"))
    assert sorted(map(tuple, own.select("solution", "file_path").collect())) == [("a/X.sln", "a/b/c.cs"), ("a/pom.xml", "a/F.java")]
    assert [r["analyser"] for r in projects.routed(files("a.md", "b.cs")).orderBy("file_path").collect()] == ["markdown", "built-in"]


def test_table_and_trace(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k int, v string")
    make = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert t.read().count() == 0 and not t.exists()
    t.write(make((1, "a"), (2, "b")))
    t.replace(["k"], make((2, "c"), (3, "xd")))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "xd")]
    t.delete_prefix("v", "x")
    t.vacuum()
    assert t.read().count() == 2
    log = trace.Trace(str(tmp_path / "t.jsonl"))
    log("s", "start", query="é")
    assert trace.read(spark, log.path).first()["event"] == "start"
    trace.Trace("/no/such/folder/x")("s", "start")


def test_streams(spark, tmp_path):
    from kelpie.streaming import stream

    rows = spark.createDataFrame([("a", "one two"), ("b", "two three")], "file_path string, content string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    log = ChangeLog(spark, str(tmp_path / "log"), {"files": "file_path string, file_hash string", "postings": "file_path string, term int, tf long"}, ["file_path"])
    go = lambda: stream.index_changes(stream.parquet_stream(spark, str(tmp_path / "in"), rows.schema), log, str(tmp_path / "cp")).awaitTermination()
    go()
    assert log.read("postings").count() == 4
    spark.createDataFrame([("a", "one"), ("b", "two three")], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted(r["file_path"] for r in log.read("postings").collect()) == ["a", "b", "b"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    got = []
    for f in (stream.event_windows, stream.event_sessions):
        q = f(stream.parquet_stream(spark, str(tmp_path / "events"), events.schema)).writeStream.outputMode("append").format("memory").queryName(f.__name__).option("checkpointLocation", str(tmp_path / f.__name__)).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(spark.table(f.__name__).agg({"n": "sum"}).first()[0] or 0)
    assert all(0 < n <= events.count() for n in got)


def test_neighbors_use_no_edge_twice(spark):
    import random

    rng = random.Random(8)
    names = [f"n{i}" for i in range(9)]
    rows = sorted({("p", rng.choice(["CALLS", "CREATES"]), rng.choice(names), rng.choice(names)) for _ in range(14)})
    nodes = spark.createDataFrame([("p", n, n, "class") for n in names], "project string, fqn string, name string, kind string")
    edges = spark.createDataFrame(rows, "project string, type string, source string, target string")
    for direction in ("out", "in", "both"):
        steps = [(k, a, b) for k, (_, _, a, b) in enumerate(rows) if direction != "in"] + [(k, b, a) for k, (_, _, a, b) in enumerate(rows) if direction != "out"]
        for name in names[:3]:
            best, front = {}, [(name, ())]
            for hop in (1, 2, 3):
                front = [(b, (*path, k)) for at, path in front for k, a, b in steps if a == at and k not in path]
                for n, _ in front:
                    best.setdefault(n, hop)
            got = graph.neighbors(nodes, edges, graph.seed(nodes, name), 3, direction, limit=None).collect()
            assert {r["fqn"]: r["hops"] for r in got} == best


def test_models_plug_in(spark):
    from kelpie.functions.embed import with_retry
    from kelpie.operators import chunking, retrieval

    hits = spark.createDataFrame([(1, "aa"), (2, "a"), (3, None), (4, "aaaa")], "doc_id int, text string")
    got = retrieval.model_rerank(hits, "q", lambda: lambda pairs: [len(t) for _, t in pairs], m=3, batch=2)
    assert [(r["doc_id"], r["score_rerank"]) for r in got.collect()] == [(4, 4.0), (1, 2.0), (2, 1.0)]
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return [len(t) for t in texts]

    assert with_retry(flaky, TimeoutError, wait=0)(["ab"]) == [2]
    with pytest.raises(TimeoutError):
        with_retry(lambda t: (_ for _ in ()).throw(TimeoutError()), TimeoutError, tries=2, wait=0)(["x"])
    files = spark.createDataFrame([("a.md", "# A\nx"), ("b.cs", "class B { }")], "file_path string, content string")
    assert {r["file_path"] for r in chunking.two_phase(files, files.filter("file_path = 'b.cs'")).collect()} == {"a.md"}
    old = spark.createDataFrame([("p", "f", "h1")], "project string, path string, hash string")
    new = spark.createDataFrame([("p", "f", None), ("p", "g", "h2")], old.schema)
    assert {r["path"]: r["hash"] for r in graph.upsert_files(old, new).collect()} == {"f": "h1", "g": "h2"}
    assert search.unsupported(["it handles x", "it is x"]) == ["it is x"]


def test_artifacts_go_into_the_index(spark, tmp_path):
    src, given = tmp_path / "src", tmp_path / "artifacts"
    src.mkdir()
    given.mkdir()
    (src / "A.cs").write_text("class A { }")
    (src / "b.py").write_text("def f():\n    pass\n")
    run = {"name": "N.A.Run(int)", "node_type": "Method", "content": "void Run(int x) {}", "start_line": 1, "end_line": 1}
    calls = {"type": "calls", "source": "N.A.Go", "target": "N.A.Run"}
    (given / "A.json").write_text(json.dumps({"file_path": "/src/A.cs", "language": "csharp", "symbols": [run], "relationships": [calls]}))
    e = Engine(spark, str(tmp_path / "index"))
    assert e.index(str(src), str(given))["indexed"] == 2
    assert {(r["file_path"].rsplit("/", 1)[-1], r["fqn"]) for r in e.idx.chunks().collect()} == {("A.cs", "N.A.Run(int)"), ("b.py", "f")}
    assert [(r["type"], r["source"], r["target"]) for r in e.idx.edges().collect()] == [("CALLS", "N.A.Go", "N.A.Run(int)")]
    found = e.analyze(str(src), artifacts_path=str(given))
    assert (found["symbols"], found["relations"]) == (2, 1)
