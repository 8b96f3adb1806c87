from kelpie.sources.graph_state import GraphState


def test_projects_do_not_touch_each_other(spark, tmp_path):
    state = GraphState(spark, str(tmp_path / "g"))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = lambda *r: frame(list(r), "project string, file_path string, file_hash string")
    symbols = lambda *r: frame(list(r), "project string, file_path string, fqn string, name string, kind string")
    edges = lambda *r: frame(list(r), "project string, file_path string, type string, source string, target string")
    put = state.put(
        files(("p", "f", "1"), ("p", "g", "2"), ("q", "f", "3"), ("q", "h", None)),
        symbols(("p", "f", "a.B", "B", "class"), ("p", "g", "a.C", "C", "class"), ("q", "f", "a.B", "B", "enum"), ("p", "elsewhere", "a.X", "X", "class"), ("p", "f", None, None, None)),
        edges(("p", "f", "calls", "a.B", "a.C"), ("p", "g", "CALLS", "a.B", "a.C"), ("p", "g", "calls", "a.C", "lib.D"), ("q", "f", "calls", "a.B", "lib.D"), ("q", "f", "no_such_type", "a.B", "a.Z")),
    )
    assert put == {"files": 4, "symbols": 3, "edges": 4, "gone": 4}
    nodes = lambda p: {(r["fqn"], r["kind"], r["file_path"]) for r in state.nodes(p).collect()}
    links = lambda p: sorted((r["type"], r["source"], r["target"]) for r in state.edges(p).collect())
    assert nodes("p") == {("a.B", "class", "f"), ("a.C", "class", "g"), ("lib.D", "external", None)}
    assert links("p") == [("CALLS", "a.B", "a.C"), ("CALLS", "a.C", "lib.D")]
    before = (nodes("q"), links("q"), sorted(map(tuple, state.hashes("q").collect())))
    assert before[2] == [("f", "3")]
    assert {(r["file_path"], r["status"]) for r in state.delta("p", frame([("f", "1"), ("n", "9")], "file_path string, file_hash string")).collect()} == {("f", "same"), ("n", "new"), ("g", "deleted")}
    # g states the relation too, so it outlives f; its end is a placeholder until a file defines it again
    assert state.delete_files("p", frame([("f",), ("nowhere",)], "file_path string")) == 1
    assert links("p") == [("CALLS", "a.B", "a.C"), ("CALLS", "a.C", "lib.D")]
    assert nodes("p") == {("a.B", None, None), ("a.C", "class", "g"), ("lib.D", "external", None)}
    state.put(files(("p", "f", "4")), symbols(("p", "f", "a.B", "B", "record")), edges())
    assert ("a.B", "record", "f") in nodes("p")
    assert (nodes("q"), links("q"), sorted(map(tuple, state.hashes("q").collect()))) == before
    assert state.delete_project("p") == 2 and state.delete_project("p") == 0
    assert nodes("p") == set() and links("p") == [] and (nodes("q"), links("q"), sorted(map(tuple, state.hashes("q").collect()))) == before
    assert [r["project"] for r in state.projects().collect()] == ["q"]
    for k in range(10):  # merges of small changes keep all that
        state.put(files(("r", f"f{k % 3}", str(k))), symbols(("r", f"f{k % 3}", f"r.S{k}", "S", "class")), edges())
    assert {x[0] for x in nodes("r")} == {"r.S7", "r.S8", "r.S9"} and (nodes("q"), links("q"), sorted(map(tuple, state.hashes("q").collect()))) == before
