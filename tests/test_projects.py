import json
import random

from kelpie.api import Engine
from kelpie.sources import projects


def plain_nearest(path, marks):
    best = max((m for m in marks if path.startswith(m)), key=len, default=None)
    return best


def test_nearest_project_and_solution(spark):
    rng = random.Random(4)
    folders = ["", "a/", "a/b/", "a/b/c/", "ab/", "x/", "x/y/z/"]
    files = [f"{rng.choice(folders)}f{k}{rng.choice(['.cs', '.java', '.md'])}" for k in range(80)] + ["a/One.sln", "a/b/c/pom.xml", "x/build.gradle", "x/pom.xml", "ab/go.mod", "ab/setup.py", "x/y/z/Deep.sln"]
    df = spark.createDataFrame([(f, "h") for f in files], "file_path string, file_hash string")
    kinds = {"a/": "dotnet", "a/b/c/": "java-maven", "x/": "mixed", "ab/": "mixed", "x/y/z/": "dotnet"}
    got = {r["file_path"]: (r["project_root"], r["project_type"]) for r in projects.nearest_project(df, hot_rows=9).collect()}
    assert got == {f: (m, kinds[m]) if (m := plain_nearest(f, kinds)) is not None else ("", "unknown") for f in files}
    marks = {".cs": {"a/": "a/One.sln", "x/y/z/": "x/y/z/Deep.sln"}, ".java": {"a/b/c/": "a/b/c/pom.xml", "x/": "x/build.gradle"}}
    want = {f: own[m] for ext, own in marks.items() for f in files if f.endswith(ext) and (m := plain_nearest(f, own)) is not None}
    assert {r["file_path"]: r["solution"] for r in projects.nearest_solution(df, hot_rows=9).collect()} == want
    assert projects.nearest_project(df.limit(0)).count() == 0


def test_solution_hash_follows_files_and_version_in_any_order(spark):
    rows = [("s", f"f{k}", f"h{k}") for k in range(20)] + [("t", "f0", "h0")]
    frame = lambda r: spark.createDataFrame(r, "solution string, file_path string, file_hash string")
    hashes = lambda r, v="": {x["solution"]: x["solution_hash"] for x in projects.solution_hashes(frame(r), v).collect()}
    one = hashes(rows)
    assert hashes(rows[::-1]) == one and one["s"] != one["t"]
    assert hashes([("s", "f0", "other"), *rows[1:]])["s"] != one["s"] and hashes(rows[1:])["s"] != one["s"] and hashes(rows, "2")["s"] != one["s"]
    known = spark.createDataFrame(list(one.items()), "solution string, solution_hash string")
    assert [r["solution"] for r in projects.changed_solutions(projects.solution_hashes(frame([*rows[:-1], ("t", "f9", "h9"), ("u", "f", "h")])), known).orderBy("solution").collect()] == ["t", "u"]


def test_changed_solutions_take_in_their_artifacts_again(spark, tmp_path, monkeypatch):
    src, given = tmp_path / "src", tmp_path / "artifacts"
    for folder in ("one", "two"):
        (src / folder).mkdir(parents=True)
        (src / folder / f"{folder}.csproj").write_text("<Project/>")
        (src / folder / "All.sln").write_text("solution")
        for f in "AB":
            (src / folder / f"{f}.cs").write_text(f"class {f} {{ }}")
    given.mkdir()

    def artifact(folder, body):
        run = {"name": f"{folder}.A.Run", "node_type": "Method", "content": body, "start_line": 1, "end_line": 1}
        (given / f"{folder}.json").write_text(json.dumps({"file_path": f"/src/{folder}/A.cs", "language": "csharp", "symbols": [run], "relationships": [{"type": "calls", "source": f"{folder}.A.Run", "target": "B"}]}))

    for folder in ("one", "two"):
        artifact(folder, "first")
    e = Engine(spark, str(tmp_path / "index"))
    first = e.index(str(src), str(given))
    assert first["indexed"] >= 4
    homes = {r["file_path"].rsplit("src/", 1)[-1]: (r["project_root"].rsplit("src/", 1)[-1], r["project_type"], r["analyser"]) for r in e.idx.table("files").collect()}
    assert homes["one/B.cs"] == ("one/", "dotnet", "built-in")
    assert e.index(str(src), str(given))["indexed"] == 0
    for folder in ("one", "two"):
        artifact(folder, "second")
    (src / "one" / "B.cs").write_text("class B { int x; }")
    read = []
    from kelpie.operators import chunking

    plain = chunking.two_phase
    monkeypatch.setattr(chunking, "two_phase", lambda files, covered: read.append({r["file_path"].rsplit("src/", 1)[-1] for r in files.select("file_path").collect()}) or plain(files, covered))
    assert e.index(str(src), str(given))["indexed"] == 1
    assert {x for x in read[0] if x.endswith(".cs")} == {"one/A.cs", "one/B.cs"}
    runs = {r["fqn"]: r["content"] for r in e.idx.chunks().filter("fqn LIKE '%.Run'").collect()}
    assert runs == {"one.A.Run": "second", "two.A.Run": "first"}
