import pytest

from kelpie.operators import chunkers as c
from kelpie.operators import chunking

MD = """before

# One
text one
## Two
```
# not a heading
~~~
```
### Deep
deep text
# Next
end
"""


def test_markdown():
    p = c.markdown(MD)
    assert [(s.name, s.content) for s in p.symbols] == [
        ("document", "before"), ("One", "[One]\n\ntext one"), ("Two", "[One > Two]\n\n```\n# not a heading\n~~~\n```"), ("Deep", "[One > Two > Deep]\n\ndeep text"), ("Next", "[Next]\n\nend"),
    ]
    assert [(e.source, e.target) for e in p.edges] == [("Two", "One"), ("Deep", "Two")]
    assert p.symbols[1].start_line == 3


def test_markdown_parts_never_cut_a_fence():
    fence = "```\n" + "code\n\n" * 200 + "```"
    p = c.markdown("# T\n" + "para words\n\n" * 50 + fence, limit=100)
    assert {s.node_type for s in p.symbols} == {"section_part"}
    assert sum("```\ncode" in s.content and s.content.rstrip().endswith("```") for s in p.symbols) == 1


def test_yaml():
    p = c.yaml("# note\nversion: 1\nservices:\n  # about\n  a:\n    x: 1\n  b:\n    y: 2\n")
    assert [s.name for s in p.symbols] == ["_preamble", "version", "services"]
    big = c.yaml("services:\n  # about\n  a:\n    x: 1\n  b:\n    y: 2\n", limit=5)
    assert [s.name for s in big.symbols] == ["services._head", "services.a", "services.b"]
    assert [s.name for s in c.yaml("- a\n- b").symbols] == ["_document"]
    assert c.yaml("# Title\n\nprose\n## Part\nmore").symbols[0].node_type == "section"


def test_python():
    p = c.python("import x\n@d\nclass A(B):\n    def f(self): pass\n    def g(self): pass\n\ndef h():\n    return 1\n")
    assert [(s.fqn, s.node_type, s.start_line) for s in p.symbols] == [("A", "class", 2), ("A.f", "function", 4), ("A.g", "function", 5), ("h", "function", 7)]
    assert ("INHERITS", "A", "B") in [(e.type, e.source, e.target) for e in p.edges]
    assert c.python("x = (").symbols[0].node_type == "file"


CS = """using System.Text;
namespace Acme.Core;
public interface IThing { }
public class Order : Base<int>, IThing
{
    private readonly Repo _repo;
    public Customer? Owner { get; set; }
    public Order(Repo r) { _repo = r; }
    public async Task<int> Run(string s) { if (s == "}") { return 1; } return 2; }
}
public enum Kind { A, B }
"""


def test_csharp():
    p = c.braces(CS, "cs", "a.cs")
    assert [(s.fqn, s.node_type) for s in p.symbols] == [
        ("Acme.Core.IThing", "interface"), ("Acme.Core.Order._repo", "field"), ("Acme.Core.Order.Owner", "property"), ("Acme.Core.Order.Order", "constructor"), ("Acme.Core.Order.Run", "method"), ("Acme.Core.Kind", "enum"),
    ]
    edges = {(e.type, e.source, e.target) for e in p.edges}
    assert {("IMPORTS", "a.cs", "System.Text"), ("INHERITS", "Acme.Core.Order", "Base"), ("IMPLEMENTS", "Acme.Core.Order", "IThing"), ("USES_TYPE", "Acme.Core.Order", "Repo"), ("USES_TYPE", "Acme.Core.Order", "Customer")} <= edges


def test_java():
    p = c.braces("package a.b;\nimport java.util.List;\npublic class C extends D implements E, F<G> {\n  private Foo foo;\n  public C() { }\n  void run(int x) throws IOException { }\n}\n", "java", "C.java")
    assert [s.fqn for s in p.symbols] == ["a.b.C.foo", "a.b.C.C", "a.b.C.run"]
    assert {("INHERITS", "D"), ("IMPLEMENTS", "E"), ("IMPLEMENTS", "F"), ("USES_TYPE", "Foo"), ("IMPORTS", "java.util.List")} <= {(e.type, e.target) for e in p.edges}


def test_sql_and_generic():
    assert len(c.sql("CREATE TABLE a (x int)\nGO\nALTER TABLE a ADD y int\nGO\n").symbols) == 2
    assert [s.name for s in c.sql("CREATE PROCEDURE p1 AS x;\nCREATE TABLE t (y int);").symbols] == ["p1", "t"]
    assert [s.name for s in c.generic("export function f(a) {\n  return {b: 1};\n}\nclass G {\n}\nconst h = (x) => x;\n").symbols] == ["f", "G", "h"]
    assert [s.name for s in c.generic("fn main() { }\nstruct S { a: u8 }").symbols] == ["main", "S"]


def test_html_template():
    p = c.html_template('@model Foo\n<div id="top"><p>a</p></div>\n<script>\nfunction go() { }\n</script>\n<style>p{}</style>\n<nav class="main x">n</nav><p>')
    assert [s.name for s in p.symbols][:5] == ["directives", "div#top", "script:go", "style", "nav.main"]
    assert p.symbols[2].start_line == 4


def test_bounded_chunks():
    assert c.bounded_chunks("a.md", "short", 100) == ["// File: a.md\nshort"]
    assert c.bounded_chunks("a.md", " ", 100) == []
    parts = c.bounded_chunks("a.md", "\n".join(f"## h{i}\n" + "word " * 30 for i in range(10)), 60)
    assert all(c.tokens(p) <= 60 for p in parts) and sum(p.count("## h") for p in parts) == 10
    forced = c.forced("x" * 1000, 100, 50)
    assert [len(f) for f in forced] == [400, 400, 400, 400] and c.forced("", 10, 5) == []


@pytest.mark.parametrize("path", ["a.md", "a.yml", "a.py", "a.cs", "a.java", "a.sql", "a.html", "a.go", "a.txt", "noext", ""])
@pytest.mark.parametrize("text", ["", " \n", "{", "}}", "\x00\"'", "#" * 5000, "<" * 100, "a: b\n" * 3000])
def test_odd_texts(path, text):
    assert isinstance(c.parse(path, text), c.Parsed)


def test_tables(spark):
    files = spark.createDataFrame([("a.md", MD, 1), ("b.py", "class A:\n    def f(self): pass\n", 2), ("c.txt", None, 3)], "file_path string, content string, name int")
    rows = chunking.symbols(files).collect()
    assert {r["file_path"] for r in rows} == {"a.md", "b.py"}
    assert chunking.relations(files).count() == 3
    assert chunking.token_chunks(files, 10).filter("file_path = 'a.md'").count() >= 2
    assert chunking.symbols(files.limit(0)).count() == 0
