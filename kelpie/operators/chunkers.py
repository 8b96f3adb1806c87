"""Splitting one file's text into symbols, on plain Python strings.

Each splitter gives Symbol records and Edge records; ``kelpie.operators.chunking`` runs them
over tables. Lines count from 1. Tokens are estimated as a quarter of the characters.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

MAX_TOKENS = 2000


@dataclass
class Symbol:
    name: str
    node_type: str
    content: str
    parent: str | None = None
    namespace: str | None = None
    start_line: int = 1
    end_line: int = 1

    @property
    def fqn(self) -> str:
        return ".".join(x for x in (self.namespace, self.parent, self.name) if x)


@dataclass
class Edge:
    type: str
    source: str
    target: str
    kind: str | None = None


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)


def tokens(text: str) -> int:
    return len(text) // 4


def whole_file(text: str, name: str = "file") -> list[Symbol]:
    lines = text.count("\n") + 1
    return [Symbol(name, "file", text, None, None, 1, lines)] if text.strip() else []


# Markdown

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")


def fenced(lines: list[str]) -> list[bool]:
    """Whether each line lies in a fenced block, its marks included; only the opening mark's character closes it."""
    out, mark = [], ""
    for line in lines:
        m = FENCE.match(line)
        if mark:
            out.append(True)
            if m and m[1][0] == mark:
                mark = ""
        else:
            out.append(bool(m))
            mark = m[1][0] if m else ""
    return out


def paragraphs(text: str) -> list[str]:
    """Parts between blank lines; a fenced block is never cut."""
    lines = text.split("\n")
    out, own = [], []
    for line, inside in zip(lines, fenced(lines), strict=True):
        if not line.strip() and not inside:
            if own:
                out.append("\n".join(own))
            own = []
        else:
            own.append(line)
    return [*out, "\n".join(own)] if own else out


def packed(parts: list[str], limit: int, glue: str = "\n\n") -> list[str]:
    """Neighbouring parts together up to the limit; a single larger part stays whole."""
    out: list[str] = []
    for p in parts:
        if out and tokens(out[-1] + glue + p) <= limit:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def markdown(text: str, limit: int = MAX_TOKENS) -> Parsed:
    """A row a section, headed by the path of its headings; too long sections in parts."""
    lines, out = text.split("\n"), Parsed()
    sections: list[tuple[list[str], int, list[str]]] = [([], 1, [])]
    path: list[tuple[int, str]] = []
    for k, (line, inside) in enumerate(zip(lines, fenced(lines), strict=True), 1):
        m = None if inside else HEADING.match(line)
        if m:
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), m[2]))
            sections.append(([h for _, h in path], k, []))
            if len(path) > 1:
                out.edges.append(Edge("SUBSECTION_OF", path[-1][1], path[-2][1]))
        else:
            sections[-1][2].append(line)
    for names, start, body in sections:
        own = "\n".join(body).strip()
        if not own:
            continue
        head = f"[{' > '.join(names)}]\n\n" if names else ""
        name, parent = names[-1] if names else "document", " > ".join(names[:-1]) or None
        end = start + len(body) - (0 if names else 1)
        if tokens(head + own) <= limit:
            out.symbols.append(Symbol(name, "section" if names else "document", head + own, parent, None, start, end))
        else:
            parts = packed(paragraphs(own), limit - tokens(head))
            for k, p in enumerate(parts, 1):
                out.symbols.append(Symbol(f"{name} ({k}/{len(parts)})", "section_part", head + p, parent, None, start, end))
    return out


# YAML

KEY = re.compile(r"^(?:[A-Za-z_][\w.\-/]*|\"[^\"]+\"|'[^']+')\s*:(?:\s|$)")
SUB_KEY = re.compile(r"^ {2}(?:[A-Za-z_][\w.\-/]*|\"[^\"]+\"|'[^']+')\s*:(?:\s|$)")


def yaml_is_markdown(lines: list[str]) -> bool:
    """Prose in a YAML file: headings at the margin, unless the first line that says anything is a key."""
    first = next((x for x in lines if x.strip() and x.strip() != "---" and not (x.startswith("#") and not HEADING.match(x))), "")
    if KEY.match(first):
        return False
    if any(x.startswith("##") or x.startswith("```yaml") for x in lines):
        return True
    return bool(HEADING.match(first)) and any(x.lstrip().startswith(("##", "```")) for x in lines[:50])


def _keyed(lines: list[str], key: re.Pattern) -> tuple[list[str], list[tuple[str, int, list[str]]]]:
    before, parts = [], []
    for k, line in enumerate(lines):
        if key.match(line):
            parts.append((line.strip().split(":")[0].strip("\"'"), k, [line]))
        elif parts:
            parts[-1][2].append(line)
        else:
            before.append(line)
    return before, parts


def yaml(text: str, limit: int = MAX_TOKENS) -> Parsed:
    """A row a top-level key; of too long ones a row a key below it, and what stands before those."""
    lines = text.split("\n")
    if yaml_is_markdown(lines):
        return markdown(text, limit)
    out = Parsed()
    before, parts = _keyed(lines, KEY)
    if not parts:
        out.symbols = whole_file(text, "_document")
        return out
    if any(x.strip() and x.strip() != "---" for x in before):
        out.symbols.append(Symbol("_preamble", "yaml_preamble", "\n".join(before).strip(), None, None, 1, len(before)))
    for name, at, body in parts:
        own = "\n".join(body).rstrip()
        head, below = _keyed(body[1:], SUB_KEY)
        if tokens(own) <= limit or len(below) < 2:
            out.symbols.append(Symbol(name, "yaml_key", own, None, None, at + 1, at + len(body)))
            continue
        if any(x.strip() for x in head):
            out.symbols.append(Symbol(f"{name}._head", "yaml_key", "\n".join([body[0], *head]), name, None, at + 1, at + 1 + len(head)))
        for sub, k, rows in below:
            out.symbols.append(Symbol(f"{name}.{sub}", "yaml_sub_key", f"{body[0]}\n" + "\n".join(rows).rstrip(), name, None, at + 2 + k, at + 1 + k + len(rows)))
    return out


# Code

NAMESPACE = {"cs": re.compile(r"^\s*namespace\s+([\w.]+)", re.M), "java": re.compile(r"^\s*package\s+([\w.]+)\s*;", re.M)}
IMPORT = {"cs": re.compile(r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", re.M), "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", re.M)}
TYPE = re.compile(r"^[ \t]*(?:\[[^\]\n]*\]\s*|@\w+(?:\([^)\n]*\))?\s+)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|final|readonly|strictfp)\s+)*(class|interface|struct|enum|record)\s+(\w+)([^{;\n]*(?:\n[^{;]*?)?)\{", re.M)
MEMBER = re.compile(r"^[ \t]*(?:\[[^\]\n]*\]\s*|@\w+(?:\([^)\n]*\))?\s+)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|final|readonly|synchronized|sealed|const|new|default)\s+)*(?:([\w<>\[\]?.,]+(?:\s*<[^;{()]*>)?)\s+)?(\w+)\s*(\([^;{}]*\)[^;{}]*\{|\{\s*(?:get|set|private|init)|\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?;|=>|=[^=>;]*;|;)", re.M)
NOT_TYPES = frozenset("return new throw else using package import namespace if for while switch catch case goto await yield".split())
#: Types of the languages themselves, which make no reference.
PRIMITIVES = frozenset(
    "int long short byte bool boolean char float double decimal string String object Object void var dynamic uint ulong ushort sbyte nint nuint "
    "Integer Long Short Byte Boolean Character Float Double DateTime DateTimeOffset TimeSpan Guid Task List Dictionary IEnumerable IList ICollection "
    "IReadOnlyList HashSet Nullable Map Set Collection Optional ArrayList HashMap".split()
)


def closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; strings and comments are passed over."""
    depth, k, n = 0, at, len(text)
    while k < n:
        c = text[k]
        if c in "\"'`":
            k += 1
            while k < n and text[k] != c:
                k += 2 if text[k] == "\\" else 1
        elif text.startswith("//", k):
            k = text.find("\n", k)
            k = n if k < 0 else k
        elif text.startswith("/*", k):
            k = text.find("*/", k + 2) + 1 or n
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    return n


@lru_cache(maxsize=1)
def line_starts(text: str) -> list[int]:
    """Where lines begin; kept for the file that is being split."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_at(text: str, at: int) -> int:
    return bisect_right(line_starts(text), at)


def bare_type(name: str) -> str:
    """Without generics, arrays and null marks."""
    return re.sub(r"<.*|\[.*|\?", "", name.strip(), flags=re.S).strip()


def heritage(rest: str, kind: str, lang: str) -> Iterator[tuple[str, str]]:
    """(edge type, name) of what a declaration's end says it extends."""
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", rest))
    flat = re.sub(r"\bwhere\b.*", "", flat, flags=re.S)
    if lang == "cs":
        m = re.search(r":\s*(.+)", flat, re.S)
        for x in (m[1].split(",") if m else []):
            if own := re.sub(r"\(.*", "", bare_type(x), flags=re.S).strip():
                short = own.rsplit(".", 1)[-1]
                yield ("IMPLEMENTS" if kind == "interface" or re.match(r"I[A-Z]", short) else "INHERITS"), own
        return
    for word, edge in (("extends", "INHERITS"), ("implements", "IMPLEMENTS")):
        m = re.search(rf"\b{word}\s+([\w.,\s]+?)(?=\bimplements\b|\bextends\b|\bpermits\b|$)", flat)
        for x in (m[1].split(",") if m else []):
            if x.strip():
                yield edge, x.strip()


def braces(text: str, lang: str, path: str) -> Parsed:
    """C# and Java: a row a member of each type of two or more, else a row the type; imports, heritage and type uses as edges."""
    out = Parsed()
    m = NAMESPACE[lang].search(text)
    ns = m[1] if m else None
    out.edges = [Edge("IMPORTS", path, x) for x in dict.fromkeys(IMPORT[lang].findall(text))]
    spans = [(m, closing(text, m.end() - 1)) for m in TYPE.finditer(text)]
    for m, end in spans:
        kind, name, rest = m[1], m[2], m[3]
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        outer = [o[2] for o, e in spans if o.start() < m.start() and end <= e]
        own = Symbol(name, kind, text[start:end], ".".join(outer) or None, ns, line_at(text, start), line_at(text, end - 1))
        out.edges += [Edge(t, own.fqn, target) for t, target in heritage(rest, kind, lang)]
        inner = [(o.start(), e) for o, e in spans if m.start() < o.start() < end]
        members, at = [], m.end()
        while kind != "enum" and (x := MEMBER.search(text, at, end - 1)):
            hole = next((e for a, e in inner if a <= x.start() < e), 0)
            if hole:
                at = hole
                continue
            if x[1] in NOT_TYPES or x[2] in NOT_TYPES:
                at = x.end()
                continue
            brace = text.find("{", x.start(2), x.end())
            stop = closing(text, brace) if brace >= 0 else text.find(";", x.end() - 1, end) + 1 or end
            is_call = "(" in x[3][:1]
            what = ("constructor" if x[2] == name else "method") if is_call else "property" if brace >= 0 or x[3] == "=>" else "field"
            if x[1] is None and what != "constructor":
                at = x.end()
                continue
            begin = x.start() + len(x[0]) - len(x[0].lstrip())
            members.append(Symbol(x[2], what, text[begin:stop], ".".join([*outer, name]), ns, line_at(text, begin), line_at(text, stop - 1)))
            if what in ("property", "field") and (ref := bare_type(x[1])) and ref not in PRIMITIVES:
                out.edges.append(Edge("USES_TYPE", own.fqn, ref))
            at = max(stop, x.end())
        if len(members) >= 2:
            out.symbols += members
            out.edges += [Edge("MEMBER_OF", s.fqn, own.fqn) for s in members]
        else:
            out.symbols.append(own)
    if not out.symbols:
        out.symbols = whole_file(text)
    return out


def python(text: str) -> Parsed:
    """A row a top-level class or function, and one a function inside a class."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return Parsed(whole_file(text))
    lines, out = text.split("\n"), Parsed()

    def add(node: ast.AST, parent: str | None) -> None:
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        s = Symbol(node.name, kind, "\n".join(lines[start - 1 : node.end_lineno]), parent, None, start, node.end_lineno)
        out.symbols.append(s)
        if parent:
            out.edges.append(Edge("MEMBER_OF", s.fqn, parent))

    for node in tree.body:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            add(node, None)
            if isinstance(node, ast.ClassDef):
                out.edges += [Edge("INHERITS", node.name, ast.unparse(b)) for b in node.bases]
                for sub in node.body:
                    if isinstance(sub, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                        add(sub, node.name)
    return out if out.symbols else Parsed(whole_file(text))


DECLARATION = re.compile(
    r"^(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:public\s+|private\s+|internal\s+|open\s+|abstract\s+|final\s+|static\s+|async\s+|suspend\s+|data\s+|sealed\s+|unsafe\s+|inline\s+)*"
    r"(class|interface|struct|enum|trait|impl|function|func|fun|fn|type|mod|object|protocol|extension|namespace|message|service)\b\s*(?:\([^)]*\)\s*)?(?:<[^>]*>\s*)?(\w+)?|^(?:export\s+)?(const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>|^[\w:*&<> \t]+?\b(\w+)\s*\([^;{}]*\)\s*\{",
    re.M,
)


def generic(text: str) -> Parsed:
    """Other languages with braces: a row a declaration at the margin; without any the whole file."""
    out, at = Parsed(), 0
    while m := DECLARATION.search(text, at):
        brace, stop = text.find("{", m.start()), text.find("\n", m.end())
        stop = len(text) if stop < 0 else stop
        end = closing(text, brace) if 0 <= brace <= stop + 1 else stop
        start = line_at(text, m.start())
        name = m[2] or m[4] or m[5] or f"line_{start}"
        out.symbols.append(Symbol(name, m[1] or ("function" if m[5] else m[3]), text[m.start() : end], None, None, start, line_at(text, max(m.start(), end - 1))))
        at = max(end, m.end())
    return out if out.symbols else Parsed(whole_file(text))


def sql(text: str) -> Parsed:
    """Batches between GO lines, else statements that create or alter."""
    parts = re.split(r"(?im)^\s*GO\s*;?\s*$\n?", text)
    if len([p for p in parts if p.strip()]) < 2:
        parts = re.split(r"(?im)(?=^\s*(?:CREATE|ALTER)\s)", text)
    out, line = Parsed(), 1
    for p in parts:
        if p.strip():
            m = re.search(r"(?i)\b(?:CREATE|ALTER)\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(\w+)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\[\]\"]+)", p)
            at = text.find(p)
            line = line_at(text, at) if at >= 0 else line
            out.symbols.append(Symbol(m[2] if m else f"line_{line}", m[1].lower() if m else "batch", p.strip(), None, None, line, line + p.rstrip().count("\n")))
    return out


class _Elements(HTMLParser):
    """Top-level elements of a template, or of its body: (tag, attributes, start, end)."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.starts = text, [0]
        for line in text.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.open: list[tuple[str, dict, int]] = []
        self.found: list[tuple[str, dict, int, int]] = []
        self.feed(text)
        self.close()
        self.found += [(t, a, s, len(text)) for t, a, s in self.open if not any(s > o[2] for o in self.open[:1])][:1] if self.open else []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        at = self._at()
        if tag in ("html", "body", "head"):
            return
        if tag in self.VOID:
            if not self.open:
                self.found.append((tag, dict(attrs), at, at + len(self.get_starttag_text() or "")))
            return
        self.open.append((tag, dict(attrs), at))

    def handle_startendtag(self, tag, attrs):
        if not self.open:
            at = self._at()
            self.found.append((tag, dict(attrs), at, at + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                _, attrs, start = self.open[k]
                del self.open[k:]
                if not self.open:
                    end = self.text.find(">", self._at()) + 1 or len(self.text)
                    self.found.append((tag, attrs, start, end))
                return


def html_template(text: str) -> Parsed:
    """Leading directives, scripts by their declarations, styles, and a row a top-level element named by id or class."""
    out = Parsed()
    m = re.match(r"(?:\s*(?:@(?:page|model|using|inject|inherits|layout|namespace|attribute|implements)\b[^\n]*|<%@[^%]*%>|<#--.*?-->)\s*\n?)+", text)
    if m and m[0].strip():
        out.symbols.append(Symbol("directives", "directive", m[0].strip(), None, None, 1, line_at(text, m.end() - 1)))
    for tag, attrs, start, end in sorted(_Elements(text).found, key=lambda x: x[2]):
        body, line = text[start:end], line_at(text, start)
        last = line_at(text, max(start, end - 1))
        if tag == "script":
            inner = re.sub(r"^<script[^>]*>|</script\s*>$", "", body, flags=re.I)
            rows = [s for s in generic(inner).symbols if s.node_type != "file"]
            shift = line - 1 + body[: body.find(">") + 1].count("\n")
            out.symbols += [Symbol(f"script:{s.name}", s.node_type, s.content, "script", None, s.start_line + shift, s.end_line + shift) for s in rows] or [Symbol("script", "script", body, None, None, line, last)]
        elif tag == "style":
            out.symbols.append(Symbol("style", "style", body, None, None, line, last))
        elif body.strip():
            css = (attrs.get("class") or "").split()
            name = f"{tag}#{attrs['id']}" if attrs.get("id") else f"{tag}.{css[0]}" if css else tag
            out.symbols.append(Symbol(name, "element", body, None, None, line, last))
    return out if out.symbols else Parsed(whole_file(text))


TEMPLATES = frozenset(".html .htm .cshtml .razor .vue .svelte .erb .ejs .jsp .ftl .twig .njk .hbs .mustache".split())


def parse(path: str, text: str) -> Parsed:
    """By the path's extension."""
    dot = path.rsplit("/", 1)[-1].rfind(".")
    ext = path.rsplit("/", 1)[-1][dot:].lower() if dot >= 0 else ""
    if not text.strip():
        return Parsed()
    if ext in (".md", ".markdown"):
        return markdown(text)
    if ext in (".yaml", ".yml"):
        return yaml(text)
    if ext == ".py":
        return python(text)
    if ext in (".cs", ".java"):
        return braces(text, ext[1:], path)
    if ext == ".sql":
        return sql(text)
    if ext in TEMPLATES:
        return html_template(text)
    if ext in (".txt", ".json", ".xml", ".properties", ".config", ".sh", ".ps1", ".bat", ""):
        return Parsed(whole_file(text))
    return generic(text)


# Chunks of bounded size

BOUNDARIES = {
    ".py": r"\n(?=(?:async\s+def|def|class)\s)", ".yaml": r"\n(?=\S)", ".yml": r"\n(?=\S)", ".md": r"\n(?=##\s+)", ".sql": r"(?im)^\s*GO\s*$",
    ".cs": r"\n(?=\s*(?:public|private|protected|internal)\s)", ".java": r"\n(?=\s*(?:public|private|protected)\s)",
    ".js": r"\n(?=(?:export|function|class|const)\s)", ".ts": r"\n(?=(?:export|function|class|const|interface)\s)",
}


def forced(text: str, limit: int, overlap: int) -> list[str]:
    """Windows of the limit that overlap, up to the first that reaches the end."""
    size, step, out = limit * 4, max(1, limit - overlap) * 4, []
    for at in range(0, len(text), step):
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
    return out


def bounded_chunks(path: str, text: str, limit: int, overlap: int = 50) -> list[str]:
    """A file's chunks of at most limit tokens: whole if it fits, else packed between its kind's boundaries."""
    if not text.strip():
        return []
    if tokens(text) <= limit:
        return [f"// File: {path}\n{text}"]
    dot = path.rsplit("/", 1)[-1].rfind(".")
    pattern = BOUNDARIES.get(path.rsplit("/", 1)[-1][dot:].lower() if dot >= 0 else "", r"\n\n")
    glue = "\n\n" if pattern == r"\n\n" else "\n"
    out, own = [], ""
    for p in re.split(pattern, text):
        joined = own + glue + p if own else p
        if tokens(joined) <= limit:
            own = joined
            continue
        if own.strip():
            out.append(own)
        own = p
        if tokens(p) > limit:
            out += forced(p, limit, min(overlap, limit // 2))
            own = ""
    return [*out, own] if own.strip() else out
