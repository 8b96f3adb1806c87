"""Main text of web pages by a conditional random field over leaf blocks.

A tolerant reader turns a page into its leaf blocks: the text between two boundaries of block
elements, with the elements around it. A linear-chain field says of each block, in page order,
whether it is main text, from its ancestors' tags and class words, its own tag, its length, its
share of links and its punctuation, and from what the block before is. Weights are learned in
numpy, by gradient steps on the log likelihood, from labelled pages that ``labelled_page``
writes in many layouts; Viterbi decodes.

Defined results: null and empty pages, and pages without main text, give the empty string;
broken markup is read as far as it goes (elements that aren't closed end with their parents, a
``<`` that opens no tag is text), in time that follows its length; very long pages are read whole;
of two equally likely states a block is not main text; repeated rows are extracted alike; a
column ``text`` of the input is replaced and ``html`` left out; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kelpie.llm.common import tidy

OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/<>]*+))")
STOPS = re.compile(r"[>\"']")
#: Open block elements that are told apart; deeper ones count as their ancestor at this depth.
DEPTH = 50
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LABEL = re.compile(r'data-main="1"')
LONG_REFERENCE = re.compile(r"&#([0-9]{8,})")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("script style noscript template svg math object canvas textarea title".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: What an opening tag closes: the innermost such element, up to an element that holds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
WORDS = {
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner billboard outbrain taboola",
    "comment": "comment comments commentlist commenter reply replies respond discussion disqus responses thread",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager skip toc tabs topbar",
    "header": "header masthead site logo branding",
    "footer": "footer copyright legal colophon bottom credits",
    "sidebar": "sidebar side aside widget rail related recommended popular trending more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner message warning disclaimer privacy",
    "form": "form signup subscribe subscription newsletter login search contact register",
    "social": "share sharing social follow tags meta byline",
    "main": "content article post entry story main body text page copy prose",
}
GROUP = {w: g for g, ws in WORDS.items() for w in ws.split()}
TAGS = frozenset("article main section nav header footer aside form ul ol table figure figcaption blockquote dl button label select fieldset dialog details".split())


def decoded(raw: str) -> str:
    """Character references decoded; decimal numbers beyond Unicode, of any length, are U+FFFD."""

    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0") or "0"
        return f"&#{digits}" if len(digits) < 8 else "&#9999999"

    return unescape(LONG_REFERENCE.sub(short, raw)) if "&" in raw else raw


@dataclass
class Leaf:
    text: str
    stack: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int
    label: int


def groups_of(attributes: str) -> tuple[str, ...]:
    """Groups of the class, id and role words."""
    if not attributes:
        return ()
    found = {GROUP[w] for m in NAMES.finditer(attributes) for part in PART.findall(m[1] or m[2] or m[3] or "") if (w := part.lower()) in GROUP}
    return tuple(sorted(found - {"main"} or found))  # "comment-body" is no body


class Ends:
    """Where tags end: the first ``>`` outside quotes or, where quotes don't close, the first one.

    What follows a place outside quotes is looked at once, so that all tags of a page together
    take time in proportion to its length.
    """

    def __init__(self, html: str):
        self.at = [m.start() for m in STOPS.finditer(html)]
        self.sign = [html[k] for k in self.at]
        # of each sign the next one that is equal, by its number
        after, last = [0] * len(self.at), {}
        for k in range(len(self.at) - 1, -1, -1):
            after[k] = last.get(self.sign[k], -1)
            last[self.sign[k]] = k
        self.after, self.known = after, {}
        self.next_end, end = [0] * (len(self.at) + 1), -1
        self.next_end[-1] = -1
        for k in range(len(self.at) - 1, -1, -1):
            end = k if self.sign[k] == ">" else end
            self.next_end[k] = end

    def __call__(self, place: int) -> int:
        """The place of the tag's end, or -1."""
        first = k = bisect_left(self.at, place)
        path = []
        while True:
            if k in self.known:
                found = self.known[k]
                break
            path.append(k)
            if k >= len(self.at):
                found = -1
                break
            if self.sign[k] == ">":
                found = k
                break
            if self.after[k] < 0:
                found = -1
                break
            k = self.after[k] + 1
        for x in path:
            self.known[x] = found
        found = found if found >= 0 else self.next_end[first]
        return self.at[found] if found >= 0 else -1


def markup(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, tag, whether it closes, attributes) of tags, and of comments and declarations without a tag.

    The receiver may send the place from which to go on.
    """
    ends, at = Ends(html), 0
    while m := OPENS.search(html, at):
        begin, tag = m.start(), m[2]
        if tag:
            end = ends(m.end())
        elif m[0] == "<!--":
            end = html.find("-->", m.end())
            end = len(html) - 1 if end < 0 else end + 2
        else:
            end = html.find(">", m.end())
        if end < 0:  # no sign ends anything any more; what begins a comment runs to the end
            begin = html.find("<!--", m.end())
            if begin >= 0:
                yield begin, len(html), "", False, ""
            return
        at = (yield begin, end + 1, (tag or "").lower(), bool(m[1]), html[m.end() : end] if tag else "") or end + 1


def leaves(html: str | None) -> list[Leaf]:
    """Leaf blocks in page order."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    marks: list[int] = []  # how deep each labelled element lies
    chunks: list[str] = []
    linked, in_link, at, beyond = 0, False, 0, 0
    html = html or ""

    def flush() -> None:
        nonlocal linked
        if chunks:
            text = " ".join("".join(chunks).split())
            chunks.clear()
            if text:
                out.append(Leaf(text, tuple(stack), min(linked, len(text)), int(bool(marks))))
        linked = 0

    def pop(to: int) -> None:
        nonlocal beyond
        del stack[to:]
        beyond = 0
        while marks and marks[-1] > to:
            marks.pop()

    def add(raw: str) -> None:
        nonlocal linked
        text = decoded(raw)
        chunks.append(text)
        if in_link:
            linked += len(text.strip())

    reader = markup(html)
    token = next(reader, None)
    while token:
        begin, end, tag, closing, attributes = token
        if begin > at:
            add(html[at:begin])
        at = end
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                last = re.compile(rf"</{tag}\s*>?", re.I).search(html, at)
                at = last.end() if last else len(html)
        elif tag == "a":
            in_link = not closing
        elif tag in ("br", "img", "input"):
            chunks.append(" ")
        elif tag in BLOCKS:
            flush()
            in_link = False
            same = HEADINGS if tag in HEADINGS else (tag,)
            if tag in VOID:
                pass
            elif closing:
                if beyond:
                    beyond -= 1
                else:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in same:
                            pop(k)
                            break
            else:
                if stack and (stack[-1][0] == "p" or tag in HEADINGS and stack[-1][0] in HEADINGS):
                    pop(len(stack) - 1)
                if tag in CLOSES:
                    own, holders = CLOSES[tag]
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in own:
                            pop(k)
                            break
                        if stack[k][0] in holders:
                            break
                if tag == "body":
                    pop(0)
                if len(stack) >= DEPTH:
                    beyond += 1
                else:
                    stack.append((tag, groups_of(attributes)))
                    if attributes and LABEL.search(attributes):
                        marks.append(len(stack))
        try:
            token = reader.send(at)
        except StopIteration:
            token = None
    if at < len(html):
        add(html[at:])
    flush()
    return [x for x in out if not any(t == "head" for t, _ in x.stack[:3])]


def stack_features(stack: tuple) -> list[str]:
    tags = {t for t, _ in stack}
    groups = {g for _, gs in stack for g in gs}
    out = [f"in:{t}" for t in sorted(tags & TAGS)] + [f"of:{g}" for g in sorted(groups)]
    out += [f"own:{stack[-1][0]}" if stack else "own:none"]
    # the innermost element that says anything
    for t, gs in reversed(stack):
        if gs or t in ("nav", "header", "footer", "aside", "form", "article", "main"):
            near = gs or (t,)
            inside = "inside" if tags & {"article", "main"} or "main" in groups else "outside"
            out += [f"near:{g}" for g in near] + [f"near:{g}:{inside}" for g in near]
            break
    if not groups and not tags & {"article", "main", "nav", "header", "footer", "aside", "form"}:
        out.append("bare")
    return out


def text_features(x: Leaf) -> list[str]:
    n = len(x.text)
    links = x.linked / n
    stops = sum(x.text.count(c) for c in ".,;:!?")
    linked = 0 if not x.linked else 1 if links < 0.3 else 2 if links < 0.8 else 3
    own = x.stack[-1][0] if x.stack else "none"
    out = [f"size:{min(6, n.bit_length() // 2)}", f"links:{linked}", f"links:{linked}:{own}", f"stops:{min(4, stops)}"]
    if x.text[0] in "©|»›":
        out.append("sign")
    if "©" in x.text:
        out.append("copyright")
    return out


@dataclass
class Field:
    """Weights by feature for main against other text, start and transition scores; states: 0 other, 1 main."""

    weight: dict[str, float] = field(default_factory=dict)
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self):
        self.by_stack: dict[tuple, float] = {}

    def emission(self, x: Leaf) -> float:
        s = self.by_stack.get(x.stack)
        if s is None:
            if len(self.by_stack) > 50_000:
                self.by_stack.clear()
            s = self.by_stack[x.stack] = sum(self.weight.get(f, 0.0) for f in stack_features(x.stack))
        return s + sum(self.weight.get(f, 0.0) for f in text_features(x))

    def decode(self, blocks: list[Leaf]) -> list[int]:
        """The likeliest states, by Viterbi."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.move.tolist()
        v0, v1 = self.start.tolist()
        back = []
        for k, x in enumerate(blocks):
            if k:
                from0, from1 = v1 + ba > v0 + aa, v1 + bb > v0 + ab
                v0, v1 = max(v0 + aa, v1 + ba), max(v0 + ab, v1 + bb)
                back.append((int(from0), int(from1)))
            v1 += self.emission(x)
        out = [int(v1 > v0)]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]

    def extract(self, html: str | None) -> str:
        blocks = leaves(html)
        return "\n".join(x.text for x, y in zip(blocks, self.decode(blocks), strict=True) if y)


def train(pages: list[str], epochs: int = 12, rate: float = 0.3, ridge: float = 1e-4, seed: int = 1) -> Field:
    """Adagrad on the conditional log likelihood, a page at a time, by the forward-backward algorithm."""
    data = []
    index: dict[str, int] = {}
    for p in pages:
        blocks = leaves(p)
        if blocks:
            data.append(([[index.setdefault(f, len(index)) for f in stack_features(x.stack) + text_features(x)] for x in blocks], np.array([x.label for x in blocks])))
    w, start, move = np.zeros(len(index)), np.zeros(2), np.zeros((2, 2))
    g_w, g_start, g_move = np.full(len(index), 1e-6), np.full(2, 1e-6), np.full((2, 2), 1e-6)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for features, y in data:
            n = len(y)
            e = np.zeros((n, 2))
            e[:, 1] = [w[f].sum() for f in features]
            a, b = np.zeros((n, 2)), np.zeros((n, 2))
            a[0] = start + e[0]
            for k in range(1, n):
                a[k] = np.logaddexp(a[k - 1, 0] + move[0], a[k - 1, 1] + move[1]) + e[k]
            for k in range(n - 2, -1, -1):
                b[k] = np.logaddexp(move[:, 0] + e[k + 1, 0] + b[k + 1, 0], move[:, 1] + e[k + 1, 1] + b[k + 1, 1])
            z = np.logaddexp(*a[-1])
            p = np.exp(a + b - z)
            d = y - p[:, 1]
            grad = np.zeros(len(w))
            for f, x in zip(features, d, strict=True):
                grad[f] += x
            grad -= ridge * w
            d_start = np.eye(2)[y[0]] - p[0]
            d_move = np.zeros((2, 2))
            if n > 1:
                np.add.at(d_move, (y[:-1], y[1:]), 1)
                pair = np.exp(a[:-1, :, None] + move[None] + (e[1:] + b[1:])[:, None, :] - z)
                d_move -= pair.sum(0)
            for x, g, d_x in ((w, g_w, grad), (start, g_start, d_start), (move, g_move, d_move)):
                g += d_x**2
                x += rate * d_x / np.sqrt(g)
    return Field({f: float(w[k]) for f, k in index.items()}, start, move)


def labelled_page(seed: int) -> str:
    """A page in a random layout; elements of its main text carry data-main="1"."""
    rng = random.Random(seed)
    letters = "aeiounrtlsdhmpkäöéñçб日"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    pick = rng.choice

    def text(lo: int, hi: int) -> str:
        ws = [word() + pick(["", "", "", "", "", ",", "."]) for _ in range(rng.randint(lo, hi))]
        return " ".join(ws).capitalize() + pick([".", ".", "", "!", "?", ""])

    def links(lo: int, hi: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{word()}">{text(1, 3)}</a></{wrap}>' for _ in range(rng.randint(lo, hi)))

    def boxed(tags: list[str], names: list[str], inner: str) -> str:
        tag, name = pick(tags), pick(names)
        where = pick(["class", "id"])
        return f'<{tag}{f' {where}="{name}"' if name else ""}>{inner}</{tag}>'

    def junk() -> str:
        return pick(
            [
                lambda: boxed(["div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"], pick(["", "<p>"]) + text(2, 40)),
                lambda: boxed(["div", "aside"], ["related", "more-stories", "recommended"], f"<h3>{text(1, 4)}</h3><ul>{links(2, 6)}</ul>"),
                lambda: boxed(["div", "ul", "p"], ["share", "social-links", "tags"], links(2, 5, "span")),
                lambda: boxed(["form", "div"], ["newsletter", "signup-form", "subscribe"], f"<label>{text(1, 6)}</label><input name=x><button>{text(1, 2)}</button>"),
                lambda: boxed(["div", "aside"], ["cookie-notice", "consent", "alert", "notice"], f"<p>{text(4, 40)}</p><button>{text(1, 2)}</button>"),
            ]
        )()

    def main() -> str:
        parts, mark = [], ' data-main="1"'
        if rng.random() < 0.85:
            parts.append(f"<h1{mark}>{text(2, 14)}</h1>")
        if rng.random() < 0.25:
            parts.append(f'<div class="byline meta">{text(2, 5)}</div>')
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.62:
                p = text(1, 120)
                if rng.random() < 0.3:
                    p = p.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
                if rng.random() < 0.2:
                    p = f"<b>{p}" if rng.random() < 0.5 else f"<em>{p}</em><br>{text(2, 30)}"
                parts.append(f"<p{mark}>{p}" + pick(["</p>", "</p>", ""]))
            elif r < 0.7:
                parts.append(f"<h{pick('234')}{mark}>{text(1, 8)}</h2>")
            elif r < 0.76:
                tag = pick(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li{mark}>{text(1, 25)}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>")
            elif r < 0.8:
                parts.append(f"<blockquote{mark}>{text(5, 40)}</blockquote>")
            elif r < 0.83:
                parts.append(f"<figure><img src=x><figcaption{mark}>{text(2, 15)}</figcaption></figure>")
            elif r < 0.86:
                parts.append("<table>" + "".join(f"<tr><td{mark}>{text(1, 4)}</td><td{mark}>{text(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.9:
                own = pick(["pre", "div"])
                parts.append(f"<{own}{mark}>{text(3, 60)}</{own}>")
            else:
                parts.append(junk())
        return "\n".join(parts)

    def comments() -> str:
        one = lambda: boxed(["li", "div", "article"], ["comment", "comment-body", "reply"], f"<h4>{text(1, 3)}</h4><p>{text(1, 60)}</p>")
        return boxed(["section", "div", "ol"], ["comments", "comment-list", "disqus_thread", "responses"], f"<h3>{text(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))))

    tag, name = pick([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "post"), ("section", "story"), ("div", ""), ("div", ""), ("td", "")])
    article = f'<{tag}{f' class="{name}"' if name else ""}>{main()}{comments() if rng.random() < 0.15 else ""}</{tag}>'
    if tag == "td":
        article = f"<table><tr>{article}</tr></table>"
    top, bottom = [], []
    if rng.random() < 0.9:
        top.append(boxed(["nav", "nav", "ul", "div"], ["", "menu", "nav", "main-menu", "breadcrumb"], f"<ul>{links(2, 8)}</ul>"))
    if rng.random() < 0.6:
        top.append(boxed(["header", "div"], ["", "header", "masthead", "site-header"], pick([f"<h1>{text(1, 4)}</h1><p>{text(1, 8)}</p>", f"<a href=/>{text(1, 3)}</a>", text(1, 10)])))
        if "<div>" in top[-1]:
            top[-1] = top[-1].replace("<div>", '<div class="header">', 1)
    # bars of links whose names tell nothing
    bar = lambda: boxed(["div", "div", "p"], ["", "", word(), word()], pick([" | ", " ", " &middot; ", "&nbsp;"]).join(f'<a href="/{word()}">{text(1, 2)}</a>' for _ in range(rng.randint(2, 7))))
    top += [bar() for _ in range(rng.randint(0, 1))]
    top += [junk() for _ in range(rng.randint(0, 3))]
    side = boxed(["aside", "aside", "div"], ["sidebar", "widget", "side"], f"<h3>{text(1, 3)}</h3>" + pick([f"<ul>{links(2, 8)}</ul>", f"<p>{text(3, 40)}</p>"])) if rng.random() < 0.5 else ""
    if rng.random() < 0.4:
        bottom.append(comments())
    bottom += [junk() for _ in range(rng.randint(0, 2))]
    bottom += [bar() for _ in range(rng.randint(0, 1))]
    if rng.random() < 0.9:
        bottom.append(boxed(["footer", "footer", "div"], ["", "footer", "site-footer", "copyright"], pick(["&copy; ", "&copy; ", ""]) + f"{word()}.example {pick(['&middot; ', '| ', ''])}{text(1, 20)}" + pick(["", f"<ul>{links(1, 5)}</ul>"])))
        if bottom[-1].startswith("<div>"):
            bottom[-1] = bottom[-1].replace("<div>", '<div class="footer">', 1)
    rng.shuffle(top)
    middle = [side, article] if rng.random() < 0.3 else [article, side]
    script = f'<script>var t="</p>";f({seed})</script><style>p{{margin:0}}</style>'
    return f"<!DOCTYPE html><html><head><title>{text(2, 9)}</title>{script}</head><body>{''.join(top)}<!-- {word()} -->{''.join(middle)}{''.join(bottom)}</body></html>"


#: Labelled pages that training sees.
PAGES = 700


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train([labelled_page(k) for k in range(PAGES)])


def extract_text(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """Add text to the pages; html itself is left out."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_field())
    names = [x for x in pages.columns if x not in ("html", "text")]
    schema = pages.select(*names).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(texts, pa.string())], [*names, "text"])

    return pages.mapInArrow(tidy(run), schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).selectExpr("page_id", "url", "text", "cast(length(text) as long) AS n_chars")
