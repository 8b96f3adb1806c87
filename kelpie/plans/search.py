"""Building queries, budgets and stop rules, and the search loop, with offline defaults for models."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.functions.text import CAUSAL_VERBS, keyword_variants
from kelpie.operators import evidence, graph, retrieval
from kelpie.plans.index import Index
from kelpie.sources.store import stored
from kelpie.sources.trace import Trace


@dataclass
class Intent:
    query: str
    purpose: str = ""
    query_type: str = ""
    operator: str = "hybrid"
    filters: dict | None = None


@dataclass
class Need:
    need: str
    accept: list[str] = field(default_factory=list)
    priority: str = "normal"


@dataclass
class Built:
    query: str
    operator: str
    filters: dict


CODE = {"category": ["source-code"]}
# Query templates; {class} and {method} come from the keyword's last point.
TEMPLATES = {
    "entry_point": {
        "patterns": ['"{keyword}" handler', '"on{Pascal}" OR "handle{Pascal}"', '"{keyword}Handler" OR "{keyword}Service"'],
        "annotations": ["@EventListener", "@Scheduled", "@KafkaListener", "@RabbitListener", "@PostMapping", "@GetMapping", "@HttpPost", "@HttpGet", "[HttpPost]", "[HttpGet]", "[Route]"],
        "operator": "hybrid", "filters": CODE,
    },
    "timeout_config": {
        "patterns": ["(timeout OR ttl OR deadline OR interval) AND (config OR properties)", '"{keyword}" AND (timeout OR delay OR retry)', "TimeSpan OR TimeoutMs OR TimeoutSeconds"],
        "operator": "keyword", "filters": {"category": ["configuration", "source-code"]},
    },
    "state_machine": {
        "patterns": ['(enum OR status OR state) AND "{keyword}"', '"{keyword}Status" OR "{keyword}State"', 'transition AND "{keyword}"', "UpdateStatus OR ChangeState OR SetState"],
        "operator": "hybrid", "filters": {},
    },
    "callsite": {"patterns": ['"{class}.{method}"', '"{class}#{method}"', '"{class}::{method}"', '"{method}("', "await {method}", ".{method}("], "operator": "exact", "filters": CODE},
    "database": {
        "patterns": ["sp{Pascal} OR tbl{Pascal}", '"{keyword}" AND (SELECT OR UPDATE OR INSERT OR EXEC)', "FROM {keyword} OR JOIN {keyword}", "PROCEDURE.*{keyword}"],
        "operator": "keyword", "filters": {"category": ["database", "source-code"]},
    },
    "config_key": {"patterns": ['"{keyword}"', 'Configuration["{keyword}"]', '@Value("${keyword}")', 'appsettings.*"{keyword}"'], "operator": "exact", "filters": {"category": ["configuration", "source-code"]}},
    "error_handling": {"patterns": ['(catch OR exception OR error) AND "{keyword}"', "try.*{keyword}.*catch", '"{keyword}Exception" OR "{keyword}Error"'], "operator": "hybrid", "filters": CODE},
}
EMPTY = {"", '""', "''", "()", "AND", "OR"}
NOT_METHODS = {"if", "while", "for", "switch", "catch", "return", "throw"}


def fill(pattern: str, keyword: str, **more: str) -> str | None:
    """A pattern with its places filled; None if nothing is left to look for."""
    v = keyword_variants(keyword)
    owner, _, method = keyword.rpartition(".")
    places = {"keyword": v["original"], "Keyword": v["camel"], "Pascal": v["pascal"], "KEYWORD": v["upper"], "snake": v["snake"], "class": owner, "method": method} | more
    if "{class}" in pattern and not places["class"]:
        return None
    out = " ".join(re.sub(r"\{(\w*)\}", lambda m: places.get(m[1], ""), pattern).split())
    return None if out in EMPTY or not re.search(r"\w", out) else out


def build(intent: Intent) -> list[Built]:
    """The queries an intent stands for; semantic intents run as hybrid ones."""
    own = intent.filters or {}
    if intent.operator == "callsite":
        return [Built(q, "exact", intent.filters or CODE) for p in TEMPLATES["callsite"]["patterns"] if (q := fill(p, intent.query))]
    if intent.operator == "symbol_ref":
        pascal = keyword_variants(intent.query)["pascal"]
        return [Built(f'"{q}"', "exact", own) for q in dict.fromkeys([intent.query, pascal])]
    return [Built(intent.query, intent.operator if intent.operator in ("exact", "keyword") else "hybrid", own)]


def build_from_template(name: str, keyword: str, **more: str) -> list[Built]:
    t = TEMPLATES.get(name)
    if t is None:
        return [Built(keyword, "semantic", {})]
    out = [Built(q, t["operator"], t["filters"]) for p in t["patterns"] if (q := fill(p, keyword, **more))]
    return out + [Built(f'{a} AND "{keyword}"', "keyword", CODE) for a in t.get("annotations", ())]


def fallback_intents(cards: DataFrame, needs: Sequence[Need], limit: int = 5) -> list[Intent]:
    """Neighbours of what is known: methods that the first ten cards call, their config keys, and what needs hint at."""
    rows = cards.orderBy(F.desc("score_rerank"), "ord").limit(10).select("snippet", "entities").collect()
    out: dict[str, Intent] = {}
    for r in rows:
        for m in re.findall(r"\b(\w{4,})\s*\(", r["snippet"] or ""):
            if m.lower() not in NOT_METHODS:
                out.setdefault(m, Intent(f"{m}(", f"find callsites of {m}", "callsite", "exact"))
    for r in rows:
        for k in r["entities"]["config_keys"][:2]:
            out.setdefault(k, Intent(k, f"find config usage of {k}", "config", "exact"))
    hints = (("timeout", ("timeout",), "timeout config default value", "config"), ("state", ("state", "enum"), "enum Status transition update", "symbol"), ("entry", ("entry",), "handler endpoint controller", "symbol"))
    for need in needs:
        for key, words, q, kind in hints:
            if any(w in need.need.lower() for w in words):
                out.setdefault(key, Intent(q, f"find {key}", kind, "semantic"))
    return list(out.values())[:limit]


@dataclass
class Budget:
    max_iterations: int = 5
    max_tokens: int = 210_000


@dataclass
class State:
    query: str
    iteration: int = 0
    tokens: int = 0
    no_new: int = 0
    fallback: bool = False
    needs: list[Need] = field(default_factory=list)


def should_stop(state: State, pool: DataFrame, budget: Budget) -> tuple[bool, str]:
    """Budget; all needs met and the gate passed; two rounds without anything new."""
    if state.iteration >= budget.max_iterations:
        return True, "max_iterations_reached"
    if state.tokens >= budget.max_tokens:
        return True, "token_budget_exceeded"
    met = not state.needs or evidence.accept_coverage(pool, {n.need: n.accept for n in state.needs}).filter("NOT satisfied").isEmpty()
    if met and evidence.quality_gate(pool).first()["passed"]:
        return True, "all_evidence_found_and_quality_passed"
    if state.no_new == 1 and not state.fallback:
        return False, "triggering_fallback"
    return (True, "stuck_after_fallback") if state.no_new >= 2 else (False, "")


class Planner(Protocol):
    """A language model, or rules: what to look for next, and an answer from the cards."""

    def plan(self, state: State, summary: str) -> tuple[list[Intent], list[Need], bool]: ...

    def answer(self, query: str, cards: list[dict]) -> dict: ...


class RulePlanner:
    """Offline: the query itself first, identifiers exactly; then what fallbacks bring. Answers by the best cards."""

    def plan(self, state: State, summary: str) -> tuple[list[Intent], list[Need], bool]:
        if state.iteration:
            return [], state.needs, False
        names = [w for w in re.findall(r"[A-Za-z_][\w.]*", state.query) if re.search(r"[a-z][A-Z]|_|\.", w)]
        return [Intent(state.query), *(Intent(w, "identifier", "symbol", "exact") for w in dict.fromkeys(names))], [], False

    def answer(self, query: str, cards: list[dict]) -> dict:
        return {"answer": "\n".join(c["snippet"] for c in cards[:5]), "evidence": [{"id": c["id"], "path": c["path"]} for c in cards[:10]]}


def extract_json(text: str) -> dict | None:
    """The object in a model's reply, without its thoughts and the prose around it."""
    text = re.sub(r"<think>.*?</think>", "", text, flags=re.S)
    a, z = text.find("{"), text.rfind("}")
    try:
        out = json.loads(text[a : z + 1]) if 0 <= a < z else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


class Ensemble:
    """Several analysts' views merged in their fixed order; those that fail are passed over."""

    def __init__(self, analysts: Sequence):
        self.analysts = analysts

    def __call__(self, query: str, summary: str) -> dict:
        views = []
        for a in self.analysts:
            try:
                views.append(a(query, summary))
            except Exception:  # an analyst's fault costs its view alone
                continue
        once = lambda k: list(dict.fromkeys(x for v in views for x in v.get(k, ())))
        actors = {x["name"]: x for v in reversed(views) for x in reversed(v.get("actors", []))}
        return {"subject": next((v["subject"] for v in views if v.get("subject")), ""), "actors": list(actors.values())[::-1], "covered": once("covered"), "gaps": once("gaps"), "reasoning": " | ".join(v["reasoning"] for v in views if v.get("reasoning"))}


@dataclass
class Result:
    success: bool
    answer: dict
    cards: list[dict]
    iterations: int
    reason: str
    search_id: str


def unsupported(statements: Sequence[str]) -> list[str]:
    """Statements that name no cause or action: an answer's steps that need more evidence."""
    return [s for s in statements if not any(v in s.lower() for v in CAUSAL_VERBS)]


def to_markdown(result: Result, most: int = 10) -> str:
    """An answer, its evidence and how it was found."""
    lines = ["## Answer", str(result.answer.get("answer", "")).strip() or "Nothing found.", "", "## Evidence"]
    lines += [f"- `{c['path']}` ({c['span']}, {c['source_kind']}, {c['score_rerank']:.2f}): {c['snippet']}" for c in result.cards[:most]]
    return "\n".join([*lines, "", f"_{result.iterations} rounds, {len(result.cards)} cards, {result.reason or 'ended'}_"])


POOL = "id string, path string, chunk_text string, score_rerank double, chunk_index int, total_chunks int, ord long, fingerprint string, snippet string, tags array<string>, source_kind string, entities struct<config_keys:array<string>,enums:array<string>,constants:array<string>>, span string, round_found int"


def run(index: Index, query: str, planner: Planner | None = None, budget: Budget | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, trace: Trace | None = None, top_n: int = 100, keep: int = 20) -> Result:
    """Rounds of planning, searching and judging until a stop rule holds.

    The pool has at most 200 rows and is written to the shared folder each round.
    """
    spark, planner, budget, trace = index.spark, planner or RulePlanner(), budget or Budget(), trace or Trace(None)
    state, search_id, reason = State(query), uuid.uuid4().hex[:12], ""
    pool = spark.createDataFrame([], POOL)
    trace(search_id, "start", query=query)
    while True:
        summary = "\n".join(r["line"] for r in evidence.planner_summary(evidence.working_set(pool).withColumn("symbol", F.lit(None).cast("string"))).orderBy("rank").collect())
        intents, state.needs, stop = planner.plan(state, summary)
        state.tokens += len(summary) // 4
        if stop:
            reason = "planner_stop"
            break
        if state.no_new == 1 and not state.fallback:
            intents, state.fallback = intents + fallback_intents(pool, state.needs), True
        built = [b for i in intents for b in build(i)]
        n_new = 0
        if built:
            hits = index.batch([(b.query, b.operator, b.filters) for b in built], retrieval.quota(top_n, len(built)))
            best = retrieval.simple_rerank(hits, query, "content", m=keep, key="chunk_id")
            rows = best.select(F.col("chunk_id").alias("id"), F.col("file_path").alias("path"), F.col("content").alias("chunk_text"), "score_rerank", "chunk_index", "total_chunks")
            incoming = stored(evidence.cards(rows.withColumn("ord", F.lit(1000 * state.iteration).cast("long") + F.monotonically_increasing_id() % 1000), state.iteration).select(*[x.split()[0] for x in POOL.split(", ")]), "incoming")
            if nodes is not None and edges is not None:
                named = graph.card_symbols(incoming.withColumn("symbol", F.lit(None).cast("string")))
                chunks = index.chunks().select(F.col("file_path").alias("path"), F.col("chunk_id").alias("id"), F.col("content").alias("chunk_text"), "chunk_index", "total_chunks")
                more = graph.expand(named, nodes, edges, chunks, incoming.select("path")).withColumns({"score_rerank": F.lit(0.0), "ord": F.lit(1000 * state.iteration + 999).cast("long")}).drop("hits")
                incoming = stored(incoming.unionByName(evidence.cards(more, state.iteration).select(*incoming.columns)), "incoming")
            n_new = evidence.new_cards(pool, incoming).count()
            pool = evidence.upsert(pool.unionByName(incoming))
            pool = stored(evidence.evict(stored(pool, "pool"), state.iteration).drop("evict_score").select(*incoming.columns), "pool")
        state.no_new = 0 if n_new else state.no_new + 1
        if n_new:
            state.fallback = False
        state.iteration += 1
        trace(search_id, "round", iteration=state.iteration, queries=len(built), new=n_new)
        stop, reason = should_stop(state, pool, budget)
        if stop:
            break
    cards = [r.asDict(recursive=True) for r in pool.orderBy(F.desc("score_rerank"), "ord").limit(30).collect()]
    trace(search_id, "end", reason=reason, cards=len(cards))
    return Result(True, planner.answer(query, cards), cards, state.iteration, reason, search_id)
