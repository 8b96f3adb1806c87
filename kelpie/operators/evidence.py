"""The evidence pool: cards, upserts, eviction, diversity, gates.

A pool is a DataFrame of cards (fingerprint, id, path, chunk_text, tags, source_kind, entities,
score_rerank, round_found, ord); what a sequential pool would do one card after another is
expressed as windows over the whole round.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions import paths, text

WEIGHTS = {"score": 1.0, "recency": 0.2, "kind": 0.2, "tag": 0.15}


def cards(hits: DataFrame, round_found: int) -> DataFrame:
    """Cards from hits (id, path, chunk_text, score, score_rerank, chunk_index, total_chunks); empty texts make none."""
    own = hits.filter(F.length(F.trim(F.coalesce("chunk_text", F.lit("")))) > 0)
    return own.withColumns(
        {
            "fingerprint": text.fingerprint("chunk_text", "id", "path"),
            "snippet": text.snippet("chunk_text"),
            "tags": text.tags("chunk_text", "path"),
            "source_kind": text.source_kind("path"),
            "entities": text.named_entities("chunk_text"),
            "span": F.format_string("chunk %d/%d", F.col("chunk_index") + 1, F.col("total_chunks")),
            "round_found": F.lit(round_found),
        }
    )


def upsert(rounds: DataFrame) -> DataFrame:
    """One card a fingerprint of (fingerprint, score_rerank, round_found, ord, ...): the best score, the earlier on ties.

    It keeps the first round and place that the fingerprint had, whichever card wins. Cards are
    compared before they shuffle, so that boilerplate of one fingerprint meets nowhere.
    """
    rest = [c for c in rounds.columns if c not in ("fingerprint", "round_found", "ord")]
    best = F.max_by(F.struct(*rest), F.struct("score_rerank", -F.col("round_found"), -F.col("ord")))
    one = rounds.groupBy("fingerprint").agg(best.alias("_best"), F.min(F.struct("round_found", "ord")).alias("_came"))
    return one.select("fingerprint", *(F.col(f"_best.`{c}`").alias(c) for c in rest), "_came.round_found", "_came.ord").select(*rounds.columns)


def new_cards(pool: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.dropDuplicates(["fingerprint"]).join(pool.select("fingerprint"), "fingerprint", "left_anti")


def rarest_tag(pool: DataFrame) -> DataFrame:
    """(fingerprint, rarity) of the tag that fewest cards have: 1 / (cards + 1)."""
    each = pool.select("fingerprint", F.explode(F.array_distinct("tags")).alias("tag"))
    counts = each.groupBy("tag").agg((1 / (F.count("*") + 1)).alias("rarity"))
    return each.join(counts, "tag").groupBy("fingerprint").agg(F.max("rarity").alias("tag_rarity"))


def eviction_scores(pool: DataFrame, current_round: int, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Adds evict_score, all from the same state of the pool: score, recency, rare kind, rare tag."""
    kinds = pool.groupBy("source_kind").agg((1 / (F.count("*") + 1)).alias("kind_rarity"))
    both = pool.join(kinds, "source_kind").join(rarest_tag(pool), "fingerprint", "left")
    recency = F.greatest(F.lit(0), 2 - (F.lit(current_round) - F.col("round_found")))
    total = weights["score"] * F.col("score_rerank") + weights["recency"] * recency + weights["kind"] * F.col("kind_rarity") + weights["tag"] * F.coalesce("tag_rarity", F.lit(0.0))
    return both.withColumn("evict_score", F.round(total, 9)).drop("kind_rarity", "tag_rarity")


def evict(pool: DataFrame, current_round: int, max_pool: int = 200) -> DataFrame:
    """The max_pool cards of highest eviction score; of equal ones the earlier goes first."""
    scored = eviction_scores(pool, current_round)
    return scored.orderBy(F.desc("evict_score"), F.desc("ord")).limit(max_pool)


def working_set(pool: DataFrame, size: int = 20, free: int = 10) -> DataFrame:
    """The best cards, after the first ten only such as bring a new module or tag; adds rank and module.

    A card that brings nothing adds nothing to what was seen, so a card is new exactly if no
    earlier card at all has its module, or one of its tags.
    """
    order = W.orderBy(F.desc("score_rerank"), "ord")  # a pool is bounded by max_pool
    ranked = pool.withColumn("_rn", F.row_number().over(order)).withColumn("module", paths.module_key("path"))
    ranked = ranked.withColumn("_new", F.col("_rn") == F.min("_rn").over(W.partitionBy("module")))
    tags = ranked.select("_rn", F.explode("tags").alias("tag")).groupBy("tag").agg(F.min("_rn").alias("_rn")).select("_rn").distinct().withColumn("_tag", F.lit(True))
    kept = ranked.join(tags, "_rn", "left").filter((F.col("_rn") <= free) | F.col("_new") | F.coalesce("_tag", F.lit(False)))
    return kept.withColumn("rank", F.row_number().over(W.orderBy("_rn"))).filter(F.col("rank") <= size).drop("_rn", "_new", "_tag")


def planner_summary(cards: DataFrame) -> DataFrame:
    """A line a card: id, path, symbol, tags, summary, score."""
    cut = F.when(F.length("snippet") > 50, F.concat(F.substring("snippet", 1, 50), F.lit("..."))).otherwise(F.col("snippet"))
    tags = F.when(F.size("tags") > 0, F.array_join(F.slice("tags", 1, 3), ",")).otherwise("-")
    line = F.format_string("%s | %s | %s | %s | %s | %.2f", F.substring("id", 1, 8), F.right("path", F.lit(40)), F.coalesce("symbol", F.lit("-")), tags, F.translate(cut, "\n|", " /"), "score_rerank")
    return cards.select("rank", line.alias("line"))


def lookup(pool: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Cards by id or by an id's first eight characters."""
    return pool.filter(F.col("id").isin(*ids) | F.substring("id", 1, 8).isin(*ids))


def stats(pool: DataFrame) -> dict[str, object]:
    tags = pool.select(F.explode("tags").alias("tag")).groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(10)
    kinds = pool.groupBy("source_kind").count()
    total, mean = pool.agg(F.count("*"), F.round(F.avg("score_rerank"), 3)).first()
    return {"total": total, "by_kind": {r[0]: r[1] for r in kinds.collect()}, "top_tags": {r[0]: r[1] for r in tags.collect()}, "avg_score": mean or 0.0}


def quality_gate(pool: DataFrame, min_code: int = 2, min_tags: int = 2) -> DataFrame:
    """One row (passed, reason): the first condition that the cards miss."""
    tags = F.array_distinct(F.flatten(F.collect_set("tags")))
    found = pool.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("source_kind") == "code").alias("code"),
        F.size(tags).alias("tags"),
        F.coalesce(F.bool_or(F.array_contains("tags", "callsite") | F.array_contains("tags", "invocation")), F.lit(False)).alias("call"),
        F.coalesce(F.bool_or((F.size("entities.config_keys") > 0) | (F.size("entities.enums") > 0)), F.lit(False)).alias("named"),
    )
    reason = (
        F.when(F.col("n") == 0, "no_evidence")
        .when(F.col("code") < min_code, F.format_string(f"insufficient_code_evidence: %d/{min_code}", "code"))
        .when(F.col("tags") < min_tags, F.format_string(f"insufficient_tag_diversity: %d/{min_tags}", "tags"))
        .when(~F.col("call"), "missing_call_edge_evidence")
        .when(~F.col("named"), "missing_named_entity")
        .otherwise("passed")
    )
    return found.select((reason == "passed").alias("passed"), reason.alias("reason"))


def accept_coverage(cards: DataFrame, needs: Mapping[str, Sequence[str]], column: str = "chunk_text", enough: float = 0.67) -> DataFrame:
    """(need, n_items, n_covered, satisfied): how many accept items some card meets.

    All items are judged in one pass over the cards; needs are a small plan-time mapping. A need
    without items is satisfied.
    """
    spark = cards.sparkSession
    items = sorted({i for v in needs.values() for i in v})
    rows = spark.createDataFrame([(k, i) for k, v in needs.items() for i in v], "need string, item string")
    if items:
        met = cards.agg(*(F.coalesce(F.bool_or(text.covers(column, i)), F.lit(False)).alias(f"i{k}") for k, i in enumerate(items)))
        pairs: Column = F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.col(f"i{k}").alias("met")) for k, i in enumerate(items))))
        met = met.select(pairs.alias("x")).select("x.item", "x.met")
    else:
        met = spark.createDataFrame([], "item string, met boolean")
    found = rows.join(F.broadcast(met), "item").groupBy("need").agg(F.count("*").alias("n_items"), F.count_if("met").alias("n_covered"))
    names = spark.createDataFrame([(k,) for k in needs], "need string")
    out = names.join(found, "need", "left").select("need", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_covered", F.lit(0)).alias("n_covered"))
    return out.withColumn("satisfied", (F.col("n_items") == 0) | (F.col("n_covered") / F.greatest("n_items", F.lit(1)) >= enough))


def unseen_paths(hits: DataFrame, pool: DataFrame) -> DataFrame:
    return hits.join(pool.select("path").distinct(), "path", "left_anti")


def union_cards(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_analyses(outputs: DataFrame) -> DataFrame:
    """One analysis for each search from several analysts', whatever order they come in.

    outputs are (search_id, persona, priority, subject, actors array<struct<name, role>>, covered,
    gaps, reasoning); a smaller priority counts first, then the persona's name. The subject is the
    first that isn't empty; actors are one a name, covered and gaps one a text, each as the first
    analyst has it and in the order of first mention; reasonings stand one after another.
    """
    rank = F.struct("priority", "persona")
    base = outputs.groupBy("search_id").agg(
        F.min(F.when(F.length("subject") > 0, F.struct("priority", "persona", "subject"))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.length("reasoning") > 0, F.struct("priority", "persona", "reasoning")))).alias("r"),
    )
    base = base.select("search_id", F.coalesce("s.subject", F.lit("")).alias("subject"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("["), x["persona"], F.lit("] "), x["reasoning"])), " | ").alias("reasoning"))

    def union(column: str, key: Column, value: Column) -> DataFrame:
        each = outputs.select("search_id", rank.alias("rank"), F.posexplode(column).alias("place", "x")).withColumns({"k": key, "v": value}).filter(F.length("k") > 0)
        first = each.groupBy("search_id", "k").agg(F.min_by("v", F.struct("rank", "place")).alias("v"), F.min(F.struct("rank", "place")).alias("at"))
        return first.groupBy("search_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(column))

    for column, key in (("actors", F.col("x.name")), ("covered", F.col("x")), ("gaps", F.col("x"))):
        kind = outputs.schema[column].dataType
        base = base.join(union(column, key, F.col("x")), "search_id", "left").withColumn(column, F.coalesce(column, F.array().cast(kind)))
    return base.select("search_id", "subject", "actors", "covered", "gaps", "reasoning")
