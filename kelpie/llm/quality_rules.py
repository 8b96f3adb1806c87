"""Quality rules under weak supervision, with DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics. Documents are
counted by vote pattern (at most 3 to the number of rules of them), and expectation-maximisation
over these counts estimates the share of good documents and, of each rule and either class, how
often its votes are good ones: most junk is of one kind, on which other rules' good votes say
little. The posterior of a document's pattern decides, in place of a filter that every rule must
pass.

Defined results: null text has no words; documents of fewer than 50 words or with more than
half of their words in repeated three-word windows fail the base and are not kept; a very long
text is judged whole, within one row; a posterior right at the threshold is kept; repeated rows
are judged once each; further columns of the documents are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import stored

WHITE = r"[ \x09-\x0D]"
#: Where estimation starts: the share of good votes on good and on bad documents, and the share of good documents.
GOOD, BAD, SHARE = 0.998, 0.9, 0.85
#: Imagined votes that smooth, and how many more each vote brings: that good documents rarely get bad votes, and bad ones few, as junk is mostly of one kind, is known before.
IMAGINED, KNOWN = 10.0, 1.0
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks")


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator, so that later lambdas read them as stored values and don't redo them."""
    return df.withColumn("_one", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))).select("*", "_one.*").drop("_one")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics that rules look at, over whole texts."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("_t"))
    df = barrier(df, _w=F.array_remove(F.split("_t", f"{WHITE}+"), ""), _l=F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]")))
    size, w = F.size("_w"), F.col("_w")
    df = df.select(
        "doc_id", "_w",
        size.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count("_t", F.lit(r"!{2}|\?{2}|\.{4}")).cast("long").alias("n_marks"),
    )
    windows = F.when(size >= 3, F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = barrier(df, _h=windows).drop("_w")
    # texts without a repeated window, most of them, end here with an empty array
    placed = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = barrier(df, _p=placed).drop("_h")
    p = F.col("_p")
    twin = lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])
    found = F.filter("_p", lambda x, k: F.coalesce(twin(x, k), (k > 0) & (F.get(p, k - 1)["h"] == x["h"]), F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
    df = barrier(df, _at=F.sort_array(F.transform(found, lambda x: x["i"]))).drop("_p")
    at = F.col("_at")
    # a window covers three words, less those that the next found window covers
    covered = F.aggregate(F.transform("_at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select("doc_id", *STATISTICS[:5], covered.cast("long").alias("n_repeat_words"), *STATISTICS[6:])


def rules() -> dict[str, Column]:
    """Votes from the statistics, abstaining between two bounds; ratios are written as products, so that nothing is divided by zero."""
    c = F.col

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")

    return {
        "symbols": vote(c("n_symbols") <= 0.05 * c("n_words"), c("n_symbols") > 0.2 * c("n_words")),
        "length": vote(c("n_words") >= 80, c("n_words") < 50),
        "word_length": vote((c("word_chars") >= 4 * c("n_words")) & (c("word_chars") <= 9 * c("n_words")), (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words"))),
        "dup_lines": vote(c("n_dup_lines") <= 0.1 * c("n_lines"), c("n_dup_lines") > 0.3 * c("n_lines")),
        "repeats": vote(c("n_repeat_words") <= 0.15 * c("n_words"), c("n_repeat_words") > 0.35 * c("n_words")),
        "capitals": vote(c("n_upper") <= 0.15 * c("n_letters"), c("n_upper") > 0.35 * c("n_letters")),
        "letters": vote(c("n_letters") >= 0.85 * c("word_chars"), c("n_letters") < 0.72 * c("word_chars")),
        "marks": vote(c("n_marks") <= 0.02 * c("n_words"), c("n_marks") > 0.08 * c("n_words")),
        "sentences": vote((c("n_words") > 0) & (c("n_lines") * 60 >= c("n_words")) & (c("n_lines") * 4 <= c("n_words")), c("n_lines") * 2 > c("n_words")),
    }


@dataclass(frozen=True)
class Rates:
    """The share of good documents, and of each rule's votes on good and on bad documents the share of good ones."""

    share: float
    good: dict[str, float]
    bad: dict[str, float]


def begin(names: list[str]) -> Rates:
    return Rates(SHARE, dict.fromkeys(names, GOOD), dict.fromkeys(names, BAD))


def posterior(names: list[str], rates: Rates) -> Column:
    """Probability that a document of these votes is good; without votes the share of good documents."""
    odds = F.lit(math.log(rates.share / (1 - rates.share)))
    for k in names:
        yes, no = math.log(rates.good[k] / rates.bad[k]), math.log((1 - rates.good[k]) / (1 - rates.bad[k]))
        odds = odds + F.when(F.col(k) > 0, yes).when(F.col(k) < 0, no).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def smoothed(yes: float, votes: float, start: float, known: float = KNOWN) -> float:
    """By imagined votes that begin so, and bounded away from certainty."""
    imagined = IMAGINED + known * votes
    return min(0.9995, max(0.0005, (yes + imagined * start) / (votes + imagined)))


def improved(names: list[str], s: Mapping[str, float]) -> Rates:
    """From expected counts: good documents (p) of all (n), and of each rule good and all votes, on good documents and on all."""
    good = {k: smoothed(s[f"{k}_yes_p"], s[f"{k}_all_p"], GOOD) for k in names}
    # a rule tells bad from good or nothing: of two classes the better one has at least as many good votes
    bad = {k: min(good[k], smoothed(s[f"{k}_yes"] - s[f"{k}_yes_p"], s[f"{k}_all"] - s[f"{k}_all_p"], BAD)) for k in names}
    return Rates(smoothed(s["p"], s["n"], SHARE), good, bad)


def estimate(patterns: DataFrame, names: list[str], rounds: int = 40) -> Rates:
    """Expectation-maximisation over vote-pattern counts; a row of sums comes back each round."""
    rates = begin(names)
    p, n = F.col("_p"), F.col("n")
    sums = [F.sum(n).alias("n"), F.sum(p * n).alias("p")]
    for k in names:
        yes, voted = (F.col(k) > 0).cast("double"), (F.col(k) != 0).cast("double")
        sums += [F.sum(x * n * w).alias(f"{k}_{a}{b}") for x, a in ((yes, "yes"), (voted, "all")) for w, b in ((p, "_p"), (F.lit(1.0), ""))]
    for _ in range(rounds):
        s = patterns.withColumn("_p", posterior(names, rates)).agg(*sums).first()
        if s["n"] is None:  # no documents
            break
        old, rates = rates, improved(names, s.asDict())
        if max(abs(x[k] - y[k]) for x, y in ((old.good, rates.good), (old.bad, rates.bad)) for k in names) < 1e-5:
            break
    return rates


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, base_failed, the posterior quality and the verdict, a row a document."""
    names = list(rules())
    voted = stored(statistics(docs).select("*", *(c.alias(k) for k, c in rules().items())), "votes")
    patterns = stored(voted.groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1), "patterns")
    rates = estimate(patterns, names)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select("*", base.alias("base_failed"), posterior(names, rates).alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
