"""Who hears whom: publishers' topics met with consumers' binding patterns.

A pattern is dotted words, where ``*`` stands for one word and ``#`` for any number, none too. A
pattern is looked up by the rarest of its plain words, by its place from the pattern's beginning
(before the first ``#``) or from its end (after the last one), and only topics that have this word
in this place are compared with it as a whole. Patterns without plain words are looked up by how
many words they can have. The empty topic has no word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.operators.joins import HOT_ROWS, skew_join

# Fixed value: the name that stands before a topic in a relation's target.
TOPIC = "RabbitMQ.Topic."


def topic_of(target: Column | str) -> Column:
    """The topic or pattern that a relation's target names; a message type is its own topic."""
    return F.regexp_replace(target, "^" + TOPIC.replace(".", r"\."), "")


def words(topic: Column) -> Column:
    return F.when(topic == "", F.array().cast("array<string>")).otherwise(F.split(topic, r"\."))


def expression(pattern: Column) -> Column:
    """A pattern as a regular expression over a topic whose every word has a dot before it; neighbouring ``#`` are one."""
    one = words(F.regexp_replace(pattern, r"(?<=^|\.)#(?:\.#)+(?=\.|$)", "#"))
    quoted = lambda w: F.concat(F.lit(r"\.\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    each = F.transform(one, lambda w: F.when(w == "#", r"(?:\.[^.]*)*").when(w == "*", r"\.[^.]*").otherwise(quoted(w)))
    return F.concat(F.lit("^"), F.array_join(each, ""), F.lit("$"))


def places(topic_words: Column) -> Column:
    """(end, place, word) of each word, counted from either end."""
    n = F.size(topic_words)
    each = F.transform(topic_words, lambda w, i: F.array(F.struct(F.lit(0).alias("end"), i.alias("place"), w.alias("word")), F.struct(F.lit(1).alias("end"), (n - 1 - i).cast("int").alias("place"), w.alias("word"))))
    return F.flatten(each)


def plain_places(pattern_words: Column) -> Column:
    """(end, place, word) of the plain words whose place in a topic is certain."""
    n = F.size(pattern_words)
    first = F.when(F.array_contains(pattern_words, "#"), F.array_position(pattern_words, "#").cast("int") - 1).otherwise(n)
    last = F.when(F.array_contains(pattern_words, "#"), F.array_position(F.reverse(pattern_words), "#").cast("int") - 1).otherwise(n)
    plain = lambda x: ~x["word"].isin("*", "#")
    sure = lambda x: F.when(x["end"] == 0, x["place"] < first).otherwise(x["place"] < last)
    return F.filter(places(pattern_words), lambda x: plain(x) & sure(x))


def matches(topics: DataFrame, patterns: DataFrame) -> DataFrame:
    """(topic, pattern): every distinct topic with every distinct pattern that it matches; nulls match nothing."""
    t = topics.select("topic").filter("topic IS NOT NULL").distinct().withColumn("words", words(F.col("topic")))
    p = patterns.select("pattern").filter("pattern IS NOT NULL").distinct().withColumn("words", words(F.col("pattern")))
    p = p.withColumn("plain", plain_places(F.col("words")))
    at = t.select("topic", F.explode(places(F.col("words"))).alias("x")).select("topic", "x.*")
    rarity = at.groupBy("end", "place", "word").agg(F.count("*").alias("n"))
    asked = p.select("pattern", F.explode("plain").alias("x")).select("pattern", "x.*").join(rarity, ["end", "place", "word"], "left")
    best = asked.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "end", "place", "word")).alias("x"))
    by_word = best.filter("x.n > 0").select("pattern", "x.end", "x.place", "x.word").join(at, ["end", "place", "word"]).select("topic", "pattern")
    # patterns of stars and hashes alone: every topic of a fitting length is one of the answers
    free = p.filter(F.size("plain") == 0).select("pattern", F.size(F.filter("words", lambda w: w != "#")).alias("least"), F.array_contains("words", "#").alias("more"))
    lengths = t.select(F.size("words").alias("n")).distinct()
    fitting = free.join(F.broadcast(lengths), (F.col("n") == F.col("least")) | (F.col("more") & (F.col("n") > F.col("least")))).select("pattern", "n")
    by_length = t.withColumn("n", F.size("words")).join(fitting, "n").select("topic", "pattern")
    dotted = F.when(F.col("topic") == "", "").otherwise(F.concat(F.lit("."), F.col("topic")))
    return by_word.unionByName(by_length).filter(F.rlike(dotted, expression(F.col("pattern"))))


def routes(publishers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(project, topic, pattern, publishers, consumers): what is delivered where, with the numbers of distinct methods on either side."""
    one = lambda df, name, who: df.select("project", F.col(name), F.col(who)).filter(F.col(name).isNotNull()).groupBy("project", name).agg(F.count_distinct(who).alias(f"{who}s"))
    out, heard = one(publishers, "topic", "publisher"), one(consumers, "pattern", "consumer")
    met = matches(publishers, consumers).join(out, "topic").join(heard, ["project", "pattern"])
    return met.select("project", "topic", "pattern", "publishers", "consumers")


def deliveries(publishers: DataFrame, consumers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """DELIVERS_TO edges (project, type, source, target, topic) from publishers to the patterns that hear them.

    A publisher has one edge for each pattern, not for each consumer, so that edges grow with
    publishers and patterns; SUBSCRIBES_TO edges lead on from there. A topic that many publish is
    dealt over several tasks.
    """
    own = publishers.select("project", F.col("publisher").alias("source"), "topic").filter("topic IS NOT NULL").distinct()
    heard = consumers.select("project", "pattern").filter("pattern IS NOT NULL").distinct()
    met = matches(publishers, consumers).join(heard, "pattern").select("project", "topic", "pattern")
    return skew_join(own, met, ["project", "topic"], "inner", hot_rows).select("project", F.lit("DELIVERS_TO").alias("type"), "source", F.concat(F.lit(TOPIC), "pattern").alias("target"), "topic")


def from_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publishers (project, publisher, topic) and consumers (project, consumer, pattern) of a graph."""
    own = lambda kind, who, what: edges.filter(F.col("type") == kind).select("project", F.col("source").alias(who), topic_of("target").alias(what))
    return own("PUBLISHES_TO", "publisher", "topic"), own("SUBSCRIBES_TO", "consumer", "pattern")
