"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

What the corpus gives is gathered by Spark: counts of all words of the training documents, which
neighbours the frequent words have, and updates of the model. Frequent words are dealt into
classes of equal size by their neighbours; other words are told apart by their last byte. The
model says a text word by word: the class from hashed features (the word before, the word before that, and
both), then the word within the class from what the two words before are, each for itself, and a
rare word within its kind by its count. Each task makes AdaGrad steps
over its documents from the same weights; updates are summed in blocks over all tasks, each row
of weights by how often a task met it, and give the weights of the next round.

Words beyond the bounded table of frequent ones get their counts by a join, summed for each document.

Defined results: a null text is empty; an empty text is its end alone; a very long text is read in
pieces; a row without doc_id is a training document; repeated rows are scored alike and all
count; an unseen word counts as one more word, as in the base score; without training documents
all words are unseen; further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import crc32_mod, stored, table, tidy

#: Words and bytes of a word in the table that goes to every task; distinct words that a task holds before it hands their counts on.
FREQUENT, WORD_BYTES, HELD = 1 << 18, 64, 400_000
#: Classes, words of a class, kinds of rare words. A model's unit is the end (0), a kind of rare words, or a word.
CLASSES, CLASS_WORDS, KINDS = 32, 64, 31
FIRST = KINDS + 1
#: Rows of hashed weights of either level; tokens of a step; tokens that are scored at once.
ROWS, STEP, BATCH = 1 << 13, 8192, 32_768
RATE, ROUNDS, NEIGHBOURS = 1.0, 1, 64
#: Parts that a model's sums travel in, and groups of tasks that are summed first.
BLOCKS, GROUPS = 64, 64
#: The logit of an outcome that no word has, and a weight's bound.
NEVER, MOST = -30.0, 15.0
END = b" "
WHITE = re.compile(rb"[\t-\r ]")


def words_of(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, a long one in pieces cut at white space."""
    at = 0
    while len(text) - at > size and (m := WHITE.search(text, at + size)):
        yield text[at : m.start()].lower().split()
        at = m.start()
    yield (text[at:] if at else text).lower().split()


def kind_of(word: bytes) -> int:
    """The unit of a rare word."""
    return word[-1] % KINDS + 1


def word_counts(texts: DataFrame) -> DataFrame:
    """word, kind, n over all texts; the end is the word of one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = list(held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([kind_of(w) if w != END else 0 for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())], ["word", "kind", "n"])

        for b in batches:
            held[END] += b.num_rows
            for text in b.column(0).cast(pa.binary()):
                for words in words_of(text.as_py() or b""):
                    held.update(words)
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return texts.mapInArrow(tidy(run), "word binary, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The frequent words, commonest first, with their counts and units, and the sums that probabilities need."""

    index: dict[bytes, int]
    counts: np.ndarray
    units: np.ndarray
    #: Tokens and distinct tokens of the training documents, and of each kind of rare words; how often the end comes.
    total: int
    distinct: int
    kind_total: np.ndarray
    kind_distinct: np.ndarray
    ends: int
    least: int

    @classmethod
    def of(cls, counts: DataFrame) -> Words:
        """The commonest words, as many whole steps of the histogram of counts as the table's bound allows."""
        short = counts.filter((F.octet_length("word") <= WORD_BYTES) & (F.col("word") != F.lit(END)))
        steps = short.groupBy(F.floor(16 * F.log2("n")).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()  # at most 16 for each doubling
        least, room = 1 << 62, FREQUENT
        for r in sorted(steps, key=lambda r: -r["step"]):
            room -= r["words"]
            if room < 0:
                break
            least = r["least"]
        rows = sorted(((-r["n"], bytes(r["word"])) for r in short.filter(F.col("n") >= least).collect()))
        own = min(len(rows), CLASSES * CLASS_WORDS)
        units = np.array([FIRST + k if k < own else kind_of(w) for k, (_, w) in enumerate(rows)], np.int32)
        sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
        total, distinct = (np.array([sums[k][c] if k in sums else 0 for k in range(FIRST)], np.int64) for c in ("n", "words"))
        kind_total, kind_distinct = total.copy(), distinct.copy()
        for n, w in rows[:own]:
            kind_total[kind_of(w)] += n
            kind_distinct[kind_of(w)] -= 1
        return cls({w: k for k, (_, w) in enumerate(rows)}, np.array([-n for n, _ in rows], np.int64), units, int(total.sum()), int(distinct.sum()), kind_total, kind_distinct, int(total[0]), least)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its place in the table, -1 for none, and its unit."""
        at = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int32, len(words))
        units = self.units[at] if len(self.units) else np.zeros(len(at), np.int32)
        rare = np.flatnonzero(at < 0)
        units[rare] = [kind_of(words[k]) for k in rare.tolist()]
        return at, units

    def histories(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Units of training texts with the two before, about a batch at a time: rows of unit, h1, h2."""
        held, size, last = [], 0, np.zeros(2, np.int32)
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                for words in words_of(text.as_py() or b""):
                    held.append(self.read(words)[1])
                    size += len(words)
                    if size >= BATCH:
                        out = np.concatenate([last, *held])
                        yield with_history(out)
                        held, size, last = [], 0, out[-2:]
                held.append(np.zeros(1, np.int32))
                size += 1
        if held:
            yield with_history(np.concatenate([last, *held]))


def with_history(units: np.ndarray) -> np.ndarray:
    """Of each unit but the first two the two before it; nothing is seen across an end."""
    out = np.stack([units[2 - k : len(units) - k] for k in range(3)])
    out[2][out[1] == 0] = 0
    return out


def summed(parts: DataFrame, run: Callable, shape: int) -> np.ndarray:
    """The sum of vectors that tasks make, in parts and first over groups of tasks; the driver gets one vector of fixed length."""
    size = -(-shape // BLOCKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() % GROUPS
        for vector in run(batches):
            rows = [vector[k * size : (k + 1) * size].astype("<f4").tobytes() for k in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([group] * BLOCKS, pa.int32()), pa.array(rows, pa.binary())], ["block", "part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                own = np.frombuffer(data, "<f4").astype(np.float64)
                sums[tuple(key)] = sums[tuple(key)] + own if tuple(key) in sums else own
        for (block, group), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["block", "part", "data"])

    schema = "block int, part int, data binary"
    few = parts.mapInArrow(tidy(cut), schema).repartition("block", "part").mapInArrow(tidy(add), schema)
    rows = few.withColumn("part", F.lit(0)).repartition("block").mapInArrow(tidy(add), schema).collect()
    out = np.zeros(BLOCKS * size)
    for r in rows:
        own = np.frombuffer(bytes(r["data"]), "<f4")
        out[r["block"] * size : r["block"] * size + len(own)] = own
    return out[:shape]


def balanced(vectors: np.ndarray, classes: int) -> np.ndarray:
    """Classes of equal size, by halving along the first principal direction; a word's class."""
    out = np.zeros(len(vectors), np.int64)
    todo = [(np.arange(len(vectors)), 0, classes)]
    while todo:
        own, first, n = todo.pop()
        if n == 1:
            out[own] = first
            continue
        half = -(-len(own) // 2)
        if len(own) > 1:
            x = vectors[own] - vectors[own].mean(0)
            axis = np.ones(x.shape[1]) / math.sqrt(x.shape[1])
            for _ in range(20):
                axis = x.T @ (x @ axis) + 1e-12
                axis /= np.linalg.norm(axis)
            own = own[np.argsort(x @ axis, kind="stable")]
        todo += [(np.sort(own[:half]), first, n // 2), (np.sort(own[half:]), first + n // 2, n // 2)]
    return out


def classed(words: Words, texts: DataFrame) -> Words:
    """The words with units by class, and within a class by frequency: from their neighbours in all training texts."""
    n = int((words.units >= FIRST).sum())
    if not n:
        return words
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen = np.zeros(2 * NEIGHBOURS * n)
        for unit, before, *_ in shared.value.histories(batches):
            for who, other, side in ((unit, before, 0), (before, unit, 1)):
                own = who >= FIRST
                # the commonest words are neighbours for themselves, all others by kind or hash
                column = np.where(other < NEIGHBOURS, other, other * 7919 % (NEIGHBOURS // 2) + NEIGHBOURS // 2)
                seen += np.bincount((who[own] - FIRST) * (2 * NEIGHBOURS) + side * NEIGHBOURS + column[own], minlength=len(seen))
        yield seen

    seen = summed(texts, run, 2 * NEIGHBOURS * n).reshape(n, -1)
    shares = np.sqrt((seen + 0.1) / (seen + 0.1).sum(1, keepdims=True))
    to = balanced(shares, CLASSES)
    units = words.units.copy()
    for k in range(CLASSES):
        own = np.flatnonzero(to == k)
        units[own] = FIRST + k * CLASS_WORDS + np.arange(len(own))
    return Words(**(vars(words) | {"units": units}))


def rows_for(*keys: np.ndarray | int) -> np.ndarray:
    """A row of hashed weights for a feature."""
    h = np.zeros(1, np.uint64)  # an array, as it is meant to overflow
    for k in keys:
        h = (h ^ np.asarray(k).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(64 - int(math.log2(ROWS)))).astype(np.int64)


class Level:
    """A softmax over hashed rows of weights, with a bias row for each group of outcomes."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def logits(self, rows: np.ndarray, group: np.ndarray | int) -> np.ndarray:
        z = self.weights[rows[0]]
        for r in rows[1:]:
            z += self.weights[r]
        z += self.bias[group]
        return z

    def log_p(self, rows: np.ndarray, group: np.ndarray | int, target: np.ndarray) -> np.ndarray:
        """Each target's log probability. Weights are bounded, so that sums of exponentials are too."""
        z = self.logits(rows, group)
        own = z[np.arange(len(target)), target].astype(np.float64)
        return own - np.log(np.exp(z, out=z).sum(1), dtype=np.float64)

    def learn(self, rows: np.ndarray, group: np.ndarray | int, target: np.ndarray, slack: np.ndarray, met: np.ndarray) -> None:
        """One AdaGrad step, a rate for each row; met counts how often each row was in use."""
        p = self.logits(rows, group)
        np.exp(p, out=p)
        p *= (1 / p.sum(1))[:, None]
        p[np.arange(len(target)), target] -= 1
        flat = rows.ravel().astype(np.int16)  # sorted by radix
        order = np.argsort(flat, kind="stable")
        at = flat[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        own, sizes = at[starts].astype(np.int64), np.diff(np.append(starts, len(at)))
        g = sums_of(p, order % len(target), starts, sizes)
        slack[own] += np.einsum("ij,ij->i", g, g)
        g *= (RATE / np.sqrt(slack[own]))[:, None]
        self.weights[own] = np.clip(self.weights[own] - g, -MOST, MOST)
        met[own] += sizes


def sums_of(p: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, turns: int = 8) -> np.ndarray:
    """Sums of p's rows over runs of an order: short runs turn by turn, all together, and long ones each for itself."""
    out = p[order[starts]]
    live = np.flatnonzero((sizes > 1) & (sizes <= turns))
    for k in range(1, turns):
        out[live] += p[order[starts[live] + k]]
        live = live[sizes[live] > k + 1]
    for i in np.flatnonzero(sizes > turns).tolist():
        out[i] = p[order[starts[i] : starts[i] + sizes[i]]].sum(0)
    return out


@dataclass
class Model:
    words: Words
    #: One vector: weights of either level.
    weights: np.ndarray

    @property
    def width(self) -> int:
        return FIRST + CLASSES

    def levels(self) -> tuple[Level, Level]:
        w, size = self.words, ROWS * self.width
        wide = np.zeros(CLASSES * CLASS_WORDS)
        own = w.units >= FIRST
        wide[w.units[own] - FIRST] = w.counts[own]
        within = wide.reshape(CLASSES, CLASS_WORDS)
        top = np.concatenate([[w.ends], w.kind_total[1:], within.sum(1)])
        used = np.concatenate([np.ones(FIRST, bool), within.sum(1) > 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            first = np.where(used, np.log((top + 1) / (top + 1)[used].sum()), NEVER)
            second = np.where(within > 0, np.log(within / within.sum(1, keepdims=True)), NEVER)
        a, b = self.weights[:size].reshape(ROWS, -1), self.weights[size:].reshape(ROWS, -1)
        return Level(a, first[None].astype(np.float32)), Level(b, second.astype(np.float32))

    def features(self, history: np.ndarray) -> tuple:
        """Rows and targets of both levels; which tokens have a second level."""
        unit, h1, h2 = history
        kind = lambda u: np.where(u < FIRST, u, FIRST + (u - FIRST) // CLASS_WORDS)
        rows = np.stack([rows_for(1, h1), rows_for(2, h2), rows_for(3, h1, h2)])
        two = np.flatnonzero(unit >= FIRST)
        c = (unit[two] - FIRST) // CLASS_WORDS
        within = np.stack([rows_for(4, c, kind(h1[two])), rows_for(5, c, kind(h2[two]))])
        return rows, kind(unit), two, within, c, (unit[two] - FIRST) % CLASS_WORDS

    def log_p(self, history: np.ndarray) -> np.ndarray:
        """Each unit's natural log probability after its history."""
        first, second = self.levels()
        out = np.empty(history.shape[1])
        for lo in range(0, len(out), STEP):
            rows, target, two, within, c, place = self.features(history[:, lo : lo + STEP])
            own = first.log_p(rows, 0, target)
            if len(two):
                own[two] += second.log_p(within, c, place)
            out[lo : lo + STEP] = own
        return out


def size_of_model() -> int:
    return ROWS * (FIRST + CLASSES + CLASS_WORDS)


def trained(words: Words, texts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model after so many rounds over all training texts."""
    model = Model(words, np.zeros(size_of_model(), np.float32))
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[np.ndarray]:
            start = shared.value
            own = Model(start.words, start.weights.copy())
            first, second = own.levels()
            slack, met = np.ones((2, ROWS), np.float32), np.zeros((2, ROWS))
            for history in start.words.histories(batches):
                for lo in range(0, history.shape[1], STEP):
                    rows, target, two, within, c, place = own.features(history[:, lo : lo + STEP])
                    first.learn(rows, 0, target, slack[0], met[0])
                    if len(two):
                        second.learn(within, c, place, slack[1], met[1])
            change = own.weights - start.weights
            for x, n in zip(np.split(change, [ROWS * own.width]), met, strict=True):
                x.reshape(ROWS, -1)[:] *= n[:, None]
            yield np.concatenate([change, met.ravel()])

        got = summed(texts, run, size_of_model() + 2 * ROWS)
        change, met = got[: -2 * ROWS], got[-2 * ROWS :].reshape(2, -1)
        for x, n in zip(np.split(change, [ROWS * model.width]), met, strict=True):
            x.reshape(ROWS, -1)[:] /= np.maximum(n, 1)[:, None]
        model = Model(words, (model.weights + change).astype(np.float32))
    return model


def parts_of_scores(docs: DataFrame, model: Model) -> DataFrame:
    """A row a document: its sums over all but the counts of words beyond the table, and those words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    w = model.words
    whole, kinds = math.log10(w.total + w.distinct + 1), np.log10(w.kind_total + w.kind_distinct + 1)
    fields = pa.struct([("word", pa.binary()), ("n", pa.int64())])
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        w, place = model.words, TaskContext.get().partitionId() << 40
        gain = np.append(np.log10(w.counts + 1), 0.0)  # a rare word's comes by the join
        end = math.log10(w.ends + 1)

        def flush(held: list, rows: list) -> pa.RecordBatch:
            units = np.concatenate([np.zeros(2, np.int32), *held])
            sizes = [r[3] for r in rows]
            by_text = np.add.reduceat(model.log_p(with_history(units)), np.append(0, np.cumsum(sizes)[:-1])) / math.log(10)
            rows = [(*r[:6], r[6] + float(x), r[7]) for r, x in zip(rows, by_text, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(fields))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        held, rows, size = [], [], 0
        for b in batches:
            for doc_id, held_out, text in zip(b["doc_id"].to_pylist(), b["held_out"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                n, known, base, score, rare = 1, int(w.ends > 0), end - whole, 0.0, Counter()
                for words in words_of(text.as_py() or b""):
                    at, units = w.read(words)
                    held.append(units)
                    n += len(words)
                    gains = gain[at]
                    low = units < FIRST
                    known += int((at >= 0).sum())
                    base += float(gains.sum()) - whole * len(words)
                    score += float(gains[low].sum() - kinds[units[low]].sum())
                    rare.update(itertools.compress(words, (at < 0).tolist()))
                held.append(np.zeros(1, np.int32))
                rows.append((place, doc_id, held_out, n, known, base, score, list(rare.items())))
                place, size = place + 1, size + n
                if size >= BATCH:
                    yield flush(held, rows)
                    held, rows, size = [], [], 0
        if rows:
            yield flush(held, rows)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: binary, n: long>>"
    return docs.mapInArrow(tidy(run), schema)


def scored(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """The documents' scores: those of words beyond the table come by a join on the word, summed for each document."""
    words = model.words
    parts = stored(parts_of_scores(docs, model), "parts")
    rare = parts.select("row", F.explode("rare").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("times"))
    beyond = counts.filter(((F.col("n") < words.least) | (F.octet_length("word") > WORD_BYTES)) & (F.col("word") != F.lit(END))).select("word", "n")
    more = rare.join(beyond, "word").select(
        "row", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held_out", "boolean"))), F.lit(0).cast("long").alias("n_tokens"), F.col("times").alias("n_known"),
        *((F.col("times") * F.log10(F.col("n") + 1)).alias(c) for c in ("base_score", "score")),
    )
    sums = parts.drop("rare").unionByName(more).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, held_out: Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document; it learns from those that aren't held out."""
    own = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text")
    texts = own.filter(~F.col("held_out")).select("text")
    counts = stored(word_counts(texts), "counts")
    return scored(own, counts, trained(classed(Words.of(counts), texts), texts, rounds))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), F.coalesce(crc32_mod(F.col("doc_id"), 7) == 2, F.lit(False)))
