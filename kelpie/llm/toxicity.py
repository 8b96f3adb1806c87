"""Toxicity by bags of subwords.

A word is the bag of its character n-grams with marks at both ends and of itself, hashed to
buckets; each has an embedding, a word is its bag's mean, a window is the mean over its words,
and a linear softmax says whether the window is toxic. Embeddings begin small and random and are
trained jointly with the softmax in numpy, by Adagrad with a ridge; of each document a changing
share of the words is dropped, so that few words alone don't make it sure. Labels are
on documents: a document's logit is the smooth maximum (log of the mean exponential) over its
half-overlapping windows, so that its likeliest windows learn most. A word that comes again
within a window's length counts once, so that repetition adds nothing. A logistic curve on every
eighth document, which embeddings don't see, turns logits into scores; both classes weigh alike.
A misspelling shares most n-grams with its word.

Every whole text is scored; only training looks at a bounded sample, ``per_class`` labelled
documents of either class of at most ``max_bytes`` each. Defined results: texts without words
(null, empty) get the score of an empty bag, the softmax's bias; very long texts have as many
windows as they need; equal windows tie; repeated rows score alike; a column ``score`` of the
input is replaced, other columns pass through; without labels of both classes every score is one
half; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import blocks, crc32_mod, labelled_sample, texts_of, tidy

#: Documents of either class that training sees at most.
PER_CLASS = 2500
BUCKETS, DIM, GRAMS, WINDOW = 1 << 18, 4, (3, 4, 5, 6), 48
WORDS = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_ids(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and of the words whole, one word after another, and how many each has."""
    if len(words) > step:
        parts = [gram_ids(words[k : k + step], step) for k in range(0, len(words), step)]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    text = "".join(f"<{w}>" for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(len(cp))
    owner = np.repeat(np.arange(len(words)), size)
    ids = [np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), np.int32, len(words))]
    whose = [np.arange(len(words))]
    for n in GRAMS:
        h = np.full(len(cp), n, np.uint64)
        for j in range(n):
            h = (h ^ np.append(cp[j:], np.zeros(min(j, len(cp)), np.uint64))) * MIX
            h ^= h >> np.uint64(31)
        ok = at + n <= ends
        ids.append((h[ok] % np.uint64(BUCKETS)).astype(np.int32))
        whose.append(owner[ok])
    ids, whose = np.concatenate(ids), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return ids[order], np.bincount(whose, minlength=len(words))


def means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of each run of values; empty runs give 0."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = np.flatnonzero(counts)
    if len(full):
        begin = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, begin, axis=0) / counts[full].reshape(-1, *[1] * (values.ndim - 1))
    return out


def bag_means(table: np.ndarray, ids: np.ndarray, counts: np.ndarray, step: int = 20_000) -> np.ndarray:
    """means(table[ids], counts), some runs at a time."""
    ends = np.append(0, np.cumsum(counts))
    return np.concatenate([means(table[ids[ends[k] : ends[min(k + step, len(counts))]]], counts[k : k + step]) for k in range(0, len(counts), step)] or [np.zeros((0, *table.shape[1:]))])


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs that begin so and have so many places."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Windows:
    """The half-overlapping windows of some texts, as numbers of words in ``place``, which grows."""

    def __init__(self, texts: list[str], place: dict[str, int]):
        own = [self._kept(np.fromiter((place.setdefault(w, len(place)) for w in WORDS.findall(t.lower())), np.int64)) for t in texts]
        n = np.fromiter(map(len, own), np.int64, len(own))
        step = WINDOW // 2
        #: Of each document how many windows, and its first one.
        self.n = np.maximum(1, -(-(n - step) // step))
        self.first = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(own)), self.n)
        self.words = np.concatenate([*own, np.zeros(0, np.int64)])
        nth = np.arange(len(self.doc)) - self.first[self.doc]
        #: Of each window its first place among the words, and its size.
        self.begin = (np.cumsum(n) - n)[self.doc] + nth * step
        self.size = np.minimum(WINDOW, n[self.doc] - nth * step)

    @staticmethod
    def _kept(ids: np.ndarray) -> np.ndarray:
        """Without words that came less than a window before."""
        order = np.argsort(ids, kind="stable")
        before = np.full(len(ids), -WINDOW)
        same = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        return ids[np.arange(len(ids)) - before >= WINDOW]

    def logits(self, per_word: np.ndarray, bias: float) -> np.ndarray:
        """Each document's smooth maximum over its windows' means."""
        up_to = np.append(0.0, np.cumsum(per_word[self.words]))
        m = (up_to[self.begin + self.size] - up_to[self.begin]) / np.maximum(self.size, 1) + bias
        return smooth_maximum(m, self.first, self.n)[0]


def smooth_maximum(m: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run the log of the mean exponential, and each value's share in it."""
    top = np.maximum.reduceat(m, first)
    e = np.exp(m - np.repeat(top, n))
    total = np.add.reduceat(e, first)
    return top + np.log(total / n), e / np.repeat(total, n)


@dataclass
class Model:
    """What the softmax makes of each bucket's embedding: the two logits' difference, and the bias; and the curve to scores."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids, counts = gram_ids(words)
        return bag_means(self.weight, ids, counts)

    def logits(self, texts: list[str]) -> np.ndarray:
        place: dict[str, int] = {}
        windows = Windows(texts, place)
        return windows.logits(self.word_scores(list(place)) if place else np.zeros(0), self.bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: list[int], steps: int = 500, rate: float = 1.0, dropped: tuple[float, float] = (0.2, 0.9), ridge: float = 2e-4, seed: int = 5) -> Model:
    """Adagrad on embeddings and softmax together, in batches of 32 documents; the last third of the steps is averaged."""
    y = np.array(labels)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    place: dict[str, int] = {}
    all_windows = Windows(texts, place)
    grams, counts = gram_ids(list(place)) if place else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    gram_at = np.cumsum(counts) - counts
    apart = np.arange(len(texts)) % 8 == 7  # only calibrates
    if len({*y[apart]}) < 2 or len({*y[~apart]}) < 2:
        apart[:] = False
    share = y[~apart].mean()
    worth = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    seen_emb, seen_out, seen_bias = np.full(BUCKETS, 1e-4), np.full((DIM, 2), 1e-4), np.full(2, 1e-4)
    own_docs, mean, n_mean = np.flatnonzero(~apart), np.zeros(BUCKETS), 0
    mean_bias, order, k = 0.0, own_docs[:0], 0
    for step in range(steps):
        if k >= len(order):
            order, k = rng.permutation(own_docs), 0
        docs = order[k : k + 32]
        k += 32
        n_win = all_windows.n[docs]
        win = runs(all_windows.first[docs], n_win)
        size = all_windows.size[win]
        words = all_windows.words[runs(all_windows.begin[win], size)]
        keep = rng.random(len(words)) >= np.repeat(np.repeat(rng.uniform(*dropped, len(docs)), n_win), size)
        size, words = np.bincount(np.repeat(np.arange(len(win)), size)[keep], minlength=len(win)), words[keep]
        u, back = np.unique(words, return_inverse=True)
        c = counts[u]
        g = grams[runs(gram_at[u], c)]
        v = means(means(emb[g], c)[back], size)
        z = v @ out + bias
        logit, part = smooth_maximum(z[:, 1] - z[:, 0], np.cumsum(n_win) - n_win, n_win)
        d_logit = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y[docs]) * worth[docs]
        d_win = part * np.repeat(d_logit, n_win)
        d_z = np.stack([-d_win, d_win], 1)
        d_out, d_bias = v.T @ d_z, d_z.sum(0)
        d_word = np.bincount(back, np.repeat(d_win / np.maximum(size, 1), size), len(u)) / np.maximum(c, 1)
        ug, place_of = np.unique(g, return_inverse=True)
        along = out[:, 1] - out[:, 0]  # every embedding's gradient lies along it
        d_u = np.bincount(place_of, np.repeat(d_word, c), len(ug))[:, None] * along + ridge * emb[ug]
        seen_emb[ug] += (d_u**2).mean(1)
        emb[ug] -= (rate * d_u / np.sqrt(seen_emb[ug])[:, None]).astype(np.float32)
        seen_out += d_out**2
        out -= 0.2 * rate * d_out / np.sqrt(seen_out)
        seen_bias += d_bias**2
        bias -= 0.2 * rate * d_bias / np.sqrt(seen_bias)
        if step >= 2 * steps // 3 and step % 10 == 0 or step == steps - 1:
            mean += emb @ (out[:, 1] - out[:, 0])
            mean_bias, n_mean = mean_bias + bias[1] - bias[0], n_mean + 1
    model = Model((mean / max(1, n_mean)).astype(np.float32), float(mean_bias / max(1, n_mean)))
    if not n_mean:  # without any step: what chance began with
        model = Model(emb @ (out[:, 1] - out[:, 0]).astype(np.float32), 0.0)
    logit = all_windows.logits(bag_means(model.weight, grams, counts), model.bias)
    model.slope, model.shift = calibrate(logit[apart], y[apart]) if apart.any() else calibrate(logit, y)
    return model


def calibrate(logit: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift that fit document labels to the highest windows' logits, both classes weighing alike."""
    x = np.stack([logit, np.ones(len(y))], 1)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    beta, goal = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (w * (p - y)) + ridge * (beta - goal) * [0.1, 0.0001]
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.diag([0.1, 0.0001]) + 1e-9 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(0.1, float(beta[0])), float(beta[1])


def score_texts(docs: DataFrame, model) -> DataFrame:
    """Add score to the documents; the model goes to each task once, its size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = type(docs.schema)([f for f in docs.schema.fields if f.name != "score"]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            scores = np.concatenate([shared.value.scores(texts[lo:hi]) for lo, hi in blocks(texts)]) if texts else np.zeros(0)
            names = [x for x in b.schema.names if x != "score"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(scores, pa.float64())], [*names, "score"])

    return docs.mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out=None, per_class: int = PER_CLASS) -> Model:
    held_out = F.lit(False) if held_out is None else held_out
    rows = sorted(labelled_sample(docs, labels, label, held_out, per_class).collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] or "" for r in rows], [r["y"] for r in rows])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc32_mod(F.col("doc_id"), 3) == 1
    scored = score_texts(docs, fit(docs, labels, "toxic", held))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
