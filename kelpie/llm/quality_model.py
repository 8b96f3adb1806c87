"""Quality by a generalised additive model with pairwise interactions.

Features of a text are cut into at most 32 bins at training quantiles. Cyclic boosting visits
one feature after another, over and over, and adds a shallow tree's steps, at a low rate, to
that feature's table of log odds; then the pairs of features whose residuals' tables gain most
get two-dimensional tables the same way. A score is a sum of table entries.

Every whole text is scored; training sees a bounded sample, ``per_class`` labelled documents of
either class of at most ``max_bytes`` each. Defined results: null and empty texts have all-zero
features and are scored like any; very long texts are compressed part by part; a value right at a
bin's edge lies above it; repeated rows score alike; columns ``score``, ``held_out`` and
``predicted`` of the input are replaced, others pass through; without labels of both classes
every score is one half; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import code_points, crc32_mod, labelled_sample
from kelpie.llm.toxicity import score_texts

#: Documents of either class that training sees at most.
PER_CLASS = 2500
BINS = 32
FEATURES = ("words", "word_length", "long_words", "symbols", "digits", "capitals", "punctuation", "other_marks", "doubled_marks", "distinct_words", "repeat_lines", "line_length", "compressed", "sentence_ends")

_CLASS = np.zeros(256, np.uint8)
for _chars, _code in ((range(ord("a"), ord("z") + 1), 1), (range(ord("A"), ord("Z") + 1), 2), (range(48, 58), 3), (map(ord, "#*$%&|<>~^=+_{}[]\\/@"), 4), (map(ord, ".,;:"), 5), (map(ord, "!?"), 6), (range(9, 14), 7), ([32], 7), (range(192, 256), 1)):
    _CLASS[list(_chars)] = _code


def features(text: str) -> list[float]:
    """Ratios over the whole text; a text without words gives zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    cp = code_points(text)
    kind = np.where(cp < 256, _CLASS[np.minimum(cp, 255)], 1)
    n = np.bincount(kind, minlength=8)
    marks = n[4] + n[6] + n[0]
    is_mark = (kind == 4) | (kind == 6)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    visible = len(cp) - n[7]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # parts of a very long text are compressed one by one, so that the measure means the same at every length
    packed = sum(len(zlib.compress(raw[i : i + 16384], 1)) for i in range(0, len(raw), 16384))
    return [
        float(np.log1p(len(words))), float(lengths.mean()), float((lengths > 15).mean()),
        n[4] / len(words), n[3] / visible, n[2] / max(1, n[1] + n[2]), n[5] / len(words), marks / visible,
        float((is_mark[1:] & is_mark[:-1]).sum() / len(words)),
        len(set(words)) / len(words) ** 0.8, 1 - len(set(lines)) / len(lines), float(np.log1p(len(words) / len(lines))),
        packed / len(raw), sum(w[-1] in ".!?" for w in words) / len(words),
    ]


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def log_odds(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.bias)
        for k, t in enumerate(self.single):
            out += t[b[:, k]]
        for i, j, t in self.pairs:
            out += t[b[:, i], b[:, j]]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-self.log_odds(self.bins(x))))


def tree_step(grad: np.ndarray, hess: np.ndarray, depth: int = 2, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Leaf values, by bin, of the tree over an ordered feature that gains most from its bins' sums."""
    out = np.zeros(len(grad))

    def grow(lo: int, hi: int, depth: int) -> None:
        g, h = grad[lo:hi], hess[lo:hi]
        value = g.sum() / (h.sum() + ridge)
        if depth and hi - lo > 1:
            gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -1)
            at = int(gain.argmax())
            if gain[at] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
                grow(lo, lo + at + 1, depth - 1)
                grow(lo + at + 1, hi, depth - 1)
                return
        out[lo:hi] = value

    grow(0, len(grad), depth)
    return out


def pair_step(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Values by cell of the best cut of the plane into four, and its gain."""
    n, m = grad.shape
    g, h = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1))
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    gain, quarters = np.zeros(i.shape), []
    for own_g, own_h in zip(*([t[i, j], t[i, -1] - t[i, j], t[-1, j] - t[i, j], t[-1, -1] - t[i, -1] - t[-1, j] + t[i, j]] for t in (g, h)), strict=True):
        quarters.append(own_g / (own_h + ridge))
        gain += own_g**2 / (own_h + ridge)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros((n, m))
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = (q[a, b] for q in quarters)
    return out, float(gain[a, b] - g[-1, -1] ** 2 / (h[-1, -1] + ridge))


def train(texts: list[str], labels: list[int], rounds: int = 120, n_pairs: int = 4, rate: float = 0.1) -> AdditiveModel:
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return AdditiveModel([np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    x = np.array([features(t) for t in texts])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], [], float(np.log(y.mean() / (1 - y.mean()))))
    b = model.bins(x)
    f = model.log_odds(b)

    def sums(cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)

    for _ in range(rounds):
        for k, t in enumerate(model.single):
            step = rate * tree_step(*sums(b[:, k], len(t)))
            t += step
            f += step[b[:, k]]
    found = []
    for i in range(len(edges)):
        for j in range(i):
            n, m = len(model.single[i]), len(model.single[j])
            if n > 1 and m > 1:
                found.append((pair_step(*(s.reshape(n, m) for s in sums(b[:, i] * m + b[:, j], n * m)))[1], i, j))
    for _, i, j in sorted(found, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, np.zeros((len(model.single[i]), len(model.single[j])))))
    for _ in range(rounds // 4):
        for i, j, t in model.pairs:
            step = rate * pair_step(*(s.reshape(t.shape) for s in sums(b[:, i] * t.shape[1] + b[:, j], t.size)))[0]
            t += step
            f += step[b[:, i], b[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out=None, per_class: int = PER_CLASS) -> AdditiveModel:
    held_out = F.lit(False) if held_out is None else held_out
    rows = sorted(labelled_sample(docs, labels, label, held_out, per_class).collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] or "" for r in rows], [r["y"] for r in rows])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with held_out, score and predicted; a third of the ids teaches nothing."""
    held = crc32_mod(F.col("doc_id"), 3) == 1
    scored = score_texts(docs, fit(docs, labels, "quality", held))
    return scored.withColumn("held_out", F.coalesce(held, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
