"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (one to three, case folded, runs of white space as one) hashed
to buckets, with sublinear term frequency, inverse document frequency and unit length. Weights
are learned by follow-the-regularised-leader with elastic-net penalties, so that most stay
exactly zero; a temperature fitted on a part of the sample that weights didn't see calibrates
the probabilities.

Every whole text is predicted; training sees a bounded sample, about ``per_language`` documents
of each of at most ``max_languages`` languages (rarer ones can't be predicted), ``SAMPLE`` in all,
of at most ``TEACH_BYTES`` each. Defined results: a text that is null or has no letter is ``und``
with score 0; without any labelled document everything is ``und``; very long texts are counted
part by part; of equally likely languages the first by name; repeated rows are predicted alike;
columns ``lang_pred`` and ``score`` of the input are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import code_points, crc32_mod, tidy

BUCKETS, GRAMS = 1 << 14, (1, 2, 3)
#: Bounds of the training sample: documents a language, languages, documents in all, bytes of a text.
PER_LANGUAGE, MAX_LANGUAGES, SAMPLE, TEACH_BYTES = 500, 500, 20_000, 16_384
UNKNOWN = "und"


def counts(text: str, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the whole text, and how often."""
    cp = code_points(" " + text.lower() + " ")
    white = (cp == 32) | ((cp >= 9) & (cp <= 13))
    cp = np.where(white, 32, cp)
    cp = cp[np.append(True, ~(white[1:] & white[:-1]))]
    out = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(cp), step):  # a very long text part by part
        part = cp[lo : lo + step + max(GRAMS) - 1]
        last = lo + step >= len(cp)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in GRAMS:
                own = h if last else h[:step]
                out += np.bincount((own * np.uint32(2654435761 + 2 * n)) >> np.uint32(32 - 14), minlength=BUCKETS)
    at = np.flatnonzero(out)
    return at, out[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(1e-12, float(np.sqrt((x**2).sum())))

    def logits(self, text: str) -> np.ndarray:
        at, x = self.vector(text)
        return x @ self.weight[at] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for t in texts:
            if not t or not self.languages or not any(map(str.isalpha, t)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = softmax(self.logits(t) / self.temperature)
            k = int(p.argmax())
            names.append(self.languages[k])
            scores.append(float(p[k]))
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def train(texts: list[str], languages: list[str], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, seed: int = 3) -> Model:
    """Follow the regularised leader, a document at a time; every fifth document fits the temperature."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages], np.int64)
    bags = [counts(t) for t in texts]
    df = np.bincount(np.concatenate([a for a, _ in bags] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
    model = Model(names, np.log((1 + len(texts)) / (1 + df)) + 0.1, np.zeros((BUCKETS, len(names))), np.zeros(len(names)))
    if len(names) < 2:
        return model
    vectors = []
    for at, n in bags:
        x = (1 + np.log(n)) * model.idf[at]
        vectors.append((np.append(at, BUCKETS), np.append(x / np.sqrt((x**2).sum()), 0.1)))  # the last one is the bias
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, own = order[: len(order) // 5], order[len(order) // 5 :]
    z, n = np.zeros((BUCKETS + 1, len(names))), np.zeros((BUCKETS + 1, len(names)))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(own):
            at, x = vectors[i]
            w = weights(at)
            g = softmax(x @ w)
            g[y[i]] -= 1
            g = x[:, None] * g[None, :]
            sigma = (np.sqrt(n[at] + g**2) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g**2
    full = weights(np.arange(BUCKETS + 1))
    model.weight, model.bias = full[:-1], 0.1 * full[-1]
    if len(held):
        logits = np.array([x[:-1] @ model.weight[at[:-1]] + model.bias for at, x in (vectors[i] for i in held)])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
    return model


def fit(docs: DataFrame, held_out: Column, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    own = docs.filter(~held_out & F.col("lang").isNotNull() & (F.octet_length("text") <= TEACH_BYTES))
    sizes = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    per_language = min(per_language, max(1, SAMPLE // max(1, len(sizes))))
    share = docs.sparkSession.createDataFrame([(r["lang"], per_language / r["count"]) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = own.join(F.broadcast(share), "lang").filter(place < F.col("share"))
    rows = picked.select("lang", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(SAMPLE, 2 * per_language * max(1, len(sizes)))).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score; the model's size is fixed by the buckets and languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score")
    schema = type(docs.schema)([f for f in docs.schema.fields if f.name not in new]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column("text").to_pylist())
            kept = [x for x in b.schema.names if x not in new]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, *new])

    return docs.mapInArrow(tidy(run), schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs, held)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
