import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.llm import language_model as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")

def is_held():
    return F.coalesce(m.crc32_mod(F.col("doc_id"), 7) == 2, F.lit(False))


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by plain counting."""
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = [*words(t), None]
        out.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)))
    return out


def plain_score(model, counts, text):
    """A text's log10 probability word by word, from the weights themselves."""
    w, (first, second), out = model.words, model.levels(), 0.0
    units = []
    for x in [*words(text), None]:
        b = x.encode() if x is not None else None
        units.append(0 if b is None else int(w.units[w.index[b]]) if b in w.index else m.kind_of(b))
    h1 = h2 = 0
    kind = lambda u: u if u < m.FIRST else m.FIRST + (u - m.FIRST) // m.CLASS_WORDS

    def row(*keys):
        return int(m.rows_for(*(np.array([k]) for k in keys))[0])

    def log_p(z, k):
        z = z.astype(np.float64)
        return z[k] - z.max() - math.log(np.exp(z - z.max()).sum())

    for x, u in zip([*words(text), None], units, strict=True):
        z = first.bias[0] + first.weights[row(1, h1)] + first.weights[row(2, h2)] + first.weights[row(3, h1, h2)]
        out += log_p(z, kind(u)) / math.log(10)
        if u >= m.FIRST:
            c = (u - m.FIRST) // m.CLASS_WORDS
            z = second.bias[c] + second.weights[row(4, c, kind(h1))] + second.weights[row(5, c, kind(h2))]
            out += log_p(z, (u - m.FIRST) % m.CLASS_WORDS) / math.log(10)
        elif u:
            out += math.log10((counts[x] + 1) / (w.kind_total[u] + w.kind_distinct[u] + 1))
        h1, h2 = u, h1 if h1 else 0
    return out


@pytest.fixture(scope="module")
def rows(spark, sf):
    own = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    extra = [(None, "null Id"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "Same same\x0bÄÖ\tx"), (10**6 + 2, "Same same\x0bÄÖ\tx"), (10**6 + 3, "long " * 300_000), (10**6 + 4, "w" * 3_000_000), (10**6 + 5, " \n ")]
    return own + extra


@pytest.mark.parametrize("frequent", [1 << 18, 500, 0])
def test_counts_and_scores_equal_plain_ones(spark, rows, monkeypatch, frequent):
    monkeypatch.setattr(m, "FREQUENT", frequent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS word", "2 AS row").repartition(3)
    own = docs.select("doc_id", is_held().alias("held_out"), "text")
    texts = own.filter("NOT held_out").select("text")
    counts = m.stored(m.word_counts(texts), "counts")
    model = m.trained(m.classed(m.Words.of(counts), texts), texts)
    assert len(model.words.index) <= frequent
    got = sorted((tuple(r) for r in m.scored(own, counts, model).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(base(rows), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    plain = Counter(w for i, t in rows if not held(i) for w in words(t))
    texts = {(i, len(words(t)) + 1): t for i, t in rows}
    for r in got[::7]:
        assert r[6] == pytest.approx(plain_score(model, plain, texts[r[0], r[2]]), rel=1e-4, abs=1e-4)


def test_probabilities_sum_to_one(spark, rows):
    texts = spark.createDataFrame([(t,) for _, t in rows[:-4]], "text string")
    counts = m.stored(m.word_counts(texts), "counts")
    model = m.trained(m.classed(m.Words.of(counts), texts), texts)
    units = np.unique(np.append(np.arange(m.FIRST), model.words.units))
    for h1, h2 in ((0, 0), (int(units[-1]), 0), (int(units[-5]), int(units[40]))):
        p = np.exp(model.log_p(np.stack([units, np.full(len(units), h1), np.full(len(units), h2)])))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    assert model.weights.any()


def test_model_is_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = m.score_documents(docs, is_held()).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert (r[0] - r[1]) / r[2] > 0.2 and r[3] > 0.95


def test_order_of_words_counts(spark):
    train = [(k, " ".join(["a b c d e f"] * 20)) for k in range(300)]
    ask = [(10_000 + k, t) for k, t in enumerate(("a b c d e f a b c d e f", "f a e b d c c f b d a e"))]
    docs = spark.createDataFrame(train + ask, "doc_id long, text string")
    a, b = (r["score"] for r in m.score_documents(docs, F.col("doc_id") >= 10_000).filter("held_out").orderBy("doc_id").collect())
    assert a > b + 5


def test_without_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert m.score_documents(docs.limit(0), is_held()).count() == 0
    (r,) = m.score_documents(docs, F.lit(True)).collect()
    assert tuple(r)[:6] == (1, True, 3, 0, 0, 0.0) and r["score"] <= 0


def test_classes_are_of_equal_size():
    x = np.random.default_rng(1).normal(size=(2048, 5))
    assert np.bincount(m.balanced(x, 32)).tolist() == [64] * 32
    assert max(np.bincount(m.balanced(x[:100], 32))) <= m.CLASS_WORDS
    assert m.balanced(x[:1], 32).tolist() == [0]


def test_long_texts_are_cut_at_white_space():
    t = b"ab c\tdE\n" * 1000
    assert [w for p in m.words_of(t, 50) for w in p] == t.lower().split()
    assert list(m.words_of(b"x" * 200, 50)) == [[b"x" * 200]]
