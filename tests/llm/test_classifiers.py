import zlib

import numpy as np
import pytest

from kelpie.llm import language, quality_model, toxicity
from kelpie.llm.queries import QUERIES

ODD = [None, "", " \n ", "!!!", "word", "De " * 300, "x" * 200_000, "é日\x00\x1c a", "a b c " * 40_000]


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    y = np.asarray(y, bool)
    return (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


# what sf0.1 misses is junk whose words were overwritten after labelling; sf0.01 has 33 toxic documents to learn from
@pytest.mark.parametrize(("name", "label", "sf", "least"), [("op1_toxicity", "toxic", "sf0.1", 0.95), ("op1_toxicity", "toxic", "sf0.01", 0.85), ("op2_quality_model", "quality", "sf0.01", 0.98)])
def test_held_out_documents(spark, name, label, sf, least):
    sf = f"/root/testdata/{sf}"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.7 if label == "toxic" else 0.5))
    own = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(*(np.array(x) for x in zip(*own, strict=True))) >= least


def plain_logit(model, text):
    """The document's logit by loops."""
    words = toxicity.WORDS.findall(text.lower())
    own = [w for k, w in enumerate(words) if w not in words[max(0, k - toxicity.WINDOW + 1) : k]]
    score = {w: float(np.mean(model.weight[toxicity.gram_ids([w])[0]].astype(float))) for w in set(own)}
    half, m = toxicity.WINDOW // 2, []
    for lo in range(0, max(1, len(own) - half), half):
        part = [score[w] for w in own[lo : lo + toxicity.WINDOW]]
        m.append((sum(part) / len(part) if part else 0.0) + model.bias)
    return float(np.log(np.mean(np.exp(m))))


def test_scores_equal_loops():
    rng = np.random.default_rng(2)
    m = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), 0.3, 1.5, -0.2)
    texts = ["", "a", "a a a", *(" ".join(f"w{x}" for x in rng.integers(0, 200, n)) for n in (5, 47, 48, 49, 72, 73, 500)), "same " * 300 + "other"]
    got = m.scores(texts)
    for t, s in zip(texts, got, strict=True):
        assert abs(s - 1 / (1 + np.exp(-(plain_logit(m, t) * 1.5 - 0.2)))) < 1e-6


def test_joint_training_carries_the_signal():
    rng = np.random.default_rng(4)
    words = [f"word{k}x" for k in range(400)]
    text = lambda bad: " ".join(rng.permutation([*rng.choice(words, 60), *(rng.choice(["scoundrel", "rascally", "villainous"], 2) if bad else [])]))
    rows = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(400)]
    seen, new = rows[:240], rows[240:]
    found = {steps: auc(toxicity.train([t for t, _ in seen], [y for _, y in seen], steps=steps).scores([t for t, _ in new]), [y for _, y in new]) for steps in (0, 400)}
    assert found[0] < 0.7 and found[400] > 0.95


def test_misspellings_share_subwords():
    clean = [f"plain words and number {i} of them here" for i in range(80)]
    bad = [f"plain words you idiot number {i} here" for i in range(80)]
    m = toxicity.train(clean + bad, [0] * 80 + [1] * 80)
    low, high, misspelt = m.scores(["plain words and number of them", "you idiot", "you idiiot"])
    assert low < 0.5 < misspelt <= high


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_odd_texts_and_missing_labels(spark, module):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(None, "null id", 0.1), (3, "twice", 0.1), (3, "twice", 0.1)], "doc_id long, text string, score double")
    label = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0), (4, 7)], f"doc_id long, {label} int")
    out = toxicity.score_texts(docs, module.fit(docs, labels, label)).collect()
    assert len(out) == len(ODD) + 3 and {r["score"] for r in out} == {0.5}
    rows = [(i, f"{'good words here' if i % 2 else '### $$$ bad'} {i}") for i in range(40)]
    model = module.train([t for _, t in rows], [i % 2 for i, _ in rows])
    got = toxicity.score_texts(docs, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["text"] == "twice"}) == 1
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_additive_scores_equal_loops_and_pairs_help(monkeypatch):
    rng = np.random.default_rng(6)
    model = quality_model.AdditiveModel([np.array([0.0, 1.0]), np.array([0.5])], [rng.normal(size=3), rng.normal(size=2)], [(1, 0, rng.normal(size=(2, 3)))], 0.2)
    x = np.array([[-1, 0], [0, 0.5], [0.5, 2], [1, 0.4], [9, 9]], float)
    for row, got in zip(x, model.log_odds(model.bins(x)), strict=True):
        i, j = sum(e <= row[0] for e in model.edges[0]), sum(e <= row[1] for e in model.edges[1])
        assert abs(got - (0.2 + model.single[0][i] + model.single[1][j] + model.pairs[0][2][j, i])) < 1e-12
    # good is either both features high or both low: no single one tells
    monkeypatch.setattr(quality_model, "features", lambda t: [*map(float, t.split()), *[0.0] * (len(quality_model.FEATURES) - 2)])
    rows = [(f"{a} {b}", int((a < 5) == (b < 5))) for a, b in rng.integers(0, 10, (600, 2))]
    alone, both = (auc(quality_model.train([t for t, _ in rows], [y for _, y in rows], rounds=40, n_pairs=n).scores([t for t, _ in rows]), [y for _, y in rows]) for n in (0, 4))
    assert both > 0.97 and both > alone + 0.1


def test_additive_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 8, (2, 4000))
    g = np.where((i < 4) == (j < 4), 1.0, -1.0)
    n = np.bincount(i * 8 + j, minlength=64).reshape(8, 8)
    table, gain = quality_model.pair_step(np.bincount(i * 8 + j, g, 64).reshape(8, 8), n.astype(float))
    assert gain > 1000 and (np.sign(table[:4, :4]) == 1).all() and (np.sign(table[:4, 4:]) == -1).all()
    step = quality_model.tree_step(np.array([5.0, 5, -5, -5, 5]), np.full(5, 10.0))
    assert step[0] > 0 > step[2] and step[4] > 0


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_language"](spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_language_logits_equal_loops():
    m = language.train(["the cat and the dog", "der Hund und die Katze", "le chat et le chien"] * 7, ["en", "de", "fr"] * 7)
    for t in ("the dog", "Katze  und\nHund", "x"):
        at, n = language.counts(t)
        x = {int(k): (1 + np.log(c)) * m.idf[k] for k, c in zip(at, n, strict=True)}
        norm = np.sqrt(sum(v * v for v in x.values()))
        want = [m.bias[j] + sum(v / norm * m.weight[k, j] for k, v in x.items()) for j in range(3)]
        assert np.allclose(m.logits(t), want)
    assert (m.weight == 0).mean() > 0.9  # the lasso part keeps most weights at zero


def test_language_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, lang_pred string")
    model = language.train(["the cat and the dog", "der Hund und die Katze"] * 10, ["en", "de"] * 10)
    out = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert {i for i, r in out.items() if r["lang_pred"] == "und"} == {0, 1, 2, 3}
    assert all(r["score"] == 0 for r in out.values() if r["lang_pred"] == "und")
    assert language.train([], []).predict(["a"]) == (["und"], [0.0])
    assert language.train(["a"], ["en"]).predict(["abc"]) == (["en"], [1.0])
    whole = language.counts("abc " * 3000)
    parts = language.counts("abc " * 3000, step=1000)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
