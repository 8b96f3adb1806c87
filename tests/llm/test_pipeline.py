import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from kelpie.llm import decontamination
from tests.llm.test_decontamination import smith_waterman
from tests.llm.test_line_dedup import brute as dedup
from tests.llm.test_near_duplicates import brute as classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, n_lines string, head string, node string, length string"


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert sum(i in rows for i, q in labels.items() if q) >= 0.98 * sum(labels.values())
            assert sum(i in rows for i, q in labels.items() if not q) <= 0.1 * sum(1 - q for q in labels.values())
        if name == "line_dedup":
            assert {i: r["text"] for i, r in rows.items()} == {x[0]: x[3] for x in dedup(before, 10)}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "near_duplicates":
            assert set(rows) == {x[1] for x in classes(before)}
        if name == "decontamination":
            items = [decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            for i, t in before:
                w = decontamination.words_of(t)
                if i not in rows or i % 20 == 0:
                    assert (i not in rows) == any(len(set(x) & set(w)) >= decontamination.needed(len(x)) - 4 and smith_waterman(x, w) >= decontamination.needed(len(x)) for x in items)
        if name == "packing":
            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            sizes = {}
            for r in out.collect():
                sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
            assert sizes == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in before}
        seen[name] = len(rows)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert seen["quality"] > seen["near_duplicates"] >= seen["decontamination"] > 0
    whole = cp.run(spark, sf)
    assert whole.count() == docs.count() and whole.columns == docs.columns


def test_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    rng = random.Random(1)
    text = " ".join(rng.choice(["of", "the", "and", "ing", "tion", "er"]) * rng.randint(1, 2) for _ in range(90)) + "."
    rows = [(None, text, "en", "a", 5), (1, text, None, None, None), (1, text, None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, text + " " + text.upper() * 400, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
            assert all(tuple(r)[5:] == tuple("abcdef") for r in out.collect())
        assert out.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = cp.one_of_each_class(spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 4]


def test_one_row_of_each_class_with_repeated_and_null_ids(spark):
    rng = random.Random(8)
    base = lambda k: " ".join(f"b{k}x{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, e, f = map(base, "abcef")
    rows = [(1, a), (1, a + " end"), (1, a), (2, b), (3, b + " end"), (3, c), (None, e), (None, e + " end"), (None, a + " fin"), (None, f), (4, f + " end"), (5, "one"), (5, "two")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), *"abcdef") for i, t in rows], SCHEMA)
    out = cp.one_of_each_class(spark, docs, "")
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert all(tuple(r)[5:] == tuple("abcdef") for r in out.collect())
    near = lambda t, own: [i for i, x in kept if x.startswith(own)] == t
    assert near([1], a) and near([2], b) and near([3], c) and near([None], e) and near([4], f)
    assert sorted(t for i, t in kept if i == 5) == ["one", "two"] and len(kept) == 7
