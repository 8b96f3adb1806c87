import random

import pytest

from kelpie.api import Engine
from kelpie.operators import impacts


@pytest.mark.parametrize("block_docs", [1, 7, 500])
def test_skipping_blocks_loses_nothing(spark, block_docs):
    rng = random.Random(block_docs)
    topics = [[f"t{k}w{j}" for j in range(8)] for k in range(12)]
    docs = [(k, " ".join(rng.choices(topics[k % 12], k=rng.randrange(1, 30)) + rng.choices(["common", "often"], k=3))) for k in range(400)] + [(900, ""), (901, None), (902, "t3w1 " * 50), (903, "t3w1 " * 50)]
    postings = impacts.impact_postings(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    index = impacts.build(postings, "doc_id", block_docs)
    terms = impacts.query_impacts(spark, [(0, "t3w1 t3w2 often"), (1, "t5w0 t5w0 t6w1"), (2, "nothing here"), (3, "common"), (4, "")])
    whole = {q: [] for q in range(5)}
    for r in impacts.scores(index, terms).collect():
        whole[r["query_ord"]].append((-r["score"], r["doc_id"]))
    want = sorted((q, d, -s, n + 1) for q, rows in whole.items() for n, (s, d) in enumerate(sorted(rows)[:5]))
    assert sorted(map(tuple, impacts.impact_top_k(index, terms, 5).select("query_ord", "doc_id", "score", "rank").collect())) == want
    assert {q for q, *_ in want} == {0, 1, 3}


def test_closed_blocks_are_not_read(spark):
    docs = [(k, " ".join([f"topic{k % 40}", "x"] * (1 + k % 9))) for k in range(2000)]
    index = impacts.build(impacts.impact_postings(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"), "doc_id", 25)
    terms = impacts.query_impacts(spark, [(0, "topic7 x")])
    reach = impacts.reachable_blocks(index, terms, 5)
    touched = impacts.bounds(index, terms)
    assert reach.count() * 3 < touched.count()
    assert max(r["n"] for r in index.blocks.selectExpr("size(entries) AS n").collect()) < 60


def test_impacts_do_not_depend_on_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"word{k * j % 13}" for j in range(k % 7))) for k in range(60)], "k long, t string").coalesce(1)
    want = sorted(map(tuple, impacts.impact_postings(df, "k", "t").collect()))
    monkeypatch.setattr(impacts, "PIECE_TOKENS", 3)
    assert want and sorted(map(tuple, impacts.impact_postings(df, "k", "t").collect())) == want


def test_a_model_plugs_in(spark):
    model = lambda words: {w: 0.0 if w == "void" else float(len(w)) for w in set(words)}
    postings = impacts.impact_postings(spark.createDataFrame([(1, "ab void abcdefghij" * 1)], "doc_id long, text string"), "doc_id", "text", model)
    assert sorted(r["impact"] for r in postings.collect()) == [64, 255]


def test_sparse_modes_of_an_index(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# Alpha\nretries and timeouts of orders\n")
    (src / "b.md").write_text("# Beta\nsomething about shipping\n")
    learned = Engine(spark, str(tmp_path / "learned"), sparse_mode="learned")
    learned.index(str(src))
    assert learned.quick_search("rets", "keyword", 3).count() == 0 and learned.quick_search("retrieved", "keyword", 3).first()["file_path"].endswith("a.md")
    assert learned.quick_search("retries", "keyword", 3, {"category": ["docs"]}).count() <= 1
    off = Engine(spark, str(tmp_path / "off"), sparse_mode="disabled")
    off.index(str(src))
    assert off.quick_search("retries", "keyword", 3).count() == 0 and off.quick_search("retries of orders", "hybrid", 1).count() == 1
    assert Engine(spark, str(tmp_path / "off")).idx.needs_rebuild() and not off.idx.needs_rebuild()
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "x"), sparse_mode="other")
