from pyspark.sql import functions as F

from kelpie.llm.common import blocks, code_points, labelled_sample, shared_dir, stored


def test_sample_is_bounded_and_keeps_out_what_is_held(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in range(50)] + [(3, "again", "x")] * 40 + [(None, "n", "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 1)] * 5 + [(None, 1), (7, None), (8, 9)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.col("doc_id") % 5 == 0, 6).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 12
    assert sum(r["y"] for r in rows) == 6 and all(r["doc_id"] % 5 for r in rows)
    everything = labelled_sample(docs, labels, "toxic", F.lit(False), 1000).collect()
    assert {r["doc_id"]: r["text"] for r in everything}[3] == "again"
    assert labelled_sample(docs.limit(0), labels, "toxic", F.lit(False), 5).count() == 0


def test_blocks_cover_all_texts():
    texts = ["a" * n for n in (0, 5, 3, 0, 9, 1)]
    spans = list(blocks(texts, 5))
    assert [i for lo, hi in spans for i in range(lo, hi)] == list(range(6))
    assert list(blocks([], 5)) == []
    assert code_points("a\U0001d4b3é").tolist() == [97, 0x1D4B3, 233]


def test_stored_frames_read_back(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert sorted(map(tuple, stored(df, "x").collect())) == [(1, None), (2, "b")]
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
