import hashlib
from collections import Counter

import numpy as np
import pytest

from kelpie.llm import line_dedup
from kelpie.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, counted=None):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    df = Counter(k for _, t in (rows if counted is None else counted) for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if df[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [(1, "Same Line\nown one\n\n  "), (2, " same line\t\nSAME LINE\nÉx"), (3, "same line\néx\nÉx"), (4, None), (5, ""), (6, "\n\n"), (7, "same line"), (7, "same line"), (None, "own one\nx "), (8, "long " * 50_000 + "\nown one")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_lines int")


def out(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=str)


def test_brute_force(spark, sf):
    own = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for rows, least in ((ROWS, 2), (ROWS, 3), (own, 2), (own, 10)):
        assert out(dedup_lines(frame(spark, rows), least)) == brute(rows, least)
    assert dedup_lines(frame(spark, ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("keys_per_shard", [10**6, 2])
def test_filters_beyond_a_task(spark, sf, monkeypatch, keys_per_shard):
    monkeypatch.setattr(line_dedup, "MAX_FILTER_BYTES", -1)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", keys_per_shard)
    monkeypatch.setattr(line_dedup, "held", None)  # no filter comes to the driver
    own = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    monkeypatch.setattr(line_dedup, "HOT_TEXTS", 20)
    hot = [*own, *((10**6 + k, own[k % 2][1]) for k in range(100)), *((10**7 + k, "") for k in range(60))]
    for rows, least in ((ROWS, 2), (own, 2), (hot, 3)):
        assert out(dedup_lines(frame(spark, rows), least)) == brute(rows, least)


def test_an_index_is_opened_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lines")
    LineIndex(spark, path, min_docs=2).insert(frame(spark, ROWS[:4]))
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 0.3)  # the shards split
    index = LineIndex(spark, path, min_docs=2)
    index.insert(frame(spark, ROWS[4:]))
    assert index.state["shards"] > 8
    assert out(LineIndex(spark, path, min_docs=2).drop(frame(spark, ROWS))) == brute(ROWS, 2)
    before = index.state
    with pytest.raises(ValueError, match="doesn't hold"):
        index.delete(frame(spark, [(99, "never inserted")]))
    with monkeypatch.context() as m:
        m.setattr(LineIndex, "_mark", lambda self, state: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.insert(frame(spark, ROWS))
    assert index.state == before
    assert out(index.drop(frame(spark, ROWS))) == brute(ROWS, 2)


def test_an_index_keeps_its_bound(spark, tmp_path):
    path = str(tmp_path / "lines")
    LineIndex(spark, path, min_docs=10).insert(frame(spark, [(k, "shared\nown") for k in range(7)]))
    with pytest.raises(ValueError, match="min_docs=10, not 5"):
        LineIndex(spark, path, min_docs=5)
    index = LineIndex(spark, path, min_docs=10)
    more = [(k, "shared\nelse") for k in range(7, 11)]
    index.insert(frame(spark, more))
    assert [r["n_dropped"] for r in index.drop(frame(spark, more)).collect()] == [1] * 4


def test_wrong_hits_are_listed():
    keys = np.frombuffer(b"".join(hashlib.md5(str(i).encode()).digest() for i in range(40)), "<i8").reshape(-1, 2)
    f = CuckooFilter.sized(40)
    f.insert(keys)
    probe = line_dedup.Probe({0: (f.to_bytes(), b"".join(k.astype(">i8").tobytes() for k in keys[10:]))}, 1)
    assert probe(keys).tolist() == [True] * 10 + [False] * 30


def test_inserts_and_deletions_undo_each_other(spark):
    index = LineIndex(spark, min_docs=2)
    index.insert(frame(spark, ROWS[:4]))
    assert out(index.drop(frame(spark, ROWS[:4]))) == brute(ROWS[:4], 2)
    before = sorted(map(tuple, index.counts.collect()))
    index.insert(frame(spark, ROWS[4:]))
    assert out(index.drop(frame(spark, ROWS))) == brute(ROWS, 2)
    index.delete(frame(spark, ROWS[4:]))
    assert sorted(map(tuple, index.counts.collect())) == before
    assert out(index.drop(frame(spark, ROWS[:4]))) == brute(ROWS[:4], 2)


@pytest.mark.parametrize("n", [1, 100, 50_000])
def test_cuckoo_filter(n):
    keys = np.frombuffer(b"".join(hashlib.md5(str(i).encode()).digest() for i in range(2 * n)), "<i8").reshape(-1, 2)
    f = CuckooFilter.sized(n)
    assert f.insert(keys[:n])
    assert f.contains(keys[:n]).all()
    assert f.contains(keys[n:]).sum() <= 2
    half = n // 2
    f.delete(keys[:half])
    assert f.contains(keys[half:n]).all()
    assert f.contains(keys[:half]).sum() <= 2
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(keys[half:n]).all()
