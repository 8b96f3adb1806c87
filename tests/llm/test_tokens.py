import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kelpie.llm import packing, token_files
from kelpie.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  a", "a ", "a  b", "a \n b\n\nc ", "\tx\x1c y", "don't  we'll", "é é́ ́x", "x" * 500 + " y", " a  b", "<|endoftext|> a<|endoftext|>", "ΑΣ ΑΣ", "日本 語", "a\n", "\n a"]


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "space"), [(BYTE, True), (WORD, False)])
def test_pieces_equal_whole_texts(path, space):
    enc, ref = Encoder(path, space), plain(path)
    for _ in range(2):
        assert [x.tolist() for x in enc.batch(ODD)] == [ref(x) for x in ODD]

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("aB1 .\n\t'sé́ \x1c日")), max_size=30), max_size=4))
    def check(texts):
        assert [x.tolist() for x in enc.batch(texts)] == [ref(x) for x in texts]

    check()


LONG = ["a" * 10_000 + "1", "日本語" * 4000 + "2024年" * 50, "https://example.org/" + "path/" * 2000 + "?" + "key=1&" * 2000, "9" * 100_000, "a-" * 20_000 + "1", "é" * 10_000 + "1"]


@pytest.mark.parametrize(("path", "space"), [(BYTE, True), (WORD, False)])
@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:12])
def test_long_pieces_take_time_in_proportion(path, space, text):
    enc, ref = Encoder(path, space), plain(path)
    began = time.process_time()
    got = enc.batch([text, f"x {text} y"])
    assert time.process_time() - began < 1
    assert [x.tolist() for x in got] == [ref(text), ref(f"x {text} y")]


def rows_of(spark, sf):
    extra = [(None, "null id", 1), (10**6, None, 2), (10**6 + 1, "", 3), (10**6 + 2, "dup", 4), (10**6 + 2, "dup", 4), (10**6 + 3, "word " * 9000, 5)]
    own = [(r["doc_id"], r["text"], 0) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return own + extra


def test_token_files_round_trip(spark, sf):
    rows = rows_of(spark, sf)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)  # a clashing name
    shards = token_files.write_tokens(docs, BYTE)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(shards).collect())
    ref, at, want = plain(BYTE), 0, []
    stream = []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ref(t or ""), 0]
        stream += ids
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    few = token_files.write_tokens(docs, BYTE, shard_ids=5000)
    assert few.count() > 5 and few.filter("n_tokens < 5000").count() <= 5  # a task's last one may be short
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(few).collect()) == want
    named = docs.selectExpr("cast(doc_id as string) AS doc_id", "text")
    assert sorted((r["doc_id"] or "", r["ids_crc32"]) for r in token_files.read_tokens(token_files.write_tokens(named, BYTE), "string").collect()) == sorted(("" if x[1] is None else str(x[1]), x[3]) for x in want)
    flat = []
    for s in sorted(shards.collect()):
        reader = token_files.ShardReader(s["folder"], s["shard"])
        for i in range(len(reader)):
            assert len(reader.ids(i)) == token_files.SEQUENCE
            flat += reader.ids(i)[reader.mask(i)].tolist()
    assert flat == stream
    folder = shards.first()["folder"].removeprefix("file://")
    names = {r["shard"] for r in shards.collect()}
    call = min(names).split("-")[0]
    Path(folder, f"tokens-{call}-000000-00000-dead.arrows").touch()
    Path(folder, "tokens-other-000000-00000-live.arrows").touch()
    token_files.sweep(f"file://{folder}", call, names)
    assert len(list(Path(folder).iterdir())) == 2 * len(names) + 1
    empty = token_files.write_tokens(docs.limit(0), BYTE)
    assert token_files.read_tokens(empty).count() == 0


def test_packing(spark, sf):
    rows = rows_of(spark, sf)
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(docs, WORD).collect()
    ref, want = plain(WORD), []
    for i, t, _ in rows:
        ids = [*ref(t or ""), 0]
        want += [(i, k // 2048, k, len(p := ids[k : k + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted([tuple(r)[:5] for r in got], key=lambda x: (x[0] or -1, *x[1:])) == sorted(want, key=lambda x: (x[0] or -1, *x[1:]))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_is_best_fit(counts):
    runs = packing.plan_best_fit(counts, 64)
    bins, seen = {}, {k: [] for k in counts}
    for length, a, b, first, offset, each in runs.tolist():
        seen[length] += range(a, b)
        for r in range(b - a):
            bins.setdefault(first + r // each, []).append((offset + r % each * length, length))
    assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items())
    rooms = []
    for length in sorted(counts, reverse=True):  # the same one by one
        for _ in range(counts[length]):
            fit = [i for i, r in enumerate(rooms) if r >= length]
            if fit:
                i = min(fit, key=lambda i: rooms[i])
                rooms[i] -= length
            else:
                rooms.append(64 - length)
    assert len(bins) == len(rooms)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
