import random
from datetime import date
from decimal import Decimal

import numpy as np

from kelpie.llm import decontamination as d


def smith_waterman(item, passage):
    h = [[0.0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0.0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a == b else d.MISMATCH), h[i - 1][j] - d.GAP, h[i][j - 1] - d.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 25))
        score, end = d.align(a, b)
        assert abs(score - smith_waterman(a, b)) < 1e-9 and 0 <= end <= len(b)


def brute(docs, items):
    """All pairs, aligned over whole texts."""
    out = []
    for i, t in docs:
        w = d.words_of(t)
        for k, x in items:
            own = d.words_of(x)
            if 0 < len(own) < d.GRAM and own == w:
                out.append((i, k, 1.0))
            if len(own) >= d.GRAM and len(w) >= d.GRAM and (s := smith_waterman(own, w)) >= d.needed(len(own)) - 1e-9:
                out.append((i, k, round(s / len(own), 9)))
    return sorted(out, key=str)


def rows(spark, docs, items):
    a = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    return a, b


def test_planted_copies(spark):
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.6))}"
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rng.randrange(12, 40)))) for k in range(25)] + [(90, "ab cd"), (91, None), (92, ""), (93, "The same, item text, here again!"), (94, "the same item text here again")]
    docs = []
    for i in range(60):
        w = text(rng.randrange(0, 150))
        if i % 2:
            own = items[rng.randrange(25)][1].split()
            for _ in range(len(own) // 12):  # an edited copy
                own[rng.randrange(len(own))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((i, " ".join(w)))
    docs += [(101, "twice: the same item text here again"), (101, "twice: the same item text here again"), (None, "so THE same\nitem text - here again"), (107, None), (108, ""), (110, "AB, cd!"), (111, "ab cd ef"), (109, "long word " * 30_000)]
    a, b = rows(spark, docs, items)
    got = d.find_leaks(a, b).collect()
    want = brute(docs[:-1], items)
    found = sorted(((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in got), key=str)
    assert found == want
    assert len(found) > 30
    by_id = dict(docs)
    for r in got:
        part = d.words_of(by_id[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words"]]
        own = d.words_of(dict(items)[r["item_id"]])
        assert abs(smith_waterman(own, part) / len(own) - r["score"]) < 1e-9
    kept = d.decontaminate(a, b)
    assert kept.columns == a.columns
    bad = {x[0] for x in found}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((x for x in docs if x[0] not in bad), key=str)


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = [(i, f"some words before item number {i} of the list of all of the items and after") for i in range(8)]
    items = [(i, f"item number {i} of the list of all of the items") for i in range(8)]
    a, b = rows(spark, docs, items)
    one = sorted(map(tuple, d.find_leaks(a, b).collect()))
    monkeypatch.setattr(d, "BLOCK_WORDS", 1)
    assert sorted(map(tuple, d.find_leaks(a, b).collect())) == one
    assert d.decontaminate(a, b).count() == 0
    assert d.find_leaks(a.limit(0), b).count() == 0 and d.find_leaks(a, b.limit(0)).count() == 0
    assert d.decontaminate(a, b.limit(0)).count() == 8


def test_part_of_a_long_item(spark):
    item = " ".join(f"item{k}" for k in range(60))
    part = lambda n: "before " + " ".join(f"item{k}" for k in range(20, 20 + n)) + " after"
    a, b = rows(spark, [(1, part(15)), (2, part(16)), (3, part(30))], [(7, item)])
    assert sorted((r["doc_id"], r["first_word"], r["n_words"]) for r in d.find_leaks(a, b).collect()) == [(2, 1, 16), (3, 1, 30)]


def edited(rng, own, way, step):
    """A copy with a new word in place of, after, or without every step-th word, or so many places at random."""
    new = lambda: f"n{rng.randrange(10**6)}"
    at = set(rng.sample(range(len(own)), len(own) // step)) if way == "random" else {k for k in range(len(own)) if k % step == step - 1}
    out = []
    for k, w in enumerate(own):
        out += [w] if k not in at else [w, new()] if way == "insert" else [] if way == "delete" else [new()]
    return out


def test_recall_by_edit_rate(spark):
    """Copies with up to so many of a hundred words replaced, dropped or added; a copy is what whole texts' alignment finds."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 60)))) for k in range(25)]
    docs = []
    for rate in (0.1, 0.2, 0.3, 0.4, 0.5):
        for _, t in items:
            own = []
            for w in t.split():
                x = rng.random()
                own += [w] if x >= rate else rng.choice([[], [rng.choice(words)], [w, rng.choice(words)]])
            docs.append((len(docs), " ".join([rng.choice(words) for _ in range(20)] + own + [rng.choice(words) for _ in range(20)])))
    a, b = rows(spark, docs, items)
    found = sorted(((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in d.find_leaks(a, b).collect()), key=str)
    assert found == brute(docs, items)  # nothing that aligning whole texts finds is lost
    caught = [sum(x[0] // 25 == k and x[0] % 25 == x[1] for x in found) / 25 for k in range(5)]
    assert min(caught[:4]) >= 0.9  # beyond 40 edits of a hundred words copies fall below the score


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([(Decimal(1), "one two three four five six seven eight")], "doc_id decimal(5,0), text string")
    items = spark.createDataFrame([(date(2024, 1, 2), "two three four five six seven")], "item_id date, text string")
    assert [tuple(r)[:2] for r in d.find_leaks(docs, items).collect()] == [(Decimal(1), date(2024, 1, 2))]


def test_edits_everywhere_leave_seeds(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([40] * 12 + [12, 20, 57])]
    ways = [("replace", 4), ("replace", 3), ("insert", 3), ("insert", 2), ("insert", 1), ("delete", 3), ("random", 5), ("random", 4), ("random", 3)]
    docs = []
    for way, step in ways:
        for k, t in items:
            around = lambda: [rng.choice(words) for _ in range(30)]
            docs.append((len(docs), " ".join(around() + edited(rng, t.split(), way, step) + around())))
    for more in ([], [(70, "eight words that make the reach go further"), (71, " ".join(f"long{k}" for k in range(90)))]):
        a, b = rows(spark, docs, items + more)
        found = sorted(((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in d.find_leaks(a, b).collect()), key=str)
        assert found == brute(docs, items + more)
        assert len(found) > 0.9 * len(docs)
        assert d.decontaminate(a, b).count() == len(docs) - len({x[0] for x in found})
