import random
import re

from pyspark.sql import functions as F

from kelpie.llm import quality_rules as q

WORD = re.compile("[^ \t-\r]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(covered)


TEXTS = [None, "", " \n\t ", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n x\ny\n\n\n", "é\x1c𝒳 日本\xa0x #|<> ** \x0b\x0c z", "one two three " * 40, "w " * 30_000, "a\r\nb\r\nb\r\n", "a b c d a b x b c d"]


def test_statistics(spark, sf):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)]
    rows += [(r["doc_id"] + 100, r["text"], 5) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = q.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words int"))
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), i
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def plain_posterior(names, rates, r):
    odds = rates.share / (1 - rates.share)
    for k in names:
        odds *= rates.good[k] / rates.bad[k] if r[k] > 0 else (1 - rates.good[k]) / (1 - rates.bad[k]) if r[k] < 0 else 1
    return odds / (1 + odds)


def test_expectation_maximisation(spark, sf):
    names = list(q.rules())
    rows = q.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    rates = q.begin(names)
    for _ in range(40):
        ps = [plain_posterior(names, rates, r) for r in rows]
        s = {"n": len(rows), "p": sum(ps)}
        for k in names:
            s |= {f"{k}_yes_p": sum(p for p, r in zip(ps, rows, strict=True) if r[k] > 0), f"{k}_yes": sum(r[k] > 0 for r in rows)}
            s |= {f"{k}_all_p": sum(p for p, r in zip(ps, rows, strict=True) if r[k]), f"{k}_all": sum(r[k] != 0 for r in rows)}
        rates = q.improved(names, s)
    assert all(abs(plain_posterior(names, rates, r) - r["quality"]) < 1e-3 for r in rows)


def test_posterior_beats_the_plainer_rules(spark):
    """Rates that we know: a noisy rule that condemns good documents, and junk that one rule alone sees."""
    rng = random.Random(3)
    names = list(q.rules())
    noisy, rows = names[-1], []
    for _ in range(5000):
        good = rng.random() < 0.8
        kind = None if good else rng.choice(names[:-1])
        vote = {k: -1 if rng.random() < (0.95 if k == kind else 0.15 if k == noisy else 0.002 if good else 0.03) else rng.choice([1, 1, 1, 0]) for k in names}
        rows.append((*vote.values(), good))
    df = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in names) + ", good boolean")
    patterns = df.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    rates = q.estimate(patterns, names)
    assert abs(rates.share - 0.8) < 0.1 and rates.good[noisy] < 0.95 < min(rates.good[k] for k in names[:-1])
    judged = df.select("*", q.posterior(names, rates).alias("p")).collect()
    right = lambda says: sum(says(r) == r["good"] for r in judged) / len(judged)
    ours = right(lambda r: r["p"] >= 0.5)
    assert ours > 0.96
    assert ours > right(lambda r: all(r[k] >= 0 for k in names)) + 0.05
    assert ours > right(lambda r: sum(r[k] for k in names) > 0) + 0.05


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    judged = q.judge(spark.read.parquet(f"{sf}/documents.parquet")).drop("quality")
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def test_empty(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
