"""Quality statistics, decision lists, the n-gram model, and the pipeline."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality_lm, quality_rules

NASTY = [
    (1, "a b c d e f g h " * 5),
    (2, None),
    (3, ""),
    (4, "\x0b \n \x1f"),
    (5, "x\ny\nx\n\n \nx"),
    (6, "one two three"),
    (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5 w6 w7 w8 tail"),
    (8, "#*$%&|<> ÀÉ! ß 👍"),
    (9, " ".join(f"u{i}" for i in range(30_000))),
    (9, "one two three"),
    (None, "no id here"),
    (10, "z " * 20_000),
]


def slow_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in NASTY], "doc_id long, text string, n_words int, __q string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.judged(docs, none).collect()
    got = sorted((str(r.doc_id), *(r[s] for s in quality_rules.STATS), r.base_failed) for r in rows)
    assert got == sorted((str(i), *slow_stats(t)) for i, t in NASTY)
    assert all(r.kept == (not r.base_failed) for r in rows)
    kept = quality_rules.kept(docs, none)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in NASTY if not slow_stats(t)[5])


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "of", "river", "stone", "walks", "under", "green", "morning", "light", "and", "slowly", "house", "garden", "wind"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(40, 120)))
        bad = i % 5 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(w + "###" for w in text.split())
        docs.append((i, text, "en" if i % 3 else "de"))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_decision_list(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judged(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id < 400")).collect()}
    held = [(got[i].kept, bool(q)) for i, q, _ in labels if i >= 400]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert not any(got[i].rule for i, q, _ in labels if q)


def test_one_kind_of_label_gives_no_rules(spark):
    docs, _ = corpus(50)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    assert all(r.rule is None for r in quality_rules.judged(d, labels).collect())


def kneser_ney(grams, order, size, query):
    """P(query) by the formulas, recursively."""
    counts = {order: collections.Counter(grams)}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    ds = {}
    for k, c in counts.items():
        n = collections.Counter(c.values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            ds[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i) for i in (1, 2, 3)]
        else:
            ds[k] = [0.5, 1.0, 1.5]

    def p(g):
        if not g:
            return 1 / size
        k = len(g)
        own = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        d = lambda n: ds[k][min(n, 3) - 1]
        taken = sum(d(n) for n in own.values())
        n = own.get(g, 0)
        return (max(n - d(n), 0) if n else 0) / total + taken / total * p(g[1:])

    return p(query)


def test_kneser_ney(spark):
    rng = random.Random(1)
    texts = [("".join(rng.choice("aabbbc ") for _ in range(40)),) for _ in range(12)]
    df = spark.createDataFrame(texts, "text string")
    order, size = 3, 6
    letters = quality_lm.letters_of(df, 1.0)
    counts = quality_lm.gram_counts(df, letters, order, size).cache()
    tables = quality_lm.train(counts, order, size)
    table = np.exp(quality_lm.dense(tables, size))
    digits = lambda g: tuple(g // size**k % size for k in range(order - 1, -1, -1))
    grams = [digits(r.gram) for r in counts.collect() for _ in range(r.n)]
    for g in range(size**order):
        assert table[g] == pytest.approx(kneser_ney(grams, order, size, digits(g)), rel=1e-4), digits(g)
    # every context's probabilities sum to one
    assert np.allclose(table.reshape(-1, size).sum(axis=1), 1, atol=1e-4)


def test_grams():
    tool = quality_lm.Symbols([ord("a"), ord("b")], 3)
    codes, seen, own = tool.grams(pa.array(["ab", "", " ", "a  b", "z"]), 10)
    assert own.tolist() == [3, 1, 2, 4, 2]
    assert seen.tolist() == [3, 0, 0, 4, 2]
    assert codes.tolist()[:3] == [113, 134, 341]
    assert codes.tolist()[6:10] == [113, 132, 324, 241]


def test_score_by_join_agrees(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model, texts = quality_lm.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), order=3)
    assert texts.count() == sum(q for _, q, _ in labels)
    a = {r.doc_id: r.s for r in d.select("doc_id", model.score("text").alias("s")).collect()}
    b = {r.doc_id: r.score for r in quality_lm.score_by_join(d, model, shards=3).collect()}
    assert a.keys() == b.keys()
    assert all(a[i] == pytest.approx(b[i], rel=1e-4) for i in a)


def test_classifier(spark):
    docs, labels = corpus(500)
    odd = [(1000, None, None), (1001, "", "en"), (1002, "  \n", "fr"), (1003, docs[1][1], "xx"), (1003, docs[1][1], "xx"), (None, docs[2][1], "en"), (1004, "the river " * 20_000, "en")]
    d = spark.createDataFrame([(*r, "p", 1.0) for r in docs + odd], "doc_id long, text string, lang string, perplexity string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality_lm.judged(d, lab.where("doc_id < 300"), order=3).collect()
    got = {r.doc_id: r.kept for r in rows}
    held = [(got[i], bool(q)) for i, q, _ in labels if i >= 300]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert [got[i] for i in (1000, 1001, 1002, 1003, None)] == [False, False, False, True, True]
    assert len(rows) == len(docs) + len(odd)
    kept = quality_lm.kept(d, lab.where("doc_id < 300"), order=3)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)


def test_large_alphabets_are_scored_by_joins(spark, monkeypatch):
    """Beyond the cells that go to every task the same verdicts come from joins, by themselves; repeated ids keep their rows."""
    docs, labels = corpus(60)
    docs += [(1, None, "en"), (1, docs[3][1], "de"), (None, docs[4][1], None), (2, " ", "fr")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = lambda: sorted((str(r.doc_id), str(r.lang), r.kept, round(r.perplexity or 0, 3), round(r.limit, 3)) for r in quality_lm.judged(d, lab, order=3).collect())
    want = rows()
    monkeypatch.setattr(quality_lm, "DENSE_CELLS", 8)
    assert rows() == want
    assert quality_lm.kept(d, lab, order=3).count() == sum(r[2] for r in want)


def test_model_grows_with_the_corpus(spark, monkeypatch):
    """Every trusted document is counted, however many there are, and all letters are told apart, in one case."""
    n, real, seen = 6500, quality_lm.gram_counts, []
    monkeypatch.setattr(quality_lm, "gram_counts", lambda texts, *rest: seen.append(texts.count()) or real(texts, *rest))
    letters = "".join(chr(0x4E00 + i) for i in range(53))
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, letters).otherwise("aB").alias("text"), F.lit("x").alias("lang"))
    model, _ = quality_lm.fit(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")), order=2, coverage=1.0)
    assert seen == [n]
    assert model.letters[:2] == [ord("a"), ord("b")] and len(model.letters) == 55


def test_no_labels(spark):
    docs, _ = corpus(10)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality_lm.judged(d, none, order=2).collect())
    assert quality_lm.judged(d.limit(0), none, order=2).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus(300)
    docs += [(900, docs[1][1], "en"), (901, docs[1][1] + " end", "en"), (902, docs[2][1] + " call +1 (212) 555-0199", "en"), (903, None, None)]
    d = spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = stage(spark, now, str(tmp_path))
        assert now.columns == d.columns, name
        now = spark.createDataFrame(now.collect(), now.schema)
        assert {r.doc_id for r in now.select("doc_id").collect()} <= before
    left = {r.doc_id: r.text for r in now.collect()}
    good = {i for i, q, _ in labels if q}
    assert len(good & left.keys()) > 0.95 * len(good)
    assert not {i for i, q, _ in labels if not q} & left.keys()
    assert 900 not in left and 903 not in left and "555-0199" not in left.get(902, "")
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == left.keys()
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.countDistinct("doc_id")).first()[0] == len(left)
