"""Ranked search against scores of all documents, on texts with ties, copies and terms beyond ASCII."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import lexical


def words_of(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if run:
                out.append(run)
            run = ""
        else:
            run += c.lower() if c.isascii() else c
    return out


def ranked(docs, items, k=10):
    bags = [(i, Counter(words_of(t))) for i, t in docs]
    bags = [b for b in bags if b[1]]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out, queries = set(), {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(words_of(t))
    for i, q in queries.items():
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in q.items() if t in b)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out |= {(i, r, None if no else d, -score) for r, (score, no, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def corpus(rng, n=300):
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "naïve", "ÀB", "xā"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))) for _ in range(n)]
    texts += [texts[3]] * 40 + [None, "", "...", "W1,w1;w1-W2"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True)), vocabulary


@pytest.mark.parametrize(("postings", "block"), [(1 << 19, 1 << 17), (400, 20)])
def test_all_scores(spark, postings, block):
    rng = random.Random(postings)
    docs, vocabulary = corpus(rng)
    docs += [(None, "w5 w6 w7"), (None, "w5 w6 w7")]
    items = [(i, " ".join(rng.choices(vocabulary + ["nowhere"], k=rng.randint(0, 12)))) for i in range(25)] + [(90, None), (91, "w9 w9 w10"), (92, docs[5][1]), (92, "w0")]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in docs], "doc_id long, text string, rank int, term string").repartition(3)
    got = lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), postings=postings, block=block)
    assert {(r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()} == ranked(docs, items)


def test_nothing_to_search(spark):
    docs, items = spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string"), spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(docs.limit(0), items.limit(0)).count() == 0


def test_only_promising_nodes_are_opened():
    """One shard: of many equal copies only as many are opened as are asked for, and a rare term doesn't open the common ones' documents."""
    rng = random.Random(2)
    bags = [Counter(rng.choices(["common", "often", "filler"], k=rng.randint(5, 60))) for _ in range(3000)] + [Counter({"common": 1, "rare": 2})] * 500
    names = ["common", "often", "filler", "rare"]
    postings = [(names.index(t), d, c) for d, b in enumerate(bags) for t, c in b.items()]
    parts = names, *(np.array(x, np.int64) for x in zip(*postings, strict=True))
    size = len(bags), sum(sum(b.values()) for b in bags)
    made = lexical.shard_of(list(range(len(bags))), [sum(b.values()) for b in bags], ([n.encode() for n in names], *parts[1:]), size)
    shard = lexical.Shard(made["doc_ids"], made["starts"], made["impacts"], made["levels"])
    best: list = []
    at = [made["terms"].index(t) for t in (b"rare", b"common")]
    opened = shard.search(np.array(at), np.array([1900, 100]), 10, best, at_once=1)
    assert [b[2] for b in best] == list(range(3000, 3010))
    assert opened < 100


def test_impacts_fall_along_each_list():
    made = lexical.shard_of([7, None, 5], [2, 3, 4], ([b"b", b"a"], np.array([0, 0, 1, 0]), np.array([0, 1, 1, 2]), np.array([1, 3, 2, 4])), (3, 9))
    assert made["doc_ids"] == [5, 7, None] and made["terms"] == [b"a", b"b"]
    starts, impacts = np.frombuffer(made["starts"], np.int32), np.frombuffer(made["impacts"], np.int32)
    assert all((np.diff(impacts[a:b]) <= 0).all() for a, b in zip(starts[:-1], starts[1:], strict=True))
