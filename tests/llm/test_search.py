"""Top-k search and near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tidewatch.llm import jaccard, simhash, topk
from tidewatch.llm.components import components


def brute_topk(rows, k, width=None):
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0] * (width - len(v))) for i, v in ok]
    out = []
    for q, v in ok:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "copies", "odd", "few", "clusters"])
def test_topk(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "random":
        rows = [(i, rng.normal(0, 0.15, 8).tolist()) for i in range(600)]
    elif kind == "copies":
        rows = [(i, [0.5, -0.25, 0.125]) for i in range(300)] + [(i, rng.normal(0, 1, 3).tolist()) for i in range(300, 400)]
    elif kind == "odd":
        rows = [(0, None), (20, [1.0, None]), (40, [float("nan"), 1.0]), (60, [float("inf"), 0.0]), (80, [1.0, 2.0]), (81, [3.0]), (82, []), (None, [1.0, 1.0]), (100, [1e9, -1e9]), (101, [1e9, 1e9])]
    elif kind == "few":
        rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0])]
    else:
        centres = rng.normal(0, 3, (6, 5))
        rows = [(i, (centres[i % 6] + rng.normal(0, 0.1, 5)).tolist()) for i in range(500)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, pivot int")
    got = topk.search(df, lambda i: i % 20 == 0, block=32, query_block=8, pivots=6)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute_topk(rows, 20)


def test_topk_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(none, lambda i: i % 20 == 0).collect() == []


def test_bounds_leave_blocks_out(spark, monkeypatch):
    """Of clusters far apart, a block of queries is sent the blocks of vectors of its own surroundings alone."""
    rng = np.random.default_rng(0)
    centres = np.concatenate([np.eye(4), -np.eye(4)]) * 40
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.1, 4)).tolist()) for i in range(1600)]
    seen, real = [], topk.needed
    monkeypatch.setattr(topk, "needed", lambda asked, meta: seen.append((real(asked, meta).count(), asked.select("qb").distinct().count() * meta.count())) or real(asked, meta))
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=5, block=32, query_block=8, pivots=8)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute_topk(rows, 5)
    visits, pairs = seen[-1]
    assert visits < 0.3 * pairs


def components_of(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["none", "path", "star", "random", "long"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "none": [],
        "path": [(i, i + 1) for i in range(60)],
        "star": [(i, 100) for i in range(50)] + [(200, 100), (5, 5)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "long": list(zip(p := rng.sample(range(500), 120), p[1:], strict=False)),
    }[kind]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in components_of(edges).items() if x != r}


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_masks_cover():
    masks = simhash.masks(4)
    assert len(masks) == 31
    rng = random.Random(0)
    for _ in range(5000):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & bits == 0 for m in masks)
        m = rng.choice(masks)
        free = [b for b in range(64) if not m >> b & 1]
        bits = sum(1 << b for b in rng.sample(free, 4))
        assert any(s & bits == 0 and s & m == 0 for s in simhash.submasks(m, 4))


def near_docs(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            text = rng.choice(docs)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((i, " ".join(text)))
        else:
            docs.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 60, 300])))))
    return docs


@pytest.mark.parametrize("heavy", [2048, 3])
def test_near_duplicates(spark, heavy):
    docs = near_docs(heavy) + [(500, None), (501, ""), (502, " "), (503, "The the THE"), (503, "The the THE"), (None, "the the the"), (504, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, 3, "z") for i, t in docs], "doc_id long, text string, fp int, component_id string")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df, heavy=heavy).collect())
    fps = [slow_fingerprint(t) for _, t in docs]
    root = components_of([(a, b) for a in range(len(docs)) for b in range(a + 1) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    least = {}
    for n, (i, _) in enumerate(docs):
        if i is not None:
            least[root[n]] = min(i, least.get(root[n], i))
    want = sorted((str(i), f"{fps[n]:016x}", str(least.get(root[n]))) for n, (i, _) in enumerate(docs))
    assert got == want


def test_deduplicated(spark):
    docs = [(3, "a b c d e f g h", "x"), (1, "a b c d e f g h", "y"), (2, "other words are here now and then", None), (2, "other words are here now and then", None), (None, "a b c d e f g h", "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, extra string")
    got = sorted((str(r.doc_id), str(r.extra)) for r in simhash.deduplicated(df).collect())
    assert got == [("1", "y"), ("2", "None"), ("None", "q")]
    assert simhash.deduplicated(df.limit(0)).columns == df.columns


def test_pipeline_near_duplicates(spark):
    """The pipeline's stage against a brute-force join at Jaccard 0.8 over five-word shingles."""
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    line = " ".join(rng.choice(words) for _ in range(40))
    texts = ["", " ", "a b c", "A b  c", "a b d", *(" ".join([line, *(rng.choice(words) for _ in range(100))]) for _ in range(30))]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(200)]
        texts.append(" ".join(base))
        for changed in (2, 4, 6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    # copies that resemble one text more than each other
    texts += [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(10, 190)]
    rng.shuffle(texts)

    def own(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    found = [own(t) for t in texts]
    close = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    root = components_of([(a, b) for a in range(len(texts)) for b in range(a + 1) if close(found[a], found[b])])
    want = sorted({min(i for i in range(len(texts)) if root[i] == r) for r in set(root[n] for n in range(len(texts)))})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == want


def test_heavy_bucket_crossing_batches():
    """Buckets larger than the limit are handed on whole, whatever the batches."""
    import pyarrow as pa

    fps = np.arange(10, dtype=np.int64)
    table = pa.table({"t": pa.array([0] * 10 + [1, 1], pa.int32()), "k": pa.array([0] * 10 + [5, 5], pa.int64()), "fp": pa.array([*fps, 6, 7])})
    for size in (1, 2, 3, 5, 12):
        out = [r for b in simhash._buckets(4, 4)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(r["a"] for r in out if r["b"] is None) == fps.tolist()
        assert [(r["a"], r["b"]) for r in out if r["b"] is not None] == [(6, 7)]
