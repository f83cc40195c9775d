"""BPE codec and packing against the tokenizers library and exhaustive checks."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, packing

TEXTS = [
    (1, "The quick brown fox, it's 12345!"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "Été où ça Straße ΣΑΣ İstanbul ﬁne"),
    (6, "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>"),
    (7, "x" * 3000 + "the" * 2000),
    (8, "word " * 30_000),
    (9, "x\x1cy\x1d z q́"),
    (None, "no id"),
    (1, "The quick brown fox, it's 12345!"),
    (10, "日本語 текст 👍🏽 é"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_digests(spark, library):
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in TEXTS], "doc_id long, text string, n_tokens int, key string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs).collect())
    want = []
    for i, t in TEXTS:
        ids = ids_of(library, t)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_digests(docs).count() == 0
    assert packing.pack(docs).count() == 0


def test_random_words(library):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéüñ'1!. \n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(4000)]
    tool = bpe.codec(bpe.default_path())
    flat, bounds = tool.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == ids_of(library, t), t


def test_heap_and_side_by_side_merges_agree():
    tool = bpe.codec(bpe.default_path())
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioubcdthrsn") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    tokens, owner = tool._merge_together(words)
    assert [tokens[owner == i].tolist() for i in range(len(words))] == [tool._merge(w) for w in words]


def check_packing(rows, ids, capacity):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by_bin.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, pieces in by_doc.items():
        whole = [*ids[doc], 0]
        for n, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            part = whole[n * capacity : (n + 1) * capacity]
            assert (p.piece, p.start, p.length) == (n, n * capacity, len(part))
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(p.length for p in pieces) == len(whole)
    return len(by_bin)


def test_packing(spark, library):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["the", "of", "and", "thing"]) for _ in range(rng.choice([0, 3, 40, 300, 700])))) for i in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("rank", F.lit(1))
    ids = {i: ids_of(library, t) for i, t in texts}
    rows = packing.pack(docs, capacity=256).collect()
    bins = check_packing(rows, ids, 256)
    total = sum(len(x) + 1 for x in ids.values())
    assert bins <= 1.02 * total / 256 + 1


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "the the the")] * 5, "doc_id long, text string")
    rows = packing.pack(docs, capacity=8).collect()
    assert sorted((r.sequence_id, r.offset) for r in rows) == [(0, 0), (0, 4), (1, 0), (1, 4), (2, 0)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(None, None), (3, None), (None, 5000), (2, 4000)])
def test_plan_holds_every_capacity(rule, caps):
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(rng.integers(1, 64, 2000), return_counts=True)
    steps = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 100, *caps, rule=rule)
    bins: dict[int, list[tuple[int, int]]] = {}
    ranks: dict[int, list[int]] = {}
    for length, a, b, first, offset in steps:
        for r in range(a, b + 1):
            bins.setdefault(first + r - a, []).append((offset, length))
            ranks.setdefault(length, []).append(r)
    assert all(sorted(ranks[int(x)]) == list(range(1, int(n) + 1)) for x, n in zip(lengths, counts, strict=True))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 100
        assert caps[0] is None or len(members) <= caps[0]
        assert caps[1] is None or sum(x * x for _, x in members) <= caps[1]


def test_piece_that_fits_nowhere():
    with pytest.raises(ValueError, match="fits no empty"):
        packing.plan({90: 1}, 100, max_cost=100)
