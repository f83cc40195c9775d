"""Spelling variants against all pairs, on words made to share bigrams and to run into ties of the order."""

import random
import zlib
from collections import Counter

import pytest

from tidewatch.llm import variants


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_all_pairs(words: dict[str, int], times: int = 5) -> set[tuple]:
    rows, forms = [], {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= times * n:
            forms[w] = best
        rows.append((w, n, len(near), forms.get(w)))
    out = set()
    for w, n, near, form in rows:
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, n, near, form, words.get(form), root))
    return out


def rows_of(df) -> set[tuple]:
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize(("letters", "lengths"), [("ab", (6, 8)), ("aé", (6, 9)), ("abcdé", (6, 7))])
def test_all_pairs(spark, letters, lengths):
    rng = random.Random(f"{letters}{lengths}")
    words = {"".join(rng.choices(letters, k=rng.randint(*lengths))): rng.choice((5, 6, 25, 30, 150, 800)) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(variants.grouped(df)) == by_all_pairs(words)


def test_each_pair_once(spark):
    df = spark.createDataFrame([("aaaaaa", 5), ("aaaaaaa", 5), ("aaaaaaaa", 5), ("aaaaab", 5)], "word string, n long")
    pairs = [(r.a, r.b) for r in variants.near_pairs(df).collect()]
    assert sorted(tuple(sorted(p)) for p in pairs) == [("aaaaaa", "aaaaaaa"), ("aaaaaa", "aaaaab"), ("aaaaaaa", "aaaaaaaa")]


def test_chain_ties_and_circles(spark):
    words = {"lantern": 700, "lanterm": 100, "lanxerm": 10, "bonfire": 50, "bonfira": 50, "bonfirx": 9}
    got = {r[0]: r for r in rows_of(variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got["lanxerm"][3:] == ("lanterm", 100, "lantern")
    assert got["bonfirx"][3] == "bonfira" and got["bonfire"][3] is None  # equal counts have no form


def test_counts_of_whole_texts(spark):
    long = "harbour " * 40_000 + "Éclairs éclairs"
    texts = [(1, "HARBOUR harbour's harb harbour1harbour", "x"), (1, None, "y"), (None, "harbour Harbour", "z"), (2, "", None), (3, long, "w"), (3, "naïvely×÷ Ωmegas", "v")] * 3
    df = spark.createDataFrame(texts, "doc_id long, text string, word string")
    for damaged in (0, 2, 199):
        expected: Counter = Counter()
        for doc_id, text, _ in texts:
            run = ""
            for c in (text or "") + " ":
                if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                    run += c.lower() if c.isascii() else c
                elif run:
                    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                    if damaged and h % damaged == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    expected[run] += 1
                    run = ""
        expected = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
        assert {r.word: r.n for r in variants.counted(df, damaged=damaged).collect()} == expected


def test_flushes_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(variants, "FLUSH", 3)
    df = spark.createDataFrame([(i, "copper silver golden bronze copper") for i in range(5)], "doc_id int, text string")
    assert {r.word: r.n for r in variants.counted(df).collect()} == {"copper": 10, "silver": 5, "golden": 5, "bronze": 5}
    assert variants.grouped(variants.counted(df.where("doc_id < 0"))).count() == 0
