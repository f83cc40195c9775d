"""Running aggregates and quantiles in parts, against plain loops and NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.ordered import quantiles, running


@pytest.mark.parametrize("descending", [False, True])
def test_running(spark, descending):
    """Groups of very different sizes (a null one too), nulls in order and values, the order's ties put in order by ``then``."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(400)]), i, rng.choice([None, 1, 2, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x int, i int, v int").repartition(5)
    got = running(df, ["k"], "x", {"s": (F.sum, "v"), "m": (F.max, "i")}, descending, own=False, then=["i"])
    assert got.columns == ["k", "x", "i", "v", "s", "m"]
    seen: dict = {}
    want = []
    for k, x, i, v in sorted(rows, key=lambda r: ((-1 if r[1] is None else r[1]) * (-1 if descending else 1), r[2])):
        s, m = seen.get(k, (None, None))
        want.append((i, s, m))
        seen[k] = (s if v is None else (s or 0) + v, i if m is None else max(m, i))
    assert sorted((r.i, r.s, r.m) for r in got.collect()) == sorted(want)
    whole = running(df, [], "x", {"s": (F.sum, "v")}, descending, then=["i"])
    assert whole.agg(F.max("s")).first()[0] == sum(v or 0 for *_, v in rows) and whole.count() == len(rows)
    assert running(df.limit(0), ["k"], "x", {"s": (F.sum, "v")}).count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=2500), rng.integers(0, 3, 2500) * 1000.0  # one without ties, one that is ties alone
    df = spark.createDataFrame([(float(x), float(y), "k" if i % 3 else None) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(None, None, "k"), (None, None, "empty")], "a double, b double, k string")
    qs = [0.0, 0.013, 0.5, 0.99, 1.0]
    got = {(r["name"], r.q): r.value for r in quantiles(df, ["a", "b"], qs).collect()}
    assert got == pytest.approx({(n, q): float(np.quantile(x, q)) for n, x in (("a", a), ("b", b)) for q in qs})
    third = np.arange(2500) % 3 == 0
    by = {(r.k, r.q): r.value for r in quantiles(df, ["a"], qs, ["k"]).collect()}
    assert by == pytest.approx({(k, q): float(np.quantile(a[at], q)) for k, at in ((None, third), ("k", ~third)) for q in qs})
    assert quantiles(df.limit(0), ["a"], qs).count() == 0
