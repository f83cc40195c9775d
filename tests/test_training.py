"""Training over all rows: gradients against differences, weighted classes, stopping, and a result that doesn't hang on one task."""

import numpy as np
import pytest

from tidewatch.operators import score as sc
from tidewatch.operators import train as tr


@pytest.mark.parametrize("labelled", [False, True])
def test_gradient(labelled):
    rng = np.random.default_rng(5)
    dims = [3, 4, 1 if labelled else 3]
    flat = tr.started(dims, 1)
    x = rng.normal(size=(7, 3))
    y = rng.integers(0, 2, (7, 1)).astype(float) if labelled else x
    loss = lambda v: tr.gradient(x, y, tr._cut(v, dims), labelled, 3.0)[0]
    got = np.concatenate([g.ravel() for g in tr.gradient(x, y, tr._cut(flat, dims), labelled, 3.0)[1]])
    unit = np.eye(len(flat)) * 1e-6
    assert got == pytest.approx([(loss(flat + u) - loss(flat - u)) / 2e-6 for u in unit], abs=1e-6)


def test_patience_and_rate():
    least, most = tr.Patience(2), tr.Patience(3, "max", 0.1)
    assert [(least.better(v), least.stop) for v in (4.0, 3.0, 3.0, 2.5, 2.6, 2.5)] == [(True, False), (True, False), (False, False), (True, False), (False, False), (False, True)]
    assert [(most.better(v), most.stop) for v in (0.5, 0.55, 0.7, 0.6, 0.1, 0.75)] == [(True, False), (False, False), (True, False), (False, False), (False, False), (False, True)]
    assert [tr.cosine_rate(0.2, i, 4) for i in (0, 2, 4)] == pytest.approx([0.2, 0.1, 0.0])


def test_classifier(spark):
    """A ring is learnt; a weight on positives moves the border outwards; null rows and labels take no part."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(int)
    rows = [(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)] + [(None, 1), ([0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "x array<double>, y int").repartition(4).cache()
    how = tr.Fit(rounds=12, rate=2e-2, batch=16)
    layers, losses = tr.train(df, "x", [12], "y", how)
    said = sc.mlp(x, layers)[:, 0] > 0
    assert (said == y).mean() > 0.93 and losses[-1] < 0.4 * losses[0]
    heavy, _ = tr.train(df, "x", [12], "y", tr.Fit(rounds=12, rate=2e-2, batch=16, positive_weight=20.0))
    assert (sc.mlp(x, heavy)[:, 0] > 0).sum() > said.sum()


def test_no_rows(spark):
    with pytest.raises(ValueError):
        tr.train(spark.createDataFrame([], "x array<double>"), "x", [2])
