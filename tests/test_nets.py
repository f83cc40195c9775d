"""Sequence networks: gradients against differences, forward passes against the scorers, and training over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import nets
from tidewatch.operators import score as sc
from tidewatch.operators import train as tr

NETS = {
    "detector": nets.detector(6, 3, 2, (4, 5), 3, (6,)),
    "lstm": nets.recurrent(5, 3, 4, 2, 3, "lstm"),
    "gru": nets.recurrent(5, 3, 4, 2, 3, "gru"),
    "gate": nets.gate(4, 3, (5,)),
}


def batch(net, n=6, seed=0):
    rng = np.random.default_rng(seed)
    xs = [rng.normal(size=(n, *shape)) for shape in net.inputs]
    steps = net.logits(net.start(1), xs).shape[1:]
    y = rng.integers(0, 2, (n, *steps)).astype(float)
    if y.ndim > 1:
        y[0, 1] = np.nan  # a step without a label
    return xs, y


@pytest.mark.parametrize("name", sorted(NETS))
def test_gradients(name):
    net = NETS[name]
    xs, y = batch(net)
    flat = net.start(3) + 0.05 * np.random.default_rng(4).normal(size=net.size)
    loss, got = net.gradient(flat, xs, y, 3.0)
    assert loss == pytest.approx(net.loss(flat, xs, y, 3.0))
    step = 1e-5
    for i in np.random.default_rng(5).choice(net.size, min(net.size, 80), replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        assert got[i] == pytest.approx((net.loss(up, xs, y, 3.0) - net.loss(down, xs, y, 3.0)) / (2 * step), abs=2e-6)
    own = net.input_gradients(flat, xs)
    for k, x in enumerate(xs):
        at = tuple(0 for _ in x.shape)
        up, down = [v.copy() for v in xs], [v.copy() for v in xs]
        up[k][at] += step
        down[k][at] -= step
        assert own[k][at] == pytest.approx((net.logits(flat, up).sum() - net.logits(flat, down).sum()) / (2 * step), abs=1e-6)


def test_scorers_have_the_same_forward_pass():
    flat = {n: net.start(7) for n, net in NETS.items()}
    xs, _ = batch(NETS["detector"])
    logits, weights = sc.depthwise_detector(xs[0], xs[1], nets.detector_weights(NETS["detector"].cut(flat["detector"])))
    assert logits == pytest.approx(NETS["detector"].logits(flat["detector"], xs)) and weights.sum(axis=1) == pytest.approx(np.ones(6))
    for kind in ("lstm", "gru"):
        xs, _ = batch(NETS[kind])
        probs = sc.bilstm_scores(xs[0], nets.recurrent_weights(NETS[kind].cut(flat[kind])))
        assert probs == pytest.approx(1 / (1 + np.exp(-NETS[kind].logits(flat[kind], xs))))


def test_recurrent_layers_learn_an_order(spark):
    """A step is positive where a spike has come before it: no layer without memory can know. Unlabelled steps and rows without input take no part."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (400, 6, 2))
    at = rng.integers(0, 6, 400)
    x[np.arange(400), at, 0] += 4
    y = (np.arange(6)[None] > at[:, None]).astype(float)
    rows = [(v.ravel().tolist(), [None if (i + j) % 11 == 0 else float(t) for j, t in enumerate(own)]) for i, (v, own) in enumerate(zip(x, y, strict=True))] + [(None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>").repartition(3).cache()
    net = nets.recurrent(6, 2, 6, 1, 4, "gru")
    flat, losses = tr.train_net(df, net, ["x"], "y", tr.Fit(rounds=6, rate=3e-2, batch=16))
    assert losses[-1] < 0.4 * losses[0]
    got = nets.scored(df, net, flat, ["x"]).where("x is not null").collect()
    said = np.array([r.logits for r in got]) > 0
    want = np.array([[t if t is not None else np.nan for t in r.y] for r in got])
    assert (said == want)[~np.isnan(want)].mean() > 0.9
    assert nets.scored(df, net, flat, ["x"]).where("x is null").first().logits is None


def test_gate_learns_whom_to_trust(spark):
    """Of two experts one is right where a feature is positive and the other elsewhere; and the features are ranked by their gradients."""
    rng = np.random.default_rng(2)
    f = rng.normal(size=(600, 3))
    y = rng.integers(0, 2, 600)
    right, wrong = np.where(y == 1, 3.0, -3.0), np.where(y == 1, -3.0, 3.0)
    e = np.where(f[:, :1] > 0, np.stack([right, wrong], 1), np.stack([wrong, right], 1))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), int(t)) for a, b, t in zip(f, e, y, strict=True)], "f array<double>, e array<double>, y int").repartition(3).cache()
    net = nets.gate(3, 2, (8,))
    flat, losses = tr.train_net(df, net, ["f", "e"], "y", tr.Fit(rounds=8, rate=3e-2, batch=16))
    assert losses[-1] < 0.5 * losses[0]
    ranks = nets.gradient_ranks(df, net, flat, ["f", "e"], [["decides", "noise1", "noise2"], ["first", "second"]]).collect()
    by = {r.feature: r["rank"] for r in ranks}
    assert sorted(by.values()) == [1, 2, 3, 4, 5] and by["decides"] < min(by["noise1"], by["noise2"])


def test_sums_in_a_tree(spark):
    parts = spark.range(0, 90, 1, 45).select(F.col("id").alias("part"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    assert tr.summed(parts, 4).tolist() == [sum(range(90)), 90.0]
    weights = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.4, 0.2, 0.4],)], "w array<double>")
    assert [r.p for r in weights.select(nets.attention_peak("w").alias("p")).collect()] == [1, 0]
