"""Sequence networks that can be trained: convolutions with attention pooling, bidirectional LSTM and GRU layers with additive attention, and the gate of
a mixture of fixed experts.

A network is its parameters' shapes and a forward pass on a tape; parameters are one flat vector, as :mod:`tidewatch.operators.train` sends them
around. The forward passes are those of :mod:`tidewatch.operators.score`, which scores with the same weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators import tape as tp
from tidewatch.operators.tape import Value


@dataclass(frozen=True)
class Net:
    """``shapes``: parameters by name; ``inputs``: the shape of each input's row; ``forward(parameters, inputs)``: logits, one a row or one a step of a row."""

    shapes: dict[str, tuple[int, ...]]
    inputs: tuple[tuple[int, ...], ...]
    forward: Callable[[dict[str, Value], list[Value]], Value]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def start(self, seed: int = 0) -> np.ndarray:
        """First parameters: normal with a variance of 2 over the inputs (1 for recurrent ones); biases 0."""
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.normal(0, np.sqrt((1 if "hidden" in n else 2) / s[0]), s).ravel() if len(s) > 1 else np.zeros(s).ravel() for n, s in self.shapes.items()])

    def cut(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for n, s in self.shapes.items():
            out[n] = flat[at : at + int(np.prod(s))].reshape(s)
            at += out[n].size
        return out

    def logits(self, flat: np.ndarray, xs: list[np.ndarray]) -> np.ndarray:
        return self.forward({n: Value(p) for n, p in self.cut(flat).items()}, [Value(x) for x in xs]).of

    def loss(self, flat: np.ndarray, xs: list[np.ndarray], y: np.ndarray, weight: float = 1.0) -> float:
        """Mean cross-entropy over all labels that are there (not NaN), a positive counting ``weight`` times."""
        return _entropy(self.logits(flat, xs), y, weight)[0]

    def gradient(self, flat: np.ndarray, xs: list[np.ndarray], y: np.ndarray, weight: float = 1.0) -> tuple[float, np.ndarray]:
        """The loss, and its gradient by each parameter."""
        params = {n: Value(p) for n, p in self.cut(flat).items()}
        out = self.forward(params, [Value(x) for x in xs])
        loss, g = _entropy(out.of, y, weight)
        tp.backward(out, g)
        return loss, np.concatenate([(np.zeros(p.of.shape) if p.grad is None else p.grad).ravel() for p in params.values()])

    def input_gradients(self, flat: np.ndarray, xs: list[np.ndarray]) -> list[np.ndarray]:
        """How each row's summed logits change with each of its inputs."""
        values = [Value(x) for x in xs]
        out = self.forward({n: Value(p) for n, p in self.cut(flat).items()}, values)
        tp.backward(out, np.ones_like(out.of))
        return [np.zeros_like(v.of) if v.grad is None else v.grad for v in values]


def _entropy(out: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    y = y.reshape(out.shape)
    there = ~np.isnan(y)
    target = np.where(there, y, 0.0)
    share = np.where(there, np.where(target > 0, weight, 1.0), 0.0)
    n = max(1, int(there.sum()))
    loss = share * (np.logaddexp(0, out) - target * out)
    return float(loss.sum() / n), share * (1 / (1 + np.exp(-np.clip(out, -500, 500))) - target) / n


def _dense(p: dict[str, Value], x: Value, name: str, layers: int) -> Value:
    for i in range(layers):
        x = x @ p[f"{name}{i}"] + p[f"{name}{i}_bias"]
        x = tp.relu(x) if i + 1 < layers else x
    return x


def _dense_shapes(name: str, dims: list[int]) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for i, (a, b) in enumerate(zip(dims[:-1], dims[1:], strict=True)):
        out |= {f"{name}{i}": (a, b), f"{name}{i}_bias": (b,)}
    return out


def detector(bins: int, features: int, static: int, channels: tuple[int, ...] = (64, 96), kernel: int = 5, hidden: tuple[int, ...] = (256, 64)) -> Net:
    """Depthwise-separable convolutions over bins (dilations 1, 2, ...), attention pooling, then dense layers over the pooled and the static features."""
    shapes: dict[str, tuple[int, ...]] = {}
    for i, (a, b) in enumerate(zip((features, *channels[:-1]), channels, strict=True)):
        shapes |= {f"depth{i}": (kernel, a), f"point{i}": (a, b), f"point{i}_bias": (b,)}
    head = [channels[-1] + static, *hidden, 1]
    shapes |= {"attention": (channels[-1], 1)} | _dense_shapes("head", head)

    def forward(p, xs):
        x = xs[0]
        for i in range(len(channels)):
            d = 2**i
            pad = d * (kernel - 1) // 2
            wide = tp.padded(x, pad, d * (kernel - 1) - pad, 1)
            x = wide[:, :bins] * p[f"depth{i}"][0]
            for j in range(1, kernel):
                x = x + wide[:, j * d : j * d + bins] * p[f"depth{i}"][j]
            x = tp.relu(x @ p[f"point{i}"] + p[f"point{i}_bias"])
        pooled = tp.total(x * tp.softmax(x @ p["attention"], 1), 1)
        return _dense(p, tp.together([pooled, xs[1]]), "head", len(head) - 1)[:, 0]

    return Net(shapes, ((bins, features), (static,)), forward)


def detector_weights(p: dict[str, np.ndarray]) -> dict:
    """The parameters as :func:`score.depthwise_detector` takes them."""
    blocks = [(p[f"depth{i}"].T, p[f"point{i}"].T, p[f"point{i}_bias"]) for i in range(sum(n.startswith("depth") for n in p))]
    layers = sum(n.startswith("head") for n in p) // 2
    return {"blocks": blocks, "attention": p["attention"][:, 0], "head": [(p[f"head{i}"].T, p[f"head{i}_bias"]) for i in range(layers)]}


def recurrent(steps: int, features: int, hidden: int = 128, layers: int = 2, attention: int = 64, kind: str = "lstm") -> Net:
    """Bidirectional layers, additive attention over the steps added to each of them, a logit for every step. ``kind``: lstm or gru."""
    if kind not in ("lstm", "gru"):
        raise ValueError(f"kind is lstm or gru, not {kind}")
    gates = 4 if kind == "lstm" else 3
    shapes: dict[str, tuple[int, ...]] = {}
    for i in range(layers):
        for side in ("f", "b"):
            name = f"{side}{i}_"
            shapes |= {f"{name}input": (features if i == 0 else 2 * hidden, gates * hidden), f"{name}hidden": (hidden, gates * hidden), f"{name}bias": (gates * hidden,)}
            if kind == "gru":
                shapes[f"{name}again_bias"] = (gates * hidden,)
    shapes |= {"attention_w": (2 * hidden, attention), "attention_v": (attention, 1), "out_own": (2 * hidden, 1), "out_all": (2 * hidden, 1), "out_bias": (1,)}

    def layer(p, x: Value, name: str, back: bool) -> Value:
        into = x @ p[f"{name}input"] + p[f"{name}bias"]
        n = x.of.shape[0]
        h = c = Value(np.zeros((n, hidden)))
        one, out = Value(np.ones(())), [h] * steps
        at = lambda v, i: v[:, i * hidden : (i + 1) * hidden]
        for t in reversed(range(steps)) if back else range(steps):
            again = h @ p[f"{name}hidden"]
            if kind == "lstm":
                z = into[:, t] + again
                c = tp.sigmoid(at(z, 1)) * c + tp.sigmoid(at(z, 0)) * tp.tanh(at(z, 2))
                h = tp.sigmoid(at(z, 3)) * tp.tanh(c)
            else:
                x_t, again = into[:, t], again + p[f"{name}again_bias"]
                reset, keep = tp.sigmoid(at(x_t, 0) + at(again, 0)), tp.sigmoid(at(x_t, 1) + at(again, 1))
                new = tp.tanh(at(x_t, 2) + reset * at(again, 2))
                h = (one + keep * Value(-np.ones(()))) * new + keep * h
            out[t] = h
        return tp.stacked(out)

    def forward(p, xs):
        x = xs[0]
        for i in range(layers):
            x = tp.together([layer(p, x, f"f{i}_", False), layer(p, x, f"b{i}_", True)])
        a = tp.softmax(tp.tanh(x @ p["attention_w"]) @ p["attention_v"], 1)
        context = tp.total(x * a, 1) @ p["out_all"]
        n = x.of.shape[0]
        return tp.shaped(x @ p["out_own"] + tp.shaped(context, (n, 1, 1)) + p["out_bias"], (n, steps))

    return Net(shapes, ((steps, features),), forward)


def recurrent_weights(p: dict[str, np.ndarray]) -> dict:
    """The parameters as :func:`score.bilstm_scores` takes them."""
    count = sum(n.startswith("f") and n.endswith("_input") for n in p)
    own = lambda name: {k: p[f"{name}{k}"].T for k in ("input", "hidden", "bias", "again_bias") if f"{name}{k}" in p}
    return {"layers": [(own(f"f{i}_"), own(f"b{i}_")) for i in range(count)], "attention_w": p["attention_w"].T, "attention_v": p["attention_v"][:, 0], "out_w": np.concatenate([p["out_own"], p["out_all"]])[:, 0], "out_b": float(p["out_bias"][0])}


def gate(features: int, experts: int, hidden: tuple[int, ...] = (64,)) -> Net:
    """The gate of a mixture: dense layers over its features give each fixed expert's share by a softmax; inputs are the features and the experts' logits."""
    dims = [features, *hidden, experts]

    def forward(p, xs):
        return tp.total(tp.softmax(_dense(p, xs[0], "gate", len(dims) - 1)) * xs[1], 1)

    return Net(_dense_shapes("gate", dims), ((features,), (experts,)), forward)


def scored(df: DataFrame, net: Net, flat: np.ndarray, inputs: list[str], out: str = "logits") -> DataFrame:
    """Adds the network's logits (an array of one, or of one a step) for array columns, in Arrow batches; null where an input is."""

    @F.pandas_udf("array<double>")
    def run(*columns):
        import pandas as pd

        there = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
        found = [None] * len(there)
        if there.any():
            xs = [np.stack(c[there].to_numpy()).astype(np.float64).reshape(-1, *shape) for c, shape in zip(columns, net.inputs, strict=True)]
            for i, row in zip(np.flatnonzero(there), net.logits(flat, xs).reshape(int(there.sum()), -1), strict=True):
                found[i] = row
        return pd.Series(found, dtype=object)

    return df.withColumn(out, run(*[F.col(c).cast("array<double>") for c in inputs]))


def gradient_ranks(df: DataFrame, net: Net, flat: np.ndarray, inputs: list[str], names: list[list[str]]) -> DataFrame:
    """(rank, feature, gradient): features by the mean size of the logits' change with them, in one pass. ``names``: for each input those of its last axis; other
    axes (steps, bins) are summed over."""
    rows = df.where(F.col(inputs[0]).isNotNull()).select(*[F.col(c).cast("array<double>").alias(f"x{i}") for i, c in enumerate(inputs)])
    every = [n for of in names for n in of]

    def work(batches):
        import pyarrow as pa

        sums, n = np.zeros(len(every)), 0
        for batch in batches:
            xs = [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape) for i, shape in enumerate(net.inputs)]
            sizes = [np.abs(g).reshape(batch.num_rows, -1, g.shape[-1]).sum(axis=(0, 1)) for g in net.input_gradients(flat, xs)]
            sums, n = sums + np.concatenate(sizes), n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(sums), pa.array([n] * len(every), pa.int64())], names=["feature", "s", "n"])

    g = rows.mapInArrow(work, "feature string, s double, n long").groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("gradient"))
    return g.select(F.row_number().over(W.orderBy(F.desc("gradient"), "feature")).alias("rank"), "feature", "gradient")


def attention_peak(weights: str) -> Column:
    """The first place (from 0) of the largest attention weight of an array column."""
    return F.array_position(F.col(weights), F.array_max(weights)) - 1
