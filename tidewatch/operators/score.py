"""Scorers: expressions for small models, Arrow-batched NumPy for networks, MLlib for training.

Weights are parameters (a dict of arrays); they are small and travel with the function.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.train import Fit, train


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic(df: DataFrame, weights: dict[str, float], bias: float) -> Column:
    """A logistic score as one expression."""
    out = F.lit(float(bias))
    for c, w in weights.items():
        out = out + F.col(c) * float(w)
    return sigmoid(out)


def calibrated(logit: Column, temperature: float) -> Column:
    return sigmoid(logit / max(temperature, 1e-3))


def fit_temperature(df: DataFrame, logit: str, label: str, rounds: int = 20) -> float:
    """Newton steps on the mean loss over s = 1 / T; each step is one aggregation."""
    s = 1.0
    for _ in range(rounds):
        p = sigmoid(F.col(logit) * s)
        row = df.agg(F.avg((p - F.col(label)) * F.col(logit)).alias("g"), F.avg(p * (1 - p) * F.col(logit) * F.col(logit)).alias("h")).first()
        if not row["h"] or abs(row["g"]) < 1e-10:
            break
        s = min(max(s - row["g"] / row["h"], 1e-3), 1e3)
    return 1 / s


def dense_layer(x: Column, weight: np.ndarray, bias: np.ndarray, relu: bool = True) -> Column:
    """One layer over an array column, as an expression: for networks of a few dozen units."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weight])
    out = F.transform(F.arrays_zip(rows.alias("w"), F.array(*[F.lit(float(b)) for b in bias]).alias("b")), lambda z: F.aggregate(F.zip_with(z["w"], x, lambda a, b: a * b), z["b"], lambda s, v: s + v))
    return F.transform(out, lambda v: F.greatest(v, F.lit(0.0))) if relu else out


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def mlp(x: np.ndarray, layers) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if i + 1 < len(layers):
            x = _relu(x)
    return x


def autoencoder_error(x: np.ndarray, layers) -> np.ndarray:
    """Mean squared difference between input and reconstruction."""
    return ((mlp(x, layers) - x) ** 2).mean(axis=1)


def depthwise_detector(seq: np.ndarray, static: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Depthwise-separable convolutions (dilations 1, 2, ...), attention pooling, then an MLP over the pooled and static features.

    seq: rows x bins x features. Returns logits and attention weights."""
    x = seq.transpose(0, 2, 1)
    for i, (depth, point, bias) in enumerate(p["blocks"]):
        d, k = 2**i, depth.shape[1]
        pad = d * (k - 1) // 2
        wide = np.pad(x, ((0, 0), (0, 0), (pad, d * (k - 1) - pad)))
        x = sum(wide[:, :, j * d : j * d + x.shape[2]] * depth[None, :, j, None] for j in range(k))
        x = _relu(np.einsum("oc,ncm->nom", point, x) + bias[None, :, None])
    a = np.einsum("c,ncm->nm", p["attention"], x)
    a = np.exp(a - a.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    return mlp(np.hstack([np.einsum("nm,ncm->nc", a, x), static]), p["head"])[:, 0], a


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, w: dict, reverse: bool = False) -> np.ndarray:
    """One direction of one layer over rows x steps x features; gates in the order input, forget, cell, output."""
    n, steps, _ = x.shape
    h = c = np.zeros((n, w["hidden"].shape[1]))
    out = np.zeros((n, steps, h.shape[1]))
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        i, f, g, o = np.split(x[:, t] @ w["input"].T + h @ w["hidden"].T + w["bias"], 4, axis=1)
        c = _sig(f) * c + _sig(i) * np.tanh(g)
        h = _sig(o) * np.tanh(c)
        out[:, t] = h
    return out


def gru(x: np.ndarray, w: dict, reverse: bool = False) -> np.ndarray:
    """As :func:`lstm`, with gates in the order reset, update, new; the recurrent side has a bias of its own."""
    n, steps, _ = x.shape
    h = np.zeros((n, w["hidden"].shape[1]))
    out = np.zeros((n, steps, h.shape[1]))
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        a, b = np.split(x[:, t] @ w["input"].T + w["bias"], 3, axis=1), np.split(h @ w["hidden"].T + w["again_bias"], 3, axis=1)
        reset, keep = _sig(a[0] + b[0]), _sig(a[1] + b[1])
        h = (1 - keep) * np.tanh(a[2] + reset * b[2]) + keep * h
        out[:, t] = h
    return out


def bilstm_scores(x: np.ndarray, p: dict) -> np.ndarray:
    """Stacked bidirectional layers (LSTM, or GRU where they have a second bias) with additive attention added to each step; a probability for every step."""
    for forward, backward in p["layers"]:
        one = gru if "again_bias" in forward else lstm
        x = np.concatenate([one(x, forward), one(x, backward, True)], axis=2)
    e = np.tanh(x @ p["attention_w"].T) @ p["attention_v"]
    a = np.exp(e - e.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    context = np.einsum("ns,nsc->nc", a, x)
    both = np.concatenate([x, np.repeat(context[:, None, :], x.shape[1], axis=1)], axis=2)
    return _sig(both @ p["out_w"] + p["out_b"])


def mixture(gating: Column, experts: list[Column]) -> Column:
    """Sum of expert logits by the softmax of the gate's outputs; an expert with several outputs counts by their mean."""
    top = F.array_max(gating)
    weights = F.transform(gating, lambda g: F.exp(g - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.zip_with(weights, F.array(*experts), lambda w, e: w * e), F.lit(0.0), lambda s, v: s + v) / total


def scored(df: DataFrame, array: str, network, params, out: str = "score") -> DataFrame:
    """Adds a network's output for an array column, in Arrow batches. ``network(matrix, params)`` gives a value a row."""

    @F.pandas_udf("double")
    def run(x):
        if not len(x):
            return x.astype(float)
        return type(x)(np.asarray(network(np.stack(x.to_numpy()).astype(np.float64), params), float))

    return df.withColumn(out, run(F.col(array)))


def focal_loss(prob: Column, label: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = F.when(label == 1, prob).otherwise(1 - prob)
    a = F.when(label == 1, alpha).otherwise(1 - alpha)
    return -a * F.pow(1 - p, F.lit(gamma)) * F.log(F.greatest(p, F.lit(1e-12)))


def train_logistic(df: DataFrame, features: list[str], label: str, l2: float = 0.0):
    """MLlib logistic regression; the intercept isn't penalised."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(df)
    fitted = LogisticRegression(featuresCol="__x", labelCol=label, regParam=l2, elasticNetParam=0.0, standardization=False).fit(rows)
    return dict(zip(features, fitted.coefficients.toArray().tolist(), strict=True)), float(fitted.intercept)


def fuse(df: DataFrame, scores: list[str], label: str) -> tuple[dict[str, float], float]:
    """Weights of a logistic fusion of scores: L2 with C = 1, so regParam is 1/n."""
    return train_logistic(df, scores, label, 1.0 / max(1, df.count()))


def train_autoencoder(df: DataFrame, array: str, sizes: list[int], epochs: int = 30, rate: float = 1e-3, noise: float = 0.05, seed: int = 0):
    """A denoising autoencoder trained on all rows (operators.train). Returns its layers."""
    how = Fit(rounds=epochs, rate=rate, noise=noise, seed=seed)
    return train(df, array, [*sizes, *sizes[-2::-1]], how=how)[0]


def permutation_importance(df: DataFrame, columns: list[str], score: Column, key: str) -> DataFrame:
    """Mean absolute change of the score when one column is shuffled: rows are paired along two hash orders of the key, one join a column."""
    from pyspark.sql import Window as W

    base = df.withColumn("__s", score).withColumn("__shard", F.pmod(F.xxhash64(key), F.lit(64)))
    a = base.withColumn("__i", F.row_number().over(W.partitionBy("__shard").orderBy(F.xxhash64(F.col(key), F.lit(1)), key)))
    out = None
    for c in columns:
        other = base.select("__shard", F.row_number().over(W.partitionBy("__shard").orderBy(F.xxhash64(F.col(key), F.lit(c)), key)).alias("__i"), F.col(c).alias("__other"))
        swapped = a.join(other, ["__shard", "__i"]).withColumn(c, F.col("__other"))
        one = swapped.agg(F.avg(F.abs(score - F.col("__s"))).alias("importance")).select(F.lit(c).alias("feature"), "importance")
        out = one if out is None else out.unionByName(one)
    return out
