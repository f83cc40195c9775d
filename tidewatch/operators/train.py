"""Training of small networks over all rows of a table: dense ones, and the sequence networks of :mod:`tidewatch.operators.nets`.

A round is one pass: every task takes the same weights, runs Adam with decoupled decay over its own rows in batches, and hands
back its weights times its number of rows, as one array. These are added up in a tree; their sum, divided by the rows, starts the next round, so the driver only ever
holds a few dozen arrays of the network's size. Rows held out (by hash) are scored in the same pass with the weights that it starts from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Patience:
    """Early stopping: ``stop`` once ``limit`` values in a row weren't better than the best by more than ``least``. ``mode``: min or max."""

    limit: int = 10
    mode: str = "min"
    least: float = 0.0
    best: float | None = None
    waited: int = 0

    def better(self, value: float) -> bool:
        gain = 0.0 if self.best is None else (self.best - value if self.mode == "min" else value - self.best)
        if self.best is None or gain > self.least:
            self.best, self.waited = value, 0
            return True
        self.waited += 1
        return False

    @property
    def stop(self) -> bool:
        return self.waited >= self.limit


def cosine_rate(rate: float, at: int, rounds: int, floor: float = 0.0) -> float:
    """The rate of round ``at``: from ``rate`` down to ``floor`` along half a cosine."""
    return floor + (rate - floor) * (1 + np.cos(np.pi * at / max(1, rounds))) / 2


@dataclass(frozen=True)
class Fit:
    """How to train. ``label`` None: the rows themselves are the target (squared error); otherwise a 0/1 column and
    cross-entropy, a positive counting ``positive_weight`` times."""

    rounds: int = 30
    rate: float = 1e-3
    batch: int = 256
    noise: float = 0.0
    decay: float = 0.0
    clip: float = 1.0
    positive_weight: float = 1.0
    held: float = 0.1
    patience: int = 10
    seed: int = 0


def _forward(x: np.ndarray, layers) -> list[np.ndarray]:
    acts = [x]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w.T + b
        acts.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
    return acts


def _loss(out: np.ndarray, target: np.ndarray, labelled: bool, weight: float) -> tuple[float, np.ndarray]:
    """Mean loss and its gradient by the outputs."""
    if not labelled:
        return float(((out - target) ** 2).mean()), 2 * (out - target) / max(1, out.size)
    share = np.where(target > 0, weight, 1.0)
    loss = share * (np.logaddexp(0, out) - target * out)
    return float(loss.mean()), share * (1 / (1 + np.exp(-np.clip(out, -500, 500))) - target) / max(1, len(out))


def gradient(x: np.ndarray, target: np.ndarray, layers, labelled: bool, weight: float = 1.0) -> tuple[float, list[np.ndarray]]:
    """Mean loss of a batch, and its gradient by each weight and bias in turn."""
    acts = _forward(x, layers)
    loss, g = _loss(acts[-1], target, labelled, weight)
    out: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        out[:0] = [g.T @ acts[i], g.sum(axis=0)]
        g = (g @ layers[i][0]) * (acts[i] > 0) if i else g
    return loss, out


def _cut(flat: np.ndarray, dims: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in zip(dims[:-1], dims[1:], strict=True):
        layers.append((flat[at : at + a * b].reshape(b, a), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def started(dims: list[int], seed: int = 0) -> np.ndarray:
    """First weights of a network with these widths (He's law), biases 0, as one vector."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in zip(dims[:-1], dims[1:], strict=True)])


class _Dense:
    """What a round needs of a dense network: first weights, a batch's loss, and its gradient."""

    def __init__(self, dims: list[int], labelled: bool, how: Fit):
        self.dims, self.labelled, self.how, self.inputs = dims, labelled, how, ((dims[0],),)

    def start(self) -> np.ndarray:
        return started(self.dims, self.how.seed)

    def loss(self, flat, xs, y) -> float:
        return _loss(_forward(xs[0], _cut(flat, self.dims))[-1], y if self.labelled else xs[0], self.labelled, self.how.positive_weight)[0]

    def gradient(self, flat, xs, y, rng) -> np.ndarray:
        clean = xs[0]
        seen = clean + rng.normal(0, self.how.noise, clean.shape) if self.how.noise else clean
        _, grads = gradient(seen, y if self.labelled else clean, _cut(flat, self.dims), self.labelled, self.how.positive_weight)
        return np.concatenate([d.ravel() for d in grads])


class _Sequence:
    """The same of a network on a tape (:mod:`tidewatch.operators.nets`)."""

    def __init__(self, net, how: Fit):
        self.net, self.how, self.inputs = net, how, net.inputs

    def start(self) -> np.ndarray:
        return self.net.start(self.how.seed)

    def loss(self, flat, xs, y) -> float:
        return self.net.loss(flat, xs, y, self.how.positive_weight)

    def gradient(self, flat, xs, y, rng) -> np.ndarray:
        return self.net.gradient(flat, xs, y, self.how.positive_weight)[1]


def train(df: DataFrame, array: str, hidden: list[int], label: str | None = None, how: Fit = Fit()) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float]]:
    """Layers of the best round and the loss of the rows held out (or of all rows, if none are) before each round.

    Rows with a null array or label take no part; ``df`` should be a stored or cached table, since each round reads it. The order of rows within tasks is part of the
    result, so a run repeats itself on the same partitions only.
    """
    first = df.where(F.col(array).isNotNull()).select(F.size(array).alias("n")).first()
    if first is None:
        raise ValueError("there are no rows to train on")
    dims = [first["n"], *hidden, first["n"] if label is None else 1]
    best, losses = _trained(df, [array], label, _Dense(dims, label is not None, how), how)
    return [(w.copy(), b.copy()) for w, b in _cut(best, dims)], losses


def train_net(df: DataFrame, net, inputs: list[str], label: str, how: Fit = Fit()) -> tuple[np.ndarray, list[float]]:
    """A network of :mod:`tidewatch.operators.nets` trained over all rows, as :func:`train`: its parameters and the held losses.

    ``inputs``: a flat array column for each of the network's inputs; ``label``: 0/1, or an array of one for each step, of which nulls don't count.
    """
    return _trained(df, inputs, label, _Sequence(net, how), how)


def _trained(df: DataFrame, inputs: list[str], label: str | None, objective, how: Fit) -> tuple[np.ndarray, list[float]]:
    rows, target = df, F.array(F.lit(0.0))
    for c in inputs:
        rows = rows.where(F.col(c).isNotNull())
    if label is not None:
        rows = rows.where(F.col(label).isNotNull())
        target = F.col(label).cast("array<double>") if df.schema[label].dataType.typeName() == "array" else F.array(F.col(label).cast("double"))
    held = F.pmod(F.xxhash64(*[F.col(c) for c in inputs], F.lit(how.seed)), F.lit(1 << 20)) < int(how.held * (1 << 20))
    rows = rows.select(*[F.col(c).cast("array<double>").alias(f"x{i}") for i, c in enumerate(inputs)], target.alias("y"), held.alias("held"))
    flat = objective.start()
    size = len(flat)
    state, step, watch, best, losses = np.concatenate([flat, np.zeros(2 * size)]), 0.0, Patience(how.patience), flat, []
    for at in range(how.rounds + 1):
        # the last round only scores
        sums = _round(rows, objective, state, step, cosine_rate(how.rate, at, how.rounds), at, how, at < how.rounds)
        n_fit, loss_held, n_held, steps = sums[-4:]
        if n_held:
            losses.append(loss_held / n_held)
            if watch.better(losses[-1]):
                best = state[:size]
            if watch.stop:
                break
        else:
            best = state[:size]
        if not n_fit or at == how.rounds:
            break
        state, step = sums[:-4] / n_fit, steps / n_fit
    return best, losses


def summed(parts: DataFrame, fan: int = 32) -> np.ndarray:
    """The sum by place of ``parts`` (part: a number of the task, v: an array, one a task), in a tree: no step adds up more than about ``fan`` arrays, the driver no more either."""
    import pyarrow as pa

    def add(table: pa.Table) -> pa.Table:
        total = sum(v.values.to_numpy() for v in table.column("v"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "v": pa.array([total], pa.list_(pa.float64()))})

    tasks = parts.rdd.getNumPartitions()
    while tasks > fan:
        tasks = -(-tasks // fan)
        parts = parts.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("part").applyInArrow(add, "part long, v array<double>")
    found = parts.toArrow().column("v")
    return sum((v.values.to_numpy() for v in found), np.zeros(1))


def _round(rows: DataFrame, objective, state: np.ndarray, step: float, rate: float, at: int, how: Fit, learn: bool) -> np.ndarray:
    """Sums over all tasks: weights and moments times rows learnt; then rows learnt, held loss, rows held, steps times rows learnt."""
    size, inputs = len(state) // 3, objective.inputs

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rng = np.random.default_rng([how.seed, at, task])
        mine, t, learnt, n_held, loss_held = state.copy(), step, 0, 0, 0.0
        flat, m, v = mine[:size], mine[size : 2 * size], mine[2 * size :]
        for batch in batches:
            xs = [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape) for i, shape in enumerate(inputs)]
            y, out = batch.column(len(inputs)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column(len(inputs) + 1).to_numpy(zero_copy_only=False).astype(bool)
            if out.any() or how.held <= 0:
                scored = np.flatnonzero(out) if out.any() else np.arange(len(y))
                for part in np.array_split(scored, -(-len(scored) // how.batch)):
                    loss_held += objective.loss(state[:size], [x[part] for x in xs], y[part]) * len(part)
                n_held += len(scored)
            if not learn:
                continue
            order = rng.permutation(np.flatnonzero(~out))
            for part in np.array_split(order, -(-len(order) // how.batch)) if len(order) else []:
                g = objective.gradient(flat, [x[part] for x in xs], y[part], rng)
                norm = float(np.sqrt(g @ g))
                if how.clip and norm > how.clip:
                    g *= how.clip / norm
                t += 1
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                flat -= rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + how.decay * flat)
                learnt += len(part)
        values = np.concatenate([mine * learnt, [learnt, loss_held, n_held, t * learnt]])
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([values], pa.list_(pa.float64()))], names=["part", "v"])

    return summed(rows.mapInArrow(work, "part long, v array<double>"))
