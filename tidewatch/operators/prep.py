"""Cleaning, scaling, splitting and thresholds. Fits are aggregations and exact quantiles in parts; parameters are small rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.stats import interpolated
from tidewatch.operators.ordered import quantile_values, quantiles
from tidewatch.operators.train import summed


def finite(c: Column) -> Column:
    """NaN, infinities and null as 0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def log_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


@dataclass(frozen=True)
class Scaler:
    """(x - centre) / scale for each column."""

    centre: dict[str, float]
    scale: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - m) / self.scale[c] for c, m in self.centre.items()})

    def invert(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.scale[c] + m for c, m in self.centre.items()})


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "robust") -> Scaler:
    """robust: median and interquartile range (plus 1e-9; 1 where it is 0); robust_plain: without the 1e-9;
    standard: mean and population deviation; minmax: least value and range. Constant columns have scale 1."""
    if kind in ("robust", "robust_plain"):
        found = {c: (m, (high - low) or 1.0) for c, (low, m, high) in quantile_values(df, columns, [0.25, 0.5, 0.75]).items()}
        extra = 1e-9 if kind == "robust" else 0.0
        return Scaler({c: float(m) for c, (m, _) in found.items()}, {c: float(s) + extra for c, (_, s) in found.items()})
    if kind == "standard":
        row = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]).first()
        return Scaler({c: float(row[f"{c}_m"]) for c in columns}, {c: float(row[f"{c}_s"]) or 1.0 for c in columns})
    if kind == "minmax":
        row = df.agg(*[F.min(c).alias(f"{c}_m") for c in columns], *[F.max(c).alias(f"{c}_x") for c in columns]).first()
        return Scaler({c: float(row[f"{c}_m"]) for c in columns}, {c: float(row[f"{c}_x"] - row[f"{c}_m"]) or 1.0 for c in columns})
    raise ValueError(f"unknown scaler {kind!r}")


def fit_clip(df: DataFrame, columns: list[str], low: float = 0.001, high: float = 0.999) -> dict[str, tuple[float, float]]:
    found = quantile_values(df, columns, [low, high])
    return {c: tuple(found[c]) for c in columns}


def clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.least(F.greatest(F.col(c).cast("double"), F.lit(a)), F.lit(b)) for c, (a, b) in bounds.items()})


def backfilled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order; those that are missing as 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def prepared(df: DataFrame, columns: list[str], logs: list[str], clips: dict | None, scaler: Scaler) -> DataFrame:
    """invalid to 0, log, clip, invalid to 0, scale."""
    df = df.withColumns({c: finite(F.col(c)) for c in columns})
    df = df.withColumns({c: log_clipped(F.col(c)) for c in logs})
    if clips:
        df = clip(df, clips)
    return scaler.apply(df.withColumns({c: finite(F.col(c)) for c in columns}))


def hash_split(df: DataFrame, key: str, share: float) -> DataFrame:
    """A deterministic split: ``held`` is true for about ``share`` of the keys, whatever the partitioning."""
    place = F.expr(f"cast(({key} * 2654435761) % 4294967296 as long)")
    return df.withColumn("held", place < int(share * (1 << 32)))


#: Parts of a label that are ordered by themselves.
SALTS = 64


def balanced(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, chosen by a hash of the key: the first of each of ``SALTS`` parts of a label, then the first of these, so
    that no task orders a whole label."""
    order = F.expr(f"cast(({key} * 2654435761) % 4294967296 as long)")
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    part = df.withColumn("__n", F.row_number().over(W.partitionBy(label, salt).orderBy(order, key))).where(F.col("__n") <= per_class)
    return part.withColumn("__n", F.row_number().over(W.partitionBy(label).orderBy(order, key))).where(F.col("__n") <= per_class).drop("__n")


def principal(df: DataFrame, columns: list[str], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, components and share of variance; rows with a null take no part. One pass for the means, and one in which each task adds up the products of its centred rows
    as one matrix; these are summed in a tree."""
    d = len(columns)
    rows = df.select(*[F.col(c).cast("double") for c in columns]).dropna()
    row = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)]).first()
    means = np.array([row[f"m_{i}"] or 0.0 for i in range(d)])

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        gram = np.zeros((d, d))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)], 1) - means
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([gram.ravel()], pa.list_(pa.float64()))], names=["part", "v"])

    gram = summed(rows.mapInArrow(work, "part long, v array<double>"))
    cov = np.broadcast_to(gram, (d * d,)).reshape(d, d) / max(row["n"] - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: min(components, max(row["n"] - 1, 1), d)]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order])
    total = values.sum()
    return means, vectors.T, values[order] / total if total else values[order]


def project(df: DataFrame, columns: list[str], means: np.ndarray, components: np.ndarray) -> DataFrame:
    """Centred projection, as one expression a component."""
    out = {f"pc{k + 1}": sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, means, row, strict=True)), F.lit(0.0)) for k, row in enumerate(components)}
    return df.withColumns(out)


# thresholds

def quantile_threshold(df: DataFrame, error: str, q: float) -> float:
    return quantile_values(df, [error], [q])[error][0]


def gaussian_threshold(df: DataFrame, error: str, k: float) -> float:
    row = df.agg(F.avg(error), F.stddev_pop(error)).first()
    return float(row[0]) + k * float(row[1])


def trimmed(df: DataFrame, error: str, q: float) -> DataFrame:
    """Rows up to the quantile."""
    return df.join(F.broadcast(quantiles(df, [error], [q]).select(F.col("value").alias("trim_at"))), F.col(error) <= F.col("trim_at")).drop("trim_at")


def error_stats(df: DataFrame, error: str) -> DataFrame:
    """mean, population deviation, median, median absolute deviation and upper quantiles: one row."""
    shares = {"median": 0.5, "q99": 0.99, "q995": 0.995, "q999": 0.999}
    q = quantiles(df, [error], list(shares.values())).agg(*[F.max(F.when(F.col("q") == x, F.col("value"))).alias(n) for n, x in shares.items()])
    apart = df.join(F.broadcast(q.select("median"))).select(F.abs(F.col(error) - F.col("median")).alias("apart"))
    mad = quantiles(apart, ["apart"], [0.5]).agg(F.max("value").alias("mad"))
    first = df.agg(F.avg(error).alias("mean"), F.stddev_pop(error).alias("std"))
    return first.join(F.broadcast(q)).join(F.broadcast(mad))


def generalized_pareto(excess: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Shape and scale by maximum likelihood (the profile likelihood of Grimshaw's reparametrisation, on a grid, then refined).

    ``weights`` says how many rows each value stands for (one, if not given)."""
    share = (np.ones(len(excess)) if weights is None else np.asarray(weights, float))[excess > 0]
    x = excess[excess > 0]
    order = np.argsort(x)
    x, share = x[order], share[order] / max(share.sum(), 1)
    if len(x) < 2:
        return 0.0, float(x.mean()) if len(x) else 0.0
    mean = float(x @ share)
    low, high = -1 / x[-1] + 1e-9, 5 / mean

    def likelihood(t: np.ndarray) -> np.ndarray:
        z = np.log1p(t[:, None] * x[None, :])
        k = z @ share
        with np.errstate(divide="ignore", invalid="ignore"):
            v = -np.log(k / t) - k - 1
        return np.where(np.abs(t) < 1e-12, -np.log(mean) - 1, np.nan_to_num(v, nan=-np.inf))

    for _ in range(6):
        grid = np.linspace(low, high, 200)
        best = grid[int(np.argmax(likelihood(grid)))]
        step = (high - low) / 199
        low, high = max(-1 / x[-1] + 1e-9, best - step), best + step
    shape = float(np.log1p(best * x) @ share)
    return (shape, shape / best) if abs(best) > 1e-12 else (0.0, mean)


def extreme_threshold(df: DataFrame, error: str, seed_q: float = 0.98, q: float = 0.99, per_octave: int = 64) -> float:
    """The q-quantile of a generalized Pareto law over the tail beyond the seed quantile.

    The tail reaches the driver as a histogram, whatever its size: means and counts of bins whose width grows with the value
    (``per_octave`` for each doubling), so that an outlier leaves the others' bins as they are. The counts are weights in the likelihood.
    """
    start = quantile_threshold(df, error, seed_q)
    tail = df.where(F.col(error) > start).select((F.col(error) - start).alias("x")).where("x > 0")
    cells = tail.groupBy(F.floor(F.log2("x") * per_octave).alias("b")).agg(F.avg("x").alias("x"), F.count("*").alias("n")).orderBy("b").collect()
    if not cells:
        return start
    shape, scale = generalized_pareto(np.array([r["x"] for r in cells]), np.array([r["n"] for r in cells]))
    return start + (scale * ((1 - q) ** -shape - 1) / shape if abs(shape) > 1e-9 else -scale * float(np.log(1 - q)))


def effective_threshold(trained: Column, stats_at: Column, source_at: Column, auto_at: Column, stats_scale: float = 1.0, source_scale: float = 1.0, auto_scale: float = 1.0, auto_cap: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """The largest of what training, the error statistics, the source's own statistics and the (capped) file itself give; then the clamp."""
    auto = auto_at * auto_scale
    if auto_cap is not None:
        auto = F.least(auto, trained * auto_cap)
    out = F.greatest(trained, stats_at * stats_scale, source_at * source_scale, auto)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.least(out, F.lit(high)) if high is not None else out


def between_quantiles(q: float, known: dict[float, float]) -> Column:
    """A quantile by interpolation between those that are known."""
    xs = sorted(known)
    return interpolated(F.lit(q), xs, [known[x] for x in xs])
