"""Queries over cleaning, scaling, thresholds and small models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions.stats import rounded
from tidewatch.operators import prep
from tidewatch.operators import score as sc
from tidewatch.operators.ordered import quantiles
from tidewatch.plans.registry import query
from tidewatch.sources.tables import table

COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in COLUMNS])


_ITEMS = "i as (select l_orderkey, l_linenumber, l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice, l_discount::double as l_discount from lineitem)"


def _scaled(kind):
    def run(spark, sf_dir):
        rows = items(spark, sf_dir)
        d = prep.fit_scaler(rows, list(COLUMNS), kind).apply(rows)
        return d.select("l_orderkey", "l_linenumber", *[rounded(F.col(c), 5).alias(c) for c in COLUMNS])

    return run


_FITS = {
    "robust": ("quantile_cont({c}, 0.5)", "coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) + 1e-9"),
    "standard": ("avg({c})", "coalesce(nullif(stddev_pop({c}), 0), 1)"),
    "minmax": ("min({c})", "coalesce(nullif(max({c}) - min({c}), 0), 1)"),
}
for _kind, (_m, _s) in _FITS.items():
    _fit = ", ".join(f"{_m.format(c=c)} as m_{c}, {_s.format(c=c)} as s_{c}" for c in COLUMNS)
    query(f"with {_ITEMS}, f as (select {_fit} from i) select l_orderkey, l_linenumber, {', '.join(f'round(({c} - m_{c}) / s_{c}, 5) as {c}' for c in COLUMNS)} from i, f", f"{_kind}_scale")(_scaled(_kind))


@query(f"""with {_ITEMS}, g as (select l_orderkey, l_linenumber, ln(1 + greatest(l_quantity, 0)) as q, l_extendedprice as p from i), b as (select quantile_cont(q, 0.001) as q0, quantile_cont(q, 0.999) as q1, quantile_cont(p, 0.001) as p0, quantile_cont(p, 0.999) as p1 from g)
    select l_orderkey, l_linenumber, round(least(greatest(q, q0), q1), 6) as l_quantity, round(least(greatest(p, p0), p1), 4) as l_extendedprice from g, b""")
def log_clip(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("l_quantity", prep.log_clipped(prep.finite(F.col("l_quantity"))))
    two = ["l_quantity", "l_extendedprice"]
    d = prep.clip(rows, prep.fit_clip(rows, two))
    return d.select("l_orderkey", "l_linenumber", rounded(F.col("l_quantity")).alias("l_quantity"), rounded(F.col("l_extendedprice"), 4).alias("l_extendedprice"))


@query("select doc_id, (doc_id * 2654435761) % 4294967296 < 429496729 as held from labels")
def hash_split(spark, sf_dir):
    return prep.hash_split(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 0.1)


@query("select doc_id, quality from (select doc_id, quality, row_number() over (partition by quality order by (doc_id * 2654435761) % 4294967296, doc_id) as n from labels) where n <= 40")
def balanced_thin(spark, sf_dir):
    return prep.balanced(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 40)


def errors(spark, sf_dir):
    """A stand-in for reconstruction errors: the mean square of a vector's first eight components, by label as source."""
    v = F.slice("embedding", 1, 8)
    e = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / 8
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("source"), F.round(e, 9).alias("error"))


_ERR = "er as (select vec_id, label::varchar as source, round((embedding[1]::double * embedding[1]::double + embedding[2]::double * embedding[2]::double + embedding[3]::double * embedding[3]::double + embedding[4]::double * embedding[4]::double + embedding[5]::double * embedding[5]::double + embedding[6]::double * embedding[6]::double + embedding[7]::double * embedding[7]::double + embedding[8]::double * embedding[8]::double) / 8, 9) as error from embeddings)"


@query(f"with {_ERR} select source, round(quantile_cont(error, 0.99), 8) as q99, round(quantile_cont(error, 0.995), 8) as q995, round(quantile_cont(error, 0.999), 8) as q999 from er group by source")
def thr_quantile(spark, sf_dir):
    shares = {"q99": 0.99, "q995": 0.995, "q999": 0.999}
    q = quantiles(errors(spark, sf_dir), ["error"], list(shares.values()), ["source"])
    return q.groupBy("source").agg(*[rounded(F.max(F.when(F.col("q") == x, F.col("value"))), 8).alias(n) for n, x in shares.items()])


@query(f"with {_ERR}, m as (select avg(error) as mean, stddev_pop(error) as std, quantile_cont(error, 0.5) as median, quantile_cont(error, 0.99) as q99 from er) select round(mean, 7) as mean, round(std, 7) as std, round(median, 8) as median, round((select quantile_cont(abs(error - median), 0.5) from er), 8) as mad, round(mean + 3 * std, 7) as threshold from m")
def thr_gaussian(spark, sf_dir):
    rows = errors(spark, sf_dir)
    s = prep.error_stats(rows, "error")
    return s.select(rounded(F.col("mean"), 7).alias("mean"), rounded(F.col("std"), 7).alias("std"), rounded(F.col("median"), 8).alias("median"), rounded(F.col("mad"), 8).alias("mad"), rounded(F.col("mean") + 3 * F.col("std"), 7).alias("threshold"))


@query(f"with {_ERR}, t as (select quantile_cont(error, 0.9) as q from er), k as (select error from er, t where error <= q) select count(*) as kept, round(quantile_cont(error, 0.995), 8) as threshold from k")
def thr_trim(spark, sf_dir):
    kept = prep.trimmed(errors(spark, sf_dir), "error", 0.9)
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(quantiles(kept, ["error"], [0.995]).select(rounded(F.col("value"), 8).alias("threshold"))))


@query(f"""with {_ERR}, g as (select quantile_cont(error, 0.9) as trained, quantile_cont(error, 0.95) as stats_at from er), s as (select source, quantile_cont(error, 0.95) as source_at, quantile_cont(error, 0.5) as auto_at from er group by source)
    select source, round(least(greatest(trained, stats_at * 0.9, source_at * 0.95, least(auto_at * 3, trained * 1.2), 0.001), 0.5), 8) as threshold from s, g""")
def thr_effective(spark, sf_dir):
    rows = errors(spark, sf_dir)
    at = lambda q, name: F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
    g = quantiles(rows, ["error"], [0.9, 0.95]).agg(at(0.9, "trained"), at(0.95, "stats_at"))
    s = quantiles(rows, ["error"], [0.5, 0.95], ["source"]).groupBy("source").agg(at(0.95, "source_at"), at(0.5, "auto_at"))
    t = prep.effective_threshold(F.col("trained"), F.col("stats_at"), F.col("source_at"), F.col("auto_at"), stats_scale=0.9, source_scale=0.95, auto_scale=3.0, auto_cap=1.2, low=0.001, high=0.5)
    return s.join(F.broadcast(g)).select("source", rounded(t, 8).alias("threshold"))


@query(None)
def thr_evt(spark, sf_dir):
    t = prep.extreme_threshold(errors(spark, sf_dir), "error", seed_q=0.9)
    return spark.createDataFrame([(float(t),)], "threshold double")


def _wide(spark, sf_dir, n=6):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)])


@query(None)
def pca_project(spark, sf_dir):
    columns = [f"x{i}" for i in range(6)]
    rows = _wide(spark, sf_dir)
    means, components, _ = prep.principal(rows, columns, 2)
    return prep.project(rows, columns, means, components).select("vec_id", "pc1", "pc2")


@query(None)
def fusion_logit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("a"), (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))).cast("double").alias("b"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).join(d, "doc_id")
    weights, bias = sc.fuse(rows, ["a", "b"], "label")
    return rows.select("doc_id", sc.logistic(rows, weights, bias).alias("score"))


#: A fixed network of 8 - 3 - 8 units, from a rule.
_W1 = np.array([[((3 * i + 5 * j) % 7 - 3) / 8 for j in range(8)] for i in range(3)])
_W2 = np.array([[((2 * i + 3 * j) % 5 - 2) / 4 for j in range(3)] for i in range(8)])
_B1, _B2 = np.array([0.05, 0.0, -0.05]), np.zeros(8)
_H = [" + ".join(f"({w}) * x[{j + 1}]" for j, w in enumerate(row)) + f" + ({b})" for row, b in zip(_W1.tolist(), _B1.tolist(), strict=True)]
_O = [" + ".join(f"({w}) * h{j}" for j, w in enumerate(row)) for row in _W2.tolist()]


@query(f"with v as (select vec_id, list_transform(embedding[1:8], lambda e: e::double) as x from embeddings), h as (select vec_id, x, {', '.join(f'greatest({e}, 0) as h{i}' for i, e in enumerate(_H))} from v) select vec_id, round(({' + '.join(f'({o} - x[{i + 1}]) * ({o} - x[{i + 1}])' for i, o in enumerate(_O))}) / 8, 7) as error from h")
def score_mlp(spark, sf_dir):
    """Reconstruction error of a small autoencoder, in Arrow batches."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("x"))
    return sc.scored(rows, "x", sc.autoencoder_error, [(_W1, _B1), (_W2, _B2)], "error").select("vec_id", rounded(F.col("error"), 7).alias("error"))


@query(f"with v as (select vec_id, list_transform(embedding[1:8], lambda e: e::double) as x from embeddings) select vec_id, {', '.join(f'round(greatest({e}, 0), 7) as h{i}' for i, e in enumerate(_H))} from v")
def score_layer(spark, sf_dir):
    """The same first layer as an expression, without Python."""
    x = F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    h = rows.select("vec_id", sc.dense_layer(F.col("x"), _W1, _B1).alias("h"))
    return h.select("vec_id", *[rounded(F.col("h")[i], 7).alias(f"h{i}") for i in range(3)])


@query("with v as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c, embedding[4]::double as d, embedding[5]::double as e from embeddings) select vec_id, round((exp(d) * a + exp(e) * (b + c) / 2) / (exp(d) + exp(e)), 7) as logit from v")
def score_mixture(spark, sf_dir):
    """Two experts, the second with two outputs, mixed by a softmax gate."""
    x = [F.col("embedding")[i].cast("double") for i in range(5)]
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(sc.mixture(F.array(x[3], x[4]), [x[0], (x[1] + x[2]) / 2]), 7).alias("logit"))


@query("with y as (select doc_id, (n_chars / 1000.0 - 2) as z, quality from labels join documents using (doc_id)) select doc_id, round(1 / (1 + exp(-z / 2.5)), 6) as prob, round(-(case when quality = 1 then 0.25 else 0.75 end) * pow(1 - (case when quality = 1 then 1 / (1 + exp(-z / 2.5)) else 1 - 1 / (1 + exp(-z / 2.5)) end), 2) * ln(greatest(case when quality = 1 then 1 / (1 + exp(-z / 2.5)) else 1 - 1 / (1 + exp(-z / 2.5)) end, 1e-12)), 6) as loss from y")
def score_calibrated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0 - 2).alias("z"))
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id").withColumn("prob", sc.calibrated(F.col("z"), 2.5))
    return rows.select("doc_id", rounded(F.col("prob")).alias("prob"), rounded(sc.focal_loss(F.col("prob"), F.col("quality"))).alias("loss"))


@query(None)
def importance(spark, sf_dir):
    rows = _wide(spark, sf_dir, 3)
    return sc.permutation_importance(rows, ["x0", "x1", "x2"], sc.logistic(rows, {"x0": 4.0, "x1": 1.0, "x2": 0.0}, 0.0), "vec_id")
