"""Metrics from scores and labels. Curves are made from counts by distinct score; only those are put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.stats import ratio
from tidewatch.operators.ordered import quantiles, running


def by_score(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, score, p, n): positives and negatives at each distinct score."""
    return rows.groupBy(*keys, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("n"))


def pr_curve(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score as threshold; curves of different keys apart."""
    keys = list(keys)
    counts = by_score(rows, keys)
    total = counts.groupBy(*keys).agg(F.sum("p").alias("all_p"))
    c = running(counts, keys, "score", {"tp": (F.sum, "p"), "fp": (F.sum, "n")}, descending=True).alias("c")
    # without keys the total is one row
    c = c.join(total.alias("t"), F.expr(" and ".join(f"c.`{k}` <=> t.`{k}`" for k in keys))) if keys else c.join(F.broadcast(total))
    return c.select(*[F.col(f"c.`{k}`") for k in keys], "score", "p", "n", "tp", "fp", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("all_p")).alias("recall"))


def metrics(rows: DataFrame, keys: list[str] = (), threshold: float = 0.5) -> DataFrame:
    """Area under ROC (ties count half), average precision, precision, recall and F1 at the threshold; areas are 0 without positives."""
    keys = list(keys)
    c = pr_curve(rows, keys)
    # a positive beats the negatives below its score, and half of those at it
    g = c.groupBy(*keys).agg(
        F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.col("p") * (F.col("fp") - F.col("n") / 2)).alias("lost"), F.sum(F.col("p") * F.col("precision")).alias("ap"),
        F.sum(F.when(F.col("score") >= threshold, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("score") >= threshold, F.col("n")).otherwise(0)).alias("fp"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("pos"))
    return g.select(
        *keys,
        F.when(F.col("pos") > 0, 1 - ratio(F.col("lost"), F.col("pos") * F.col("neg"))).otherwise(0.0).alias("roc_auc"),
        F.when(F.col("pos") > 0, ratio(F.col("ap"), F.col("pos"))).otherwise(0.0).alias("average_precision"),
        precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def best_f1(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The threshold with the best F1; of equals the largest."""
    keys = list(keys)
    c = pr_curve(rows, keys).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    best = F.max_by(F.struct("score", "f1"), F.struct(F.round("f1", 12), "score"))
    return c.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def confusion(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """tp, fp, tn, fn and each class's precision and recall. ``rows``: label, predicted (0/1)."""
    y, z = F.col("label") == 1, F.col("predicted") == 1
    g = rows.groupBy(*keys).agg(F.count_if(y & z).alias("tp"), F.count_if(~y & z).alias("fp"), F.count_if(~y & ~z).alias("tn"), F.count_if(y & ~z).alias("fn"))
    c = F.col
    return g.withColumns({
        "precision_1": ratio(c("tp"), c("tp") + c("fp")), "recall_1": ratio(c("tp"), c("tp") + c("fn")),
        "precision_0": ratio(c("tn"), c("tn") + c("fn")), "recall_0": ratio(c("tn"), c("tn") + c("fp")),
    })


def predictions_with_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """By base name; predictions without truth are dropped."""
    base = lambda c: F.regexp_extract(c, r"([^/\\]+)$", 1)
    return predicted.withColumn("capture", base("capture")).join(truth.withColumn("capture", base("capture")), "capture")


def window_truth(windows: DataFrame, starts: DataFrame) -> DataFrame:
    """1 from the capture's attack start on; 0 where the start is missing."""
    return windows.join(starts, "capture", "left").withColumn("label", F.coalesce(F.col("start") >= F.col("attack_start"), F.lit(False)).cast("int")).drop("attack_start")


def latency(detections: DataFrame) -> DataFrame:
    """Seconds from an attack's start to its detection, never below 0: count, mean and 95th percentile. Accepts either name of the detection's time."""
    at = [F.col(c) for c in ("first_attack", "first_attack_timestamp", "first_attack_window_ts") if c in detections.columns]
    gap = F.coalesce(*at).cast("double") - F.col("attack_start").cast("double")
    gaps = detections.select(gap.alias("g")).where("g is not null").select(F.greatest("g", F.lit(0.0)).alias("g"))
    p95 = quantiles(gaps, ["g"], [0.95]).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("p95"))
    return gaps.agg(F.count("*").alias("count"), F.coalesce(F.avg("g"), F.lit(0.0)).alias("mean")).join(F.broadcast(p95))
