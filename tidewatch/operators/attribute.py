"""Who is behind an anomaly: hosts, actors and claims, ranked. Ties are broken by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.stats import ratio


def host_activity(counts: DataFrame, scores: DataFrame) -> DataFrame:
    """Activity of each host weighted by its windows' scores. Suspicion is the attack score, or else half the score sum, plus 0.01 for each attack packet.

    ``counts``: capture, window_index, host, cnt; ``scores``: capture, window_index, score, is_attack.
    """
    j = counts.join(scores, ["capture", "window_index"]).withColumn("hit", F.coalesce("is_attack", F.lit(False)))
    on = lambda c: F.when(F.col("hit"), c).otherwise(0)
    weighted = F.col("score") * F.col("cnt")
    g = j.groupBy("capture", "host").agg(
        F.sum("cnt").alias("total_packets"), F.count("*").alias("total_windows"), F.sum(weighted).alias("score_sum"), F.max("score").alias("max_window_score"),
        F.sum(on(F.col("cnt"))).alias("attack_packets"), F.count_if("hit").alias("attack_windows"), F.sum(on(weighted)).alias("attack_score"), F.max(on(F.col("score"))).alias("max_attack_score"),
    )
    suspicion = F.when(F.col("attack_score") > 0, F.col("attack_score")).otherwise(F.col("score_sum") * 0.5) + F.col("attack_packets") * 0.01
    return g.withColumns({"mean_score": ratio(F.col("score_sum"), F.col("total_packets")), "attack_ratio": ratio(F.col("attack_packets"), F.col("total_packets")), "suspicion": suspicion})


def ranked(activity: DataFrame, by: list[str] = ("attack_score", "attack_packets", "score_sum"), top: int | None = None) -> DataFrame:
    order = [F.desc(c) for c in by]
    rows = activity.withColumn("rank", F.row_number().over(W.partitionBy("capture").orderBy(*order, "host")))
    return rows.where(F.col("rank") <= top) if top else rows


def top_claims(claims: DataFrame, n: int = 5) -> DataFrame:
    """The n addresses that a mac claims most, as one text: ip=replies, ...."""
    per = claims.where("replies > 0").groupBy("capture", "mac", "ip").agg(F.sum("replies").alias("replies"))
    first = per.withColumn("r", F.row_number().over(W.partitionBy("capture", "mac").orderBy(F.desc("replies"), "ip"))).where(F.col("r") <= n)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("r", F.format_string("%s=%d", "ip", "replies").alias("t")))), lambda x: x["t"])
    return first.groupBy("capture", "mac").agg(F.array_join(texts, ",").alias("claimed_ips"), F.max(F.when(F.col("r") == 1, F.col("ip"))).alias("top_ip"))


def arp_host_activity(counts: DataFrame, scores: DataFrame, claims: DataFrame) -> DataFrame:
    """As :func:`host_activity`, and half a point more for each address beyond the first that a mac's replies claim."""
    act = host_activity(counts, scores)
    conflict = claims.where("replies > 0").groupBy("capture", F.col("mac").alias("host")).agg(F.count_distinct("ip").alias("reply_ips"))
    j = act.join(conflict, ["capture", "host"], "left").withColumn("reply_conflict_ips", F.greatest(F.coalesce("reply_ips", F.lit(0)) - 1, F.lit(0))).drop("reply_ips")
    return j.withColumn("suspicion", F.col("suspicion") + 0.5 * F.col("reply_conflict_ips")).join(top_claims(claims).withColumnRenamed("mac", "host"), ["capture", "host"], "left")


def actor_rank(counts: DataFrame, probs: DataFrame, tau: float, least_packets: int = 3, window_seconds: float = 1.0) -> DataFrame:
    """Actors by (0.6 mean + 0.25 max + 0.15 share of high windows) * ln(1 + packets); a window is high for an actor with at least three packets in it."""
    j = counts.join(probs, ["capture", "window_index"])
    g = j.groupBy("capture", "host").agg(
        F.sum("cnt").alias("total_packets"), F.sum(F.col("prob") * F.col("cnt")).alias("weighted"), F.count("*").alias("windows"), F.count_if((F.col("prob") >= tau) & (F.col("cnt") >= least_packets)).alias("high_prob_windows"), F.max("prob").alias("max_prob"), F.max("cnt").alias("max_packets"),
    ).where("total_packets > 0")
    mean = F.col("weighted") / F.col("total_packets")
    parts = 0.6 * mean + 0.25 * F.col("max_prob") + 0.15 * F.least(F.lit(1.0), F.col("high_prob_windows") / F.greatest("windows", F.lit(1)))
    return g.select("capture", "host", (parts * F.log1p("total_packets")).alias("score"), mean.alias("mean_prob"), "max_prob", "windows", "high_prob_windows", "total_packets", "max_packets", (F.col("max_packets") / max(window_seconds, 1e-6)).alias("peak_packets_per_sec"))


def claim_rank(claims: DataFrame, probs: DataFrame) -> DataFrame:
    """Macs by what their replies claim: weighted replies, 10 * max probability, 0.01 a reply, 0.1 a window, 500 a window with several
    addresses, 1000 for each address beyond the first."""
    per = claims.where("replies > 0").groupBy("capture", "window_index", "mac").agg(F.sum("replies").alias("replies"), F.count_distinct("ip").alias("ips"))
    j = per.join(probs, ["capture", "window_index"])
    g = j.groupBy("capture", "mac").agg(
        F.sum("replies").alias("total_replies"), F.count("*").alias("windows"), F.count_if(F.col("ips") > 1).alias("conflict_windows"), F.sum(F.col("prob") * F.col("replies")).alias("weighted"), F.max("prob").alias("max_prob"), F.min(F.when(F.col("ips") > 1, F.col("start"))).alias("first_conflict"),
    )
    distinct = claims.where("replies > 0").groupBy("capture", "mac").agg(F.count_distinct("ip").alias("distinct_ips"))
    c = F.col
    score = c("weighted") + c("max_prob") * 10 + c("total_replies") * 0.01 + c("windows") * 0.1 + c("conflict_windows") * 500 + F.greatest(c("distinct_ips") - 1, F.lit(0)) * 1000
    return g.join(distinct, ["capture", "mac"]).withColumn("score", score).drop("weighted")


def best_claim(ranks: DataFrame, conflicting: bool = False) -> DataFrame:
    rows = ranks.where("distinct_ips >= 2") if conflicting else ranks
    return rows.withColumn("r", F.row_number().over(W.partitionBy("capture").orderBy(F.desc("score"), "mac"))).where("r = 1").drop("r")


def reply_override(verdicts: DataFrame, ranks: DataFrame) -> DataFrame:
    """A capture whose first-ranked conflicting mac answers for two addresses or more is an attack; the family stays as it was."""
    worst = best_claim(ranks, True).select("capture", F.col("mac").alias("conflicting_mac"))
    return verdicts.join(worst, "capture", "left").withColumn("decision", F.when(F.col("conflicting_mac").isNotNull(), "attack").otherwise(F.col("decision")))


def suspect_pair(actors: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first actor (an address) of each capture with the mac it is seen with most. ``pairs``: capture, ip, mac, cnt."""
    first = actors.withColumn("r", F.row_number().over(W.partitionBy("capture").orderBy(F.desc("score"), "host"))).where("r = 1").drop("r")
    macs = pairs.withColumn("r", F.row_number().over(W.partitionBy("capture", "ip").orderBy(F.desc("cnt"), "mac"))).where("r = 1").select("capture", F.col("ip").alias("host"), F.col("mac").alias("suspect_mac"))
    return first.join(macs, ["capture", "host"], "left")


def mean_scores(sequence_scores: DataFrame) -> DataFrame:
    """A window's score as the mean over the sequences that hold it. ``sequence_scores``: capture, window_index, score."""
    return sequence_scores.groupBy("capture", "window_index").agg(F.avg("score").alias("score"))


def top_share(scores: DataFrame, share: float) -> DataFrame:
    """For each capture the mean and the least of its ceil(n * share) largest scores."""
    n = scores.groupBy("capture").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("capture").orderBy(F.desc("score"), "window_index"))
    top = scores.withColumn("r", rank).join(n, "capture").where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share)))
    return top.groupBy("capture").agg(F.avg("score").alias("top_mean"), F.min("score").alias("tail_threshold"), F.count("*").alias("k"))


def top_windows(scores: DataFrame, share: float = 0.10) -> DataFrame:
    """The max(1, floor(n * share)) windows with the largest scores of each capture; the first of equals wins."""
    n = scores.groupBy("capture").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("capture").orderBy(F.desc("score"), "window_index"))
    return scores.withColumn("rank", rank).join(n, "capture").where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).drop("n")
