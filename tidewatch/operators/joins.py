"""Joins of windows and packets with labels, intervals, inventories and campaigns.

Dimensions keep an equality key, so Catalyst hashes or broadcasts them by size; inequalities are residual conditions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.net import is_private_ipv4


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], least: Column, how: str = "inner") -> DataFrame:
    """Rows of both whose keys are equal and whose half-open spans (numbers, of one unit) overlap, by buckets of time beside the keys.

    A span of ``right`` stands in buckets of a power of two as wide as itself (and as ``least``, a number of the right row, at
    the narrowest), so in two or three of them; a row of ``left`` looks into the buckets that it touches at each width that its key has. Spans that lie
    apart in time never meet, however many a key has; a pair that shares several buckets is joined in the first of them only. ``right`` may not share column names
    with ``left`` but for the keys; with ``how`` "left" rows that meet nothing stay (several times, where they touch several buckets).
    """
    a, b = (F.col(c) for c in left_span)
    c, d = (F.col(x) for x in right_span)
    touched = lambda low, high, width: F.sequence(F.floor(low / width).cast("long"), F.greatest(F.ceil(high / width) - 1, F.floor(low / width)).cast("long"))
    wide = right.where(c < d).withColumn("__level", F.ceil(F.log2(F.greatest(d - c, least, F.lit(1)).cast("double"))).cast("int"))
    widths = wide.groupBy(*keys).agg(F.array_sort(F.collect_set("__level")).alias("__levels"))
    wide = wide.withColumn("__bucket", F.explode(touched(c, d, F.pow(F.lit(2.0), "__level"))))
    near = left.join(widths, keys, how).withColumn("__level", F.explode_outer("__levels")).drop("__levels")
    near = near.withColumn("__bucket", F.explode_outer(touched(a, b, F.pow(F.lit(2.0), "__level"))))
    met = near.join(wide, [*keys, "__level", "__bucket"], how)
    first = F.col("__bucket") == F.floor(F.greatest(a, c) / F.pow(F.lit(2.0), "__level"))
    overlap = (F.greatest(a, c) < F.least(b, d)) & first
    if how == "inner":
        return met.where(overlap).drop("__level", "__bucket")
    found = [x for x in right.columns if x not in keys]
    return met.withColumns({x: F.when(overlap, F.col(x)) for x in found}).drop("__level", "__bucket")


def label_intervals(windows: DataFrame, intervals: DataFrame, default: str = "normal") -> DataFrame:
    """Windows with attack (0/1) and family of the first interval, in file order, that they overlap; touching ends don't overlap.

    ``windows``: capture, window_index, start, end. ``intervals``: capture, start, end (null: open), family, interval_no. A window
    is compared with the intervals near it in time only (:func:`overlapping`), not with all of its capture.
    """
    span = windows.groupBy("capture").agg(F.min("start").alias("low"), F.max("end").alias("high"), F.max(F.col("end") - F.col("start")).alias("width"))
    i = intervals.join(span, "capture").select("capture", F.greatest("start", "low").alias("i_start"), F.least("end", "high").alias("i_end"), "width", "family", "interval_no")
    met = overlapping(windows.select("capture", "window_index", "start", "end"), i, ["capture"], ("start", "end"), ("i_start", "i_end"), F.col("width"), "left")
    first = met.groupBy("capture", "window_index", "start", "end").agg(F.min_by("family", "interval_no").alias("family"), F.count("interval_no").alias("n"))
    return first.select("capture", "window_index", "start", "end", (F.col("n") > 0).cast("int").alias("attack"), F.coalesce("family", F.lit(default)).alias("family"))


def label_files(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """y = 1 for windows of attack captures from the attack's start on; without a start, all of them."""
    rows = windows.join(labels.select("capture", "attack_label", "attack_start", "family"), "capture", "left")
    hit = (F.col("attack_label") == 1) & (F.col("attack_start").isNull() | (F.col("start") >= F.col("attack_start")))
    return rows.withColumn("y", F.coalesce(hit, F.lit(False)).cast("int")).drop("attack_label", "attack_start")


def campaign_match(packets: DataFrame, campaigns: DataFrame, day: Column, packet: tuple[str, ...] = ("capture", "packet_no")) -> DataFrame:
    """Packets with the campaign that they belong to: by source mac, destination mac, source address, destination
    address, in this order, then in list order; the packet's day within the campaign.

    The four keys become rows of one join, by key and day (:func:`overlapping`: a device may have any number of campaigns); the best match goes back by
    ``packet``, the columns that name one: numbers start anew in each capture.
    """
    rows = packets.withColumn("day", day)
    keys = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(k).alias("kind"), F.col(c).alias("key")) for i, (k, c) in enumerate((("mac", "src_mac"), ("mac", "dst_mac"), ("ip", "src_ip"), ("ip", "dst_ip"))) if c in packets.columns])
    at = F.unix_date("day").cast("long")
    long = rows.select(*packet, at.alias("at"), (at + 1).alias("next"), F.inline(keys)).where("key is not null")
    both = F.inline(F.array(F.struct(F.lit("mac").alias("kind"), F.col("mac").alias("key")), F.struct(F.lit("ip").alias("kind"), F.col("ip").alias("key"))))
    c = campaigns.select("campaign_no", "device", F.unix_date("start").cast("long").alias("c_start"), (F.unix_date("end").cast("long") + 1).alias("c_end"), both).where("key is not null")
    met = overlapping(long, c, ["kind", "key"], ("at", "next"), ("c_start", "c_end"), F.lit(1))
    best = met.groupBy(*packet).agg(F.min(F.struct("priority", "campaign_no", "device")).alias("b")).select(*packet, F.col("b.campaign_no").alias("campaign_no"), F.col("b.priority").alias("matched_on"), F.col("b.device").alias("device"))
    return rows.join(best, list(packet), "left")


def with_inventory(hosts: DataFrame, devices: DataFrame) -> DataFrame:
    """Hosts with name and connection of their device; Unknown-<mac> and Unknown where there is none."""
    d = devices.select("mac", "name", "conn")
    return hosts.join(d, "mac", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Unknown-"), F.col("mac")))).withColumn("conn", F.coalesce("conn", F.lit("Unknown")))


def first_seen(packets: DataFrame, ip: str = "src_ip", mac: str = "src_mac", order: tuple[str, ...] = ("capture", "packet_no"), private: Callable[[Column], Column] = is_private_ipv4) -> DataFrame:
    """For each private address (by ``private``) the mac that used it first: in packet order, capture after capture by name."""
    known = packets.where(F.col(ip).isNotNull() & F.col(mac).isNotNull() & private(F.col(ip)))
    return known.groupBy(F.col(ip).alias("ip")).agg(F.min_by(F.col(mac), F.struct(*order)).alias("mac"))


def rewritten(packets: DataFrame, hosts: DataFrame, sink_ip: str, sink_mac: str, private: Callable[[Column], Column] = is_private_ipv4) -> DataFrame:
    """Packets with macs by the host map; addresses outside it, unless private (by ``private``), become the sink's."""
    out = packets
    for side in ("src", "dst"):
        h = hosts.select(F.col("ip").alias(f"{side}_ip"), F.col("mac").alias("m"))
        out = out.join(h, f"{side}_ip", "left")
        outside = F.col("m").isNull() & ~private(F.col(f"{side}_ip"))
        out = out.withColumn(f"{side}_mac_new", F.when(outside, sink_mac).otherwise(F.coalesce("m", F.col(f"{side}_mac") if f"{side}_mac" in packets.columns else F.lit(None))))
        out = out.withColumn(f"{side}_ip_new", F.when(outside, sink_ip).otherwise(F.col(f"{side}_ip"))).drop("m")
    return out


def with_scores(counts: DataFrame, scores: DataFrame) -> DataFrame:
    """Host counts with their window's score and decision; a window without decision is no attack."""
    return counts.join(scores, ["capture", "window_index"]).withColumn("is_attack", F.coalesce("is_attack", F.lit(False)))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without(all_files: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Files of the first list that aren't in the second, each once."""
    return all_files.select(key).distinct().join(others.select(key), key, "left_anti")
