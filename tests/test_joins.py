"""Joins by time and key: against plain loops, with many intervals in a capture and packets numbered alike in several captures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewatch.operators import joins as jn


def test_intervals_first_in_file_order(spark):
    rng = random.Random(4)
    windows = [(c, i, 1000 * i, 1000 * i + 2000) for c in ("a", "b", "none") for i in range(120)]
    spans = []
    for no in range(90):
        start = rng.choice((rng.randint(-5000, 125_000), 1000 * rng.randint(0, 120)))
        end = start + rng.choice((0, 1, 7, 1000, 2000, 9000, 60_000, 10**9))
        spans.append((rng.choice("ab"), start if no % 17 else None, end if no % 13 else None, f"f{no}", no))
    got = jn.label_intervals(spark.createDataFrame(windows, "capture string, window_index long, start long, end long"), spark.createDataFrame(spans, "capture string, start long, end long, family string, interval_no int"))
    want = set()
    for c, i, a, b in windows:
        met = [(no, f) for cap, s, e, f, no in spans if cap == c and max(a, a if s is None else s) < min(b, b if e is None else e) and (s is None or e is None or s < e)]
        want.add((c, i, int(bool(met)), min(met)[1] if met else "normal"))
    rows = got.collect()
    assert len(rows) == len(windows)
    assert {(r.capture, r.window_index, r.attack, r.family) for r in rows} == want


def test_many_intervals_do_not_meet_all_windows(spark):
    """Two captures with 10,000 intervals each: rows that meet in buckets grow with the overlaps, not with the product."""
    windows = spark.range(20_000).select(F.expr("id div 10000").alias("capture"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    spans = spark.range(20_000).select(F.expr("id div 10000").alias("capture"), F.col("id").alias("i_start"), (F.col("id") + 1 + F.col("id") % 5).alias("i_end"))
    met = jn.overlapping(windows, spans, ["capture"], ("start", "end"), ("i_start", "i_end"), F.lit(1))
    want = sum(min(10_000 * (i // 10_000 + 1), i + 1 + i % 5) - i for i in range(20_000))
    assert met.count() == want
    nodes = met._jdf.queryExecution().executedPlan()
    assert "BroadcastNestedLoopJoin" not in nodes.toString() and "CartesianProduct" not in nodes.toString()


CAMPAIGNS = [(0, "m1", "10.0.0.1", "2024-01-01", "2024-01-05", "cam"), (1, "m2", "10.0.0.2", "2024-01-03", "2024-01-03", "plug"), (2, "m1", None, "2024-01-04", "2024-02-20", "cam")]


def test_campaigns_by_capture(spark):
    """Packet 0 of one capture says nothing about packet 0 of another."""
    day = dt.date(2024, 1, 3)
    packets = [
        ("a.pcap", 0, "m1", None, "x", "y", day, 0, 0),
        ("b.pcap", 0, "m9", "m2", "x", "y", day, 1, 1),
        ("c.pcap", 0, "m9", None, "x", "y", day, None, None),
        ("a.pcap", 1, "m9", "m9", "10.0.0.2", "10.0.0.1", day, 1, 2),
        ("b.pcap", 1, None, None, None, "10.0.0.1", day, 0, 3),
        ("b.pcap", 2, "m1", None, None, None, dt.date(2024, 2, 20), 2, 0),
        ("b.pcap", 3, "m1", None, None, None, dt.date(2024, 1, 5), 0, 0),
        ("b.pcap", 4, "m1", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([p[:7] for p in packets], "capture string, packet_no long, src_mac string, dst_mac string, src_ip string, dst_ip string, on_day date")
    c = spark.createDataFrame(CAMPAIGNS, "campaign_no int, mac string, ip string, start string, end string, device string").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    got = {(r.capture, r.packet_no): (r.campaign_no, r.matched_on) for r in jn.campaign_match(df, c, F.col("on_day")).collect()}
    assert got == {p[:2]: p[7:] for p in packets}


def test_first_seen_by_capture(spark):
    rows = [("b", 0, "10.0.0.1", "late"), ("a", 5, "10.0.0.1", "early"), ("a", 7, "10.0.0.1", "later"), ("a", 1, "8.8.8.8", "outside")]
    df = spark.createDataFrame(rows, "capture string, packet_no long, src_ip string, src_mac string")
    assert [(r.ip, r.mac) for r in jn.first_seen(df).collect()] == [("10.0.0.1", "early")]
