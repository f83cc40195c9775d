"""Sinks: shards with a manifest over failures and appends, saved fits, reports as files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import prep
from tidewatch.sources import artifacts, reports, shards, tables


def rows(spark, start, n, parts=4):
    return spark.range(start, start + n, 1, parts).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("y"), F.array_repeat(F.rand(1), 40).alias("seq"))


def test_shards_rotate_and_append(spark, tmp_path):
    path = f"{tmp_path}/shards"
    shards.write(rows(spark, 0, 40_000), path, shard_bytes=1 << 20)
    first = shards.manifest_of(path)
    assert first["columns"] == ["id", "y", "seq"] and sum(f["rows"] for f in first["files"]) == 40_000 and sum(f["positives"] for f in first["files"]) == 8000
    assert len(first["files"]) == 8 and max(f["bytes"] for f in first["files"]) < 4 << 20  # a batch over the limit at most
    shards.write(rows(spark, 40_000, 100, 2), path)
    assert shards.read(spark, path).agg(F.count("*"), F.countDistinct("id")).first() == (40_100, 40_100)
    parts = reports.split_shards(shards.stats(path))
    assert set(parts.values()) == {"train", "val", "test"} and len(parts) == len(shards.manifest_of(path)["files"])
    shards.write(rows(spark, 0, 10, 1), path, mode="overwrite")
    assert shards.read(spark, path).count() == 10 and len([f for f in os.listdir(path) if f.startswith("shard-")]) == 1


def test_a_failed_task_leaves_no_row(spark, tmp_path):
    path = f"{tmp_path}/shards"
    shards.write(rows(spark, 0, 50, 2), path)

    @F.udf("int")
    def breaks(i):
        if i == 139:
            raise RuntimeError("lost")
        return i

    with pytest.raises(Exception, match="lost"):
        shards.write(rows(spark, 100, 40, 4).withColumn("y", breaks(F.col("id").cast("int"))), path)
    assert shards.read(spark, path).agg(F.count("*"), F.max("id")).first() == (50, 49)
    with pytest.raises(ValueError):
        shards.read(spark, f"{tmp_path}/nothing")


def test_saved_fits(spark, tmp_path):
    scaler = prep.fit_scaler(rows(spark, 0, 100), ["id", "y"], "standard")
    net = {"head0": np.arange(6.0).reshape(2, 3), "bias": np.zeros(0)}
    artifacts.save(spark, f"{tmp_path}/fit", scaler=scaler, clips={"id": (0.5, 9.0)}, threshold=0.25, weights=net, layers=[(np.eye(2), np.ones(2))], note="x\n\"y\"")
    got = artifacts.load(spark, f"{tmp_path}/fit")
    assert got["scaler"] == scaler and got["clips"] == {"id": (0.5, 9.0)} and got["threshold"] == 0.25 and got["note"] == 'x\n"y"'
    assert all(np.array_equal(got["weights"][k], net[k]) for k in net) and np.array_equal(got["layers"][0][0], np.eye(2)) and isinstance(got["layers"][0], tuple)
    before = scaler.apply(rows(spark, 0, 20)).select("id", "y").collect()
    assert got["scaler"].apply(rows(spark, 0, 20)).select("id", "y").collect() == before
    with pytest.raises(TypeError):
        artifacts.save(spark, f"{tmp_path}/bad", thing=object())


def test_feature_folders(spark, tmp_path):
    df = spark.createDataFrame([("a.pcap", i, float(i)) for i in range(10)] + [("b.pcap", 0, 1.5)], "capture string, window_index long, x double")
    reports.write_features(df, f"{tmp_path}/f", rows_per_file=4)
    assert sorted(x for x in os.listdir(f"{tmp_path}/f") if x.startswith("capture=")) == ["capture=a.pcap", "capture=b.pcap"]
    assert spark.read.parquet(f"{tmp_path}/f/capture=a.pcap").count() == 10
    stats = {os.path.basename(os.path.dirname(r.file)): r.rows for r in reports.shard_stats(spark.read.parquet(f"{tmp_path}/f"), "window_index").collect()}
    assert set(stats) == {"capture=a.pcap", "capture=b.pcap"}


def test_prepared_and_clips(spark):
    df = spark.createDataFrame([(float(i), float("nan") if i == 7 else float(-i)) for i in range(1000)], "a double, b double")
    clips = prep.fit_clip(df.select("a"), ["a"], 0.01, 0.99)
    assert clips["a"] == pytest.approx((9.99, 989.01))
    scaler = prep.Scaler({"a": 1.0, "b": 0.0}, {"a": 2.0, "b": 1.0})
    got = prep.prepared(df, ["a", "b"], ["b"], clips, scaler).collect()
    assert got[0].a == pytest.approx((9.99 - 1) / 2) and got[-1].a == pytest.approx((989.01 - 1) / 2) and {r.b for r in got} == {0.0}


def test_reports(spark, tmp_path):
    actors = spark.createDataFrame([("a.pcap", "m1", 2.0, 0.9), ("a.pcap", "m2", 3.0, 0.5), ("b.pcap", "m3", 1.0, 0.1)], "capture string, mac string, score double, mean_prob double")
    reports.write_csv(reports.ranked(actors, "score", ["mac"]), f"{tmp_path}/macs")
    back = spark.read.csv(f"{tmp_path}/macs", header=True)
    assert back.columns == ["mac", "score", "mean_prob", "rank", "capture"]
    assert [(r.mac, r["rank"]) for r in back.where("capture = 'a.pcap'").orderBy("rank").collect()] == [("m2", "1"), ("m1", "2")]
    w = spark.createDataFrame([("a", 0, 0.5, True), ("a", 1, 0.2, False)], "capture string, window_index long, score double, kept boolean")
    assert [tuple(r) for r in reports.detail_lines(w, "score", 0.4, F.col("kept")).orderBy("window_index").collect()] == [("a", 0, "0.500000", "0.400000", True, True), ("a", 1, "0.200000", "0.400000", False, False)]
    spans = spark.createDataFrame([("a", 3, 5, 3, 0.75)], "capture string, first_window long, last_window long, length long, max_score double")
    assert [tuple(r) for r in reports.interval_lines(spans, 1_000_000, 500_000).collect()] == [("a", "1.500000", "3.500000", 3, "0.750000")]
    assert [r.line for r in reports.summary_lines(spark.createDataFrame([("a", "attack", 3, 0.5)], "capture string, decision string, attack_windows int, max_prob double")).collect()] == ["a: attack, 3 windows, max 0.500000"]
    assert reports.metrics_markdown(spark.createDataFrame([(0.5, 3)], "f1 double, n int")) == "| metric | value |\n| --- | --- |\n| f1 | 0.500000 |\n| n | 3 |\n"


def test_label_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text("pcap,start,end,family\na.pcap,1970-01-01T00:00:05Z,10.5,syn\na.pcap,1,2,\n")
    got = [tuple(r) for r in tables.read_intervals(spark, f"{tmp_path}/i.csv").orderBy("interval_no").collect()]
    assert [r[:4] for r in got] == [("a.pcap", 5.0, 10.5, "syn"), ("a.pcap", 1.0, 2.0, "attack")]


def test_captures_written_and_read(spark, tmp_path):
    """Frames of all protocols come back; a failed job leaves no capture that a pattern would find."""
    from tidewatch.sources import capture_files, pcap

    rows = [(5, "02:00:00:00:00:0a", "10.1.2.3", "10.9.8.7", 1, 0, 0, 1234, 80, 1, 1, 64), (3, "nomac", "10.1.2.3", None, 0, 1, 0, 5, 1900, None, None, 3), (9, None, "x", "8.8.8.8", 0, 0, 1, 7, 7, None, None, None), (None, None, "10.0.0.1", None, 0, 1, 0, 1, 1, None, None, 1)]
    df = spark.createDataFrame(rows, "us long, src_mac string, src_ip string, dst_ip string, is_tcp int, is_udp int, is_icmp int, src_port int, dst_port int, tcp_syn int, tcp_synack int, ttl int").coalesce(1)
    capture_files.write(capture_files.framed(df), f"{tmp_path}/c")
    got = [(r.us, r.src_mac, r.src_ip, r.dst_ip, r.is_tcp, r.is_udp, r.is_icmp, r.src_port, r.dst_port, r.tcp_flags, r.ttl) for r in pcap.read(spark, f"{tmp_path}/c/*.pcap").orderBy("packet_no").collect()]
    zero = "00:00:00:00:00:00"
    assert got == [(3, zero, "10.1.2.3", "0.0.0.0", 0, 1, 0, 5, 1900, None, 3), (5, "02:00:00:00:00:0a", "10.1.2.3", "10.9.8.7", 1, 0, 0, 1234, 80, 18, 64), (9, zero, "0.0.0.0", "8.8.8.8", 0, 0, 1, None, None, None, 0)]

    @F.udf("long")
    def breaks(i):
        if i == 9:
            raise RuntimeError("lost")
        return i

    with pytest.raises(Exception, match="lost"):
        capture_files.write(capture_files.framed(df.where("us is not null")).withColumn("us", breaks("us")).repartition(3), f"{tmp_path}/d")
    assert not [f for f in (os.listdir(f"{tmp_path}/d") if os.path.isdir(f"{tmp_path}/d") else []) if f.endswith(".pcap") and not f.startswith(".")]


def test_replay_and_actions(spark):
    from tidewatch.streaming import windows as sw

    packets = spark.createDataFrame([("a", 1_000_000), ("a", 3_500_000), ("b", 7)], "capture string, us long")
    assert sorted((r.capture, r.us, r.due) for r in sw.replayed(packets, 2.0).collect()) == [("a", 1_000_000, 0.0), ("a", 3_500_000, 1.25), ("b", 7, 0.0)]
    hits = spark.createDataFrame([("h", 10), ("h", 40), ("g", 5)], "host string, s long").select("host", F.timestamp_seconds("s").alias("at"))
    got = {r.host: (r["mode"], int(r.expires.timestamp())) for r in sw.actions(hits, "drop", 15).collect()}
    assert {h: (m, t % 1000) for h, (m, t) in got.items()} == {"h": ("drop", 55), "g": ("drop", 20)}
