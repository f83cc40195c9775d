"""Live captures over restarts, windows that count late packets, meters with timers, alarms: streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_ranges import blocks, classic, udp
from tidewatch.operators import augment as au
from tidewatch.operators import windows as win
from tidewatch.plans import streamed
from tidewatch.sources import pcap
from tidewatch.streaming import live
from tidewatch.streaming import state as st
from tidewatch.streaming import windows as sw


def run(stream, out, check):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


@pytest.mark.parametrize("most", [1 << 20, 4000])
def test_live_captures_over_restarts(spark, tmp_path, most):
    rng = random.Random(most)
    frames = [udp(i, rng.randbytes(rng.randint(0, 200))) for i in range(60)]
    # the last of them is whole only after the third run, or never
    data = {"a.pcap": classic(frames) + b"\x01\x02\x03", "b.pcapng": blocks(frames[:20]) + blocks(frames[20:], ">", ((1, 3),))[:-7], "late.pcap": classic(frames[:5], ">", True)}
    (tmp_path / "in").mkdir()
    out, check = tmp_path / "out", tmp_path / "check"
    for share in (0.001, 0.3, 0.31, 1.0) if most > 10_000 else (0.4, 1.0):
        for name, raw in data.items():
            if name != "late.pcap" or share > 0.5:
                (tmp_path / "in" / name).write_bytes(raw[: int(len(raw) * share)])
        for _ in range(1 if most > 10_000 else 3):  # a small trigger leaves the rest to the next ones
            run(live.live(spark, f"{tmp_path}/in", bytes_per_trigger=most), out, check)
    columns = ("capture", "packet_no", "us", "src_port", "payload")
    got = sorted(tuple(r[c] for c in columns) for r in spark.read.parquet(str(out)).collect())
    want = sorted(tuple(r[c] for c in columns) for r in pcap.read(spark, f"{tmp_path}/in").collect())
    assert got == want and len(want) == 60 + 59 + 5


def batches(spark, rows, schema, path, n):
    """Rows as a stream of ``n`` files that come one at a time."""
    step = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * step : i * step + step], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_late_packets_count_while_their_window_is_open(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in ("a", "b"):
        at = 10_000
        for i in range(400):
            at += rng.choice((0, 3, 40, 900)) if i != 200 else 20_000
            rows.append((c, i, at - rng.choice((0, 0, 0, 500, 1200, 5000)), float(i)))
    rows.sort(key=lambda r: r[1])
    schema = "capture string, order long, us long, value double"
    packets = spark.createDataFrame(rows, schema)
    ends = [(c, 10_000, None, None) for c in ("a", "b")]
    stream = batches(spark, rows + ends, schema, tmp_path / "in", 5)
    got = sw.drained(st.late_windows(stream, 1000, 300), "late").collect()
    want = win.assign_arrival(packets, 1000, 300, "order").groupBy("capture", "window_index", "w_start").agg(F.count("*").alias("n"), F.sum("value").alias("value")).collect()
    key = lambda r: (r.capture, r.window_index, r.w_start, r.n, r.value)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == len(want)
    assert sum(r.n for r in want) < sum(r["n"] for r in win.assign(packets.withColumnRenamed("order", "packet_no"), 1000, 300, "first").groupBy("capture", "window_index").agg(F.count("*").alias("n")).collect())  # some were too late


def test_meters_end_by_timer(spark, tmp_path):
    rng = random.Random(4)
    rows, at = [], 1_000_000_000
    for _ in range(120):
        at += rng.choice((0, 1_000_000, 5_000_000, 5_000_001, 30_000_000))
        rows.append((rng.choice("xyz"), at))
    batch = spark.createDataFrame(rows, "host string, us long")
    end = [(None, at + 10**9)]
    stream = batches(spark, rows + end, "host string, us long", tmp_path / "in", 4).select("host", F.timestamp_micros("us").alias("ts"))
    got = sw.drained(st.meter_spans(stream, 5), "meters").collect()
    key = lambda r: (r.host, r.span, r.from_us, r.until_us, r.hits)
    assert sorted(map(key, got)) == sorted(map(key, au.meters(batch, 5).collect()))


def test_meters_share_state_by_buckets(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted(((f"h{rng.randrange(300)}", rng.randrange(100_000_000)) for _ in range(2000)), key=lambda r: r[1])
    end = [(None, 10**9)]
    stream = batches(spark, rows + end, "host string, us long", tmp_path / "in", 3).select("host", F.timestamp_micros("us").alias("ts"))
    out, check = tmp_path / "out", tmp_path / "check"
    q = st.meter_spans(stream, 5, buckets=7).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    # a row of state for each bucket, not for each of 300 hosts
    assert {p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress} == {7}
    key = lambda r: (r.host, r.span, r.from_us, r.until_us, r.hits)
    want = au.meters(spark.createDataFrame(rows, "host string, us long"), 5).collect()
    assert sorted(map(key, spark.read.parquet(str(out)).collect())) == sorted(map(key, want)) and len(want) > 600


def test_meters_take_late_hits(spark, tmp_path):
    # the third of x lies between its first two spans, the fourth joins the first; y waits for the watermark
    at = [("x", 1000), ("x", 1020), ("x", 1010), ("x", 1004), ("y", 990), ("y", 1050), (None, 2000)]
    rows = [(h, s * 1_000_000) for h, s in at]
    stream = batches(spark, rows, "host string, us long", tmp_path / "in", 4).select("host", F.timestamp_micros("us").alias("ts"))
    got = sw.drained(st.meter_spans(stream, 5, "60 seconds"), "meters").collect()
    key = lambda r: (r.host, r.span, r.from_us, r.until_us, r.hits)
    want = au.meters(spark.createDataFrame(rows[:-1], "host string, us long"), 5).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) == 5


def test_parts_of_several_files_keep_their_triggers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streamed, "FILE_ROWS", 50)
    rows = spark.range(323).select("id", F.expr("case when id < 200 then 1 when id < 320 then 2 else 3 end").alias("part"))
    stream = streamed._in_parts(rows, "part", "parts", 3).select("id", F.input_file_name().alias("file"))
    q = stream.writeStream.format("memory").queryName("parts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and [p["numInputRows"] for p in q.recentProgress] == [200, 120, 3]
    # two files for each of the first parts, where one task wrote each of them before
    assert spark.table("parts").groupBy("file").count().count() >= 5 and spark.table("parts").count() == 323


def test_alarms_by_runs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.random() < 0.7) for i in range(300)]
    want = []
    for k in "ab":
        run_, cool, n = 0, 0, 0
        for key, i, flag in rows:
            if key == k:
                if cool:
                    cool, run_ = cool - 1, 0
                elif flag:
                    run_ += 1
                    if run_ >= 3:
                        n, run_, cool = n + 1, 0, 4
                        want.append((k, i, n))
                else:
                    run_ = 0
    stream = batches(spark, rows, "u string, order long, flag boolean", tmp_path / "in", 3)
    got = sw.drained(st.alarms(stream, "u", 3, 4), "alarms").collect()
    assert sorted((r.key, r.order, r.alarm_no) for r in got) == sorted(want)


def test_alarms_share_state_by_buckets(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([None, *map(str, range(60))]), i, rng.random() < 0.8) for i in range(1500)]
    want = []
    for k in {r[0] for r in rows}:
        run_, cool, n = 0, 0, 0
        for _, i, flag in (r for r in rows if r[0] == k):
            if cool:
                cool, run_ = cool - 1, 0
                continue
            run_ = run_ + 1 if flag else 0
            if run_ == 2:
                n, run_, cool = n + 1, 0, 3
                want.append((k or "none", i, n))
    stream = batches(spark, rows, "u string, order long, flag boolean", tmp_path / "in", 3)
    q = st.alarms(stream, "u", 2, 3, 5).writeStream.format("memory").queryName("alarms").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and {p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress} == {5}
    assert sorted((r.key or "none", r.order, r.alarm_no) for r in spark.table("alarms").collect()) == sorted(want)
