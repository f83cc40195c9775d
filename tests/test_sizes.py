"""Registered queries on few rows with the keys and sums that only large tables have."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def events(spark, folder, rows: int, users: str, ts: str, kind: str = "'click'"):
    made = spark.range(rows).select(F.col("id").alias("event_id"), F.expr(ts).cast("timestamp_ntz").alias("ts"), F.expr(users).cast("long").alias("user_id"), F.expr(kind).alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 3}').alias("props"))
    made.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(name, folder):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    c.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    rel = c.sql(entry.oracle_sql()[name])
    return rel.columns, rel.fetchall()


def test_roundtrip_of_times_beyond_64_bits(spark, tmp_path):
    """A day whose times add up to more than 64 bits hold, of users numbered past an octet."""
    folder = events(spark, tmp_path, 6000, "65000 + id % 1000", "timestamp_micros(1704067200000000 + id)")
    (row,) = entry.queries()["capture_roundtrip"](spark, folder).collect()
    whole = sum(1_704_067_200_000_000 + i for i in range(6000))
    assert whole > 1 << 63 and row.times == (whole + (1 << 63)) % (1 << 64) - (1 << 63)
    assert (row.packets, row.bytes, row.syn, row.sources, row.first_target) == (6000, 900_000, 6000, 1000, "10.1.0.3")


@pytest.mark.parametrize("name", ["first_seen_map", "address_rewrite", "private_addresses"])
def test_users_numbered_past_an_octet(spark, tmp_path, name):
    """Users of 65,536 and more have addresses like 10.0.300.5."""
    folder = events(spark, tmp_path, 60, "65500 + (id % 20) * 7000", "timestamp_micros(1704067200000000 + id * 7200000000)")
    columns, want = by_sql(name, folder)
    got = [tuple(r[c] for c in columns) for r in entry.queries()[name](spark, folder).collect()]
    assert sorted(got) == sorted(want) and len(got) >= 20


def test_carried_addresses(spark):
    from tidewatch.functions import net

    rows = {"10.0.300.5": "10.1.44.5", "10.0.0.1": "10.0.0.1", "1.2.3": "1.2.3", "x": "x", "255.256.0.0": "255.256.0.0", "8.8.8.256": "8.8.9.0", None: None}
    df = spark.createDataFrame([(a,) for a in rows], "a string")
    got = {r.a: (r.c, r.strict, r.private) for r in df.select("a", net.carried(F.col("a")).alias("c"), net.is_private_ipv4(F.col("a")).alias("strict"), net.is_private_carried(F.col("a")).alias("private")).collect()}
    assert {a: c for a, (c, _, _) in got.items()} == rows
    assert got["10.0.300.5"][1:] == (False, True) and got["8.8.8.256"][1:] == got[None][1:] == (False, False) and got["10.0.0.1"][1:] == (True, True)
