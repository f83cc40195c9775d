"""Queries that run as streams over what is there, and read their output back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans import extra, windowed  # noqa: F401  (the batch forms' SQL)
from tidewatch.plans.registry import HOP, SQL, WIDTH, query
from tidewatch.sources.shared import scratch, written
from tidewatch.sources.tables import packets, table
from tidewatch.streaming import state as st
from tidewatch.streaming import windows as sw


def _events(spark, sf_dir):
    """events as a stream of one file; event time must be a timestamp with zone."""
    path = f"{sf_dir}/events.parque[t]"  # a pattern, since a stream reads folders or patterns
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""with e as (select epoch_us(ts) as us, event_type, value from events), b as (select (min(us) // 1800000000) * 1800000000 as lo, max(us) as hi from e),
    w as (select event_type, value, unnest([us // 1800000000, us // 1800000000 - 1]) * 1800000000 as s from e)
    select event_type, s as start_us, count(*) as n, round(sum(value), 4) as value from w, b where s >= lo and s + 3600000000 <= hi group by all""")
def stream_windows(spark, sf_dir):
    """Closed windows of a sliding count; those that begin before the aligned first one are left out."""
    first = table(spark, sf_dir, "events").agg((F.floor(F.unix_micros(F.min("ts").cast("timestamp")) / 1_800_000_000) * 1_800_000_000).alias("lo"))
    got = sw.drained(sw.sliding_counts(_events(spark, sf_dir), "1 hour", "30 minutes", ["event_type"]), "windows")
    rows = got.withColumn("start_us", F.unix_micros("start")).join(F.broadcast(first), F.col("start_us") >= F.col("lo"))
    return rows.select("event_type", "start_us", "n", F.round("value", 4).alias("value"))


def _buckets(keys: int) -> int:
    """Buckets that about 256 keys share."""
    return keys // 256 + 1


@query("""with l as (select user_id, list(struct_pack(flag := event_type in ('error', 'view'), ord := event_id, run := 0, cool := 0, hits := []::bigint[]) order by event_id) as l from events group by user_id),
    f as (select user_id, list_reduce([{'flag': false, 'ord': -1::bigint, 'run': 0, 'cool': 0, 'hits': []::bigint[]}] || l, lambda a, x: {'flag': x.flag, 'ord': x.ord, 'run': case when a.cool = 0 and x.flag and a.run + 1 < 2 then a.run + 1 else 0 end,
      'cool': case when a.cool > 0 then a.cool - 1 when x.flag and a.run + 1 >= 2 then 3 else 0 end, 'hits': case when a.cool = 0 and x.flag and a.run + 1 >= 2 then list_append(a.hits, x.ord) else a.hits end}) as s from l)
    select user_id::varchar as key, unnest(s.hits) as "order", unnest(range(1, len(s.hits) + 1)) as alarm_no from f""")
def stream_alarms(spark, sf_dir):
    """Alarms by user: two flagged events in a row, then three are passed over."""
    e = _events(spark, sf_dir).select(F.col("user_id"), F.col("event_id").alias("order"), F.col("event_type").isin("error", "view").alias("flag"))
    return sw.drained(st.alarms(e, "user_id", 2, 3, _buckets(table(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id")).first()[0])), "alarms")


#: Rows of a file of a stream that is dealt out in parts.
FILE_ROWS = 250_000


def _in_parts(rows: DataFrame, part: str, label: str, last: int) -> DataFrame:
    """Rows as a stream of files that come part after part, a trigger each.

    A trigger takes as many files as each part but the last has. None of them is empty: rows are dealt in turn, and one of the tasks that
    deal has as many as there are files, for there are fewer than ``FILE_ROWS`` tasks.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, label, "stream")
    rows = written(rows, label)
    sizes = dict(rows.groupBy(part).count().collect())
    files = max(1, min(sizes.get(i, 0) for i in range(1, last)) // FILE_ROWS)
    for i in range(1, last + 1):
        rows.where(F.col(part) == i).drop(part).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop(part).schema).option("maxFilesPerTrigger", files).parquet(path)


@query(SQL["win_late_drop"].replace("min(packet_no) as least_packet", "sum(packet_no)::bigint as packet_nos, min(u0 + window_index * %d) as w_start" % HOP))
def stream_late_drop(spark, sf_dir):
    """Late packets in a stream: counted while their window is open, of three triggers and an end marker a capture."""
    rows = packets(spark, sf_dir).withColumn("arrival_key", F.expr("(packet_no * 7919) % 1009"))
    order = "(partition by capture order by us div 600000000, arrival_key, packet_no)"
    rows = rows.select("capture", F.expr(f"row_number() over {order}").cast("long").alias("order"), "us", F.col("packet_no").cast("double").alias("value"), F.expr(f"ntile(3) over {order}").alias("part"))
    ends = rows.groupBy("capture").agg((F.max("order") + 1).alias("order")).select("capture", "order", F.lit(None).cast("long").alias("us"), F.lit(None).cast("double").alias("value"), F.lit(4).alias("part"))
    got = sw.drained(st.late_windows(_in_parts(rows.unionByName(ends), "part", "late", 4), WIDTH, HOP), "late")
    return got.select("capture", "window_index", "w_start", F.col("n").alias("pkts"), F.col("value").cast("long").alias("packet_nos"))


@query(SQL["meter_spans"])
def stream_meters(spark, sf_dir):
    """Meters that a timer ends, of two triggers by time and a marker that moves the watermark behind all of them."""
    rows = packets(spark, sf_dir).where("is_icmp = 1").select(F.col("src_mac").alias("host"), "us")
    middle, far, hosts = rows.agg(F.avg("us"), F.max("us") + 10 * 7_200_000_000, F.approx_count_distinct("host")).first()
    parts = rows.withColumn("part", F.when(F.col("us") < F.lit(middle).cast("double"), 1).otherwise(2))
    ends = spark.range(1).select(F.lit(None).cast("string").alias("host"), F.lit(far).cast("long").alias("us"), F.lit(3).alias("part"))
    stream = _in_parts(parts.unionByName(ends), "part", "meters", 3).select("host", F.timestamp_micros("us").alias("ts"))
    return sw.drained(st.meter_spans(stream, 7200, buckets=_buckets(hosts)), "meters")
