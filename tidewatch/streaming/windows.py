"""Structured Streaming forms: sliding windows behind a watermark, keyed decisions, capture-timed replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.shared import scratch


def sliding_counts(events: DataFrame, width: str, hop: str, keys: list[str], lateness: str = "0 seconds") -> DataFrame:
    """Counts and sums of sliding windows, each emitted once it has ended. ``events``: ts (timestamp), value and the keys."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width, hop), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "value")


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into files of the shared folder, and reads them back. What is still open at the
    end (windows beyond the watermark) isn't emitted; a batch pass covers it."""
    spark = stream.sparkSession
    out = scratch(spark, label, "stream")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{label}-state", "stream")).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out)


def replayed(packets: DataFrame, speed: float = 1.0) -> DataFrame:
    """When each packet is due, in seconds from the capture's first: for a sink that paces itself."""
    first = packets.groupBy("capture").agg(F.min("us").alias("u0"))
    return packets.join(first, "capture").withColumn("due", (F.col("us") - F.col("u0")) / F.lit(1e6 * speed)).drop("u0")


def actions(alarms: DataFrame, mode: str = "meter", seconds: int = 15) -> DataFrame:
    """The enforcement table of a batch of alarms: one row a host with the time at which the action ends; a new hit extends it."""
    return alarms.groupBy("host").agg(F.max("at").alias("at")).select("host", F.lit(mode).alias("mode"), (F.col("at") + F.expr(f"interval {int(seconds)} seconds")).alias("expires"))
