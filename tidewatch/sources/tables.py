"""Views over plain tables: a stream of events read as packets, intervals and labels from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP_PORTS = (19, 53, 7, 80, 44)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(events: DataFrame) -> DataFrame:
    """Events as packets; each day is a capture. Times are whole microseconds.

    Expressions only, so that column pruning and filters go through to the scan.
    """
    e = events.select(
        F.col("event_id").alias("packet_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.date_format("ts", "yyyy-MM-dd").alias("capture"),
        F.col("user_id").alias("u"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("len"),
    )
    kind = F.col("event_type")
    tcp, udp = kind.isin("click", "signup"), kind.isin("view", "purchase")
    method = F.when((kind == "view") & (F.col("k") < 50), "M-SEARCH").when((kind == "purchase") & (F.col("k") < 50), "200-OK")
    search, numbered = method == "M-SEARCH", lambda name, of: F.concat(F.lit(name), F.expr(of).cast("string"))
    return e.select(
        "packet_no",
        "us",
        "capture",
        "len",
        F.concat(F.lit("mac-"), F.col("u").cast("string")).alias("src_mac"),
        F.concat(F.lit("10.0."), F.expr("u div 256").cast("string"), F.lit("."), F.expr("u % 256").cast("string")).alias("src_ip"),
        F.concat(F.lit("10.1.0."), F.expr("k % 16").cast("string")).alias("dst_ip"),
        F.expr("cast(packet_no % 50 as int)").alias("src_port"),
        F.col("k").alias("dst_port"),
        tcp.cast("int").alias("is_tcp"),
        udp.cast("int").alias("is_udp"),
        (kind == "error").cast("int").alias("is_icmp"),
        tcp.cast("int").alias("tcp_syn"),
        (kind == "signup").cast("int").alias("tcp_synack"),
        (tcp & F.expr("event_type = 'signup' or packet_no % 3 = 0")).cast("int").alias("tcp_ack"),
        (tcp & F.expr("packet_no % 11 = 0")).cast("int").alias("tcp_rst"),
        (tcp & F.expr("packet_no % 7 = 1")).cast("int").alias("tcp_fin"),
        method.alias("ssdp_method"),
        F.when(method.isNotNull(), numbered("st-", "u % 5")).alias("ssdp_st"),
        F.when(search, numbered("man-", "k % 3")).alias("ssdp_man"),
        F.when(search & F.expr("packet_no % 2 = 0"), numbered("agent-", "u % 4")).alias("ssdp_user_agent"),
        F.expr("cast(u % 7 + 58 as int)").alias("ttl"),
        F.expr("cast(packet_no % 5 <> 0 as int)").alias("is_arp"),
        F.when(kind == "error", 1).otherwise(2).alias("arp_opcode"),
        F.concat(F.lit("a"), F.expr("u % 20").cast("string")).alias("arp_sender_mac"),
        F.concat(F.lit("s"), F.expr("k % 25").cast("string")).alias("arp_sender_ip"),
        F.concat(F.lit("t"), F.expr("packet_no % 7").cast("string")).alias("arp_target_ip"),
        F.when(F.expr("packet_no % 3 = 0"), "00:00:00:00:00:00").otherwise(F.concat(F.lit("b"), F.expr("u % 11").cast("string"))).alias("arp_target_mac"),
        F.expr("k % 25 = packet_no % 7").cast("int").alias("arp_is_gratuitous"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def seconds_of(text):
    """A time written as seconds or as ISO 8601, in seconds; null if neither. A time without zone is UTC."""
    iso = F.unix_micros(F.try_to_timestamp(text)) / F.lit(1_000_000)
    return F.coalesce(text.try_cast("double"), iso)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header pcap,start,end[,family]; interval_no is the order in the file."""
    rows = spark.read.csv(path, header=True).withColumn("interval_no", F.monotonically_increasing_id())
    family = F.col("family") if "family" in rows.columns else F.lit("attack")
    return rows.select(F.col("pcap").alias("capture"), seconds_of(F.col("start")).alias("start"), seconds_of(F.col("end")).alias("end"), F.coalesce(family, F.lit("attack")).alias("family"), "interval_no")


def read_file_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV file,attack_label,attack_start_iso,family, joined by base name; empty fields are null."""
    rows = spark.read.csv(path, header=True, nullValue="")
    return rows.where("file is not null").select(
        F.regexp_extract("file", r"([^/\\]+)$", 1).alias("capture"),
        F.coalesce(F.col("attack_label").try_cast("int"), F.lit(0)).alias("attack_label"),
        seconds_of(F.col("attack_start_iso")).alias("attack_start"),
        "family",
    )
