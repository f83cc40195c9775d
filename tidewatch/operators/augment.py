"""Augmentation of packets, and small per-host state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.ordered import running


#: Addresses of 10.0.0.0/8, and macs of the locally administered 02:..
ADDRESSES, MACS = 1 << 24, 1 << 40


def _renamed(packets: DataFrame, columns: list[str], keys: list[str], seed: int, written_as) -> DataFrame:
    """The columns' values by a number that each has in its group of ``keys``: its place in the order of a seeded hash, so that no two share one."""
    if not columns:
        return packets
    long = packets.select(*keys, F.explode(F.array(*columns)).alias("__value")).where("__value is not null").distinct()
    placed = running(long.withColumn("__order", F.xxhash64(F.lit(seed), *keys, "__value")), keys, "__order", {"__no": (F.sum, F.lit(1))}, then=["__value"])
    names = placed.select(*[F.col(k).alias(f"__{k}") for k in keys], "__value", written_as(F.col("__no") - 1).alias("__name"))
    for c in columns:
        on = F.col(c) == F.col("__value")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        packets = packets.join(names, on, "left").withColumn(c, F.col("__name")).drop("__name", "__value", *[f"__{k}" for k in keys])
    return packets


def remapped(packets: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Addresses and macs renamed at random but alike within each group of ``keys``, and one to one: by their places in the order of a seeded hash,
    so it can be repeated. A group has 2^24 addresses at most (an error beyond) and 2^40 macs."""
    few = lambda n, most: F.when(n < most, n).otherwise(F.raise_error(F.lit(f"more than {most} addresses in a group")).cast("long"))

    def ip(n):
        n = few(n, ADDRESSES)
        return F.concat_ws(".", F.lit("10"), *[F.pmod(F.shiftright(n, 8 * i), F.lit(256)).cast("string") for i in (2, 1, 0)])

    def mac(n):
        return F.concat(F.lit("02"), F.regexp_replace(F.lpad(F.lower(F.hex(few(n, MACS))), 10, "0"), "(..)", ":$1"))

    packets = _renamed(packets, [c for c in ("src_ip", "dst_ip") if c in packets.columns], keys, seed, ip)
    return _renamed(packets, [c for c in ("src_mac", "dst_mac") if c in packets.columns], keys, seed, mac)


def time_warped(packets: DataFrame, factor: float, keys: list[str] = ("capture",)) -> DataFrame:
    """Times stretched around each group's first: us' = u0 + (us - u0) * factor."""
    first = packets.groupBy(*keys).agg(F.min("us").alias("u0"))
    return packets.join(first, list(keys)).withColumn("us", (F.col("u0") + F.floor((F.col("us") - F.col("u0")) * factor)).cast("long")).drop("u0")


def overlaid(attack: DataFrame, benign: DataFrame, share: float = 0.2, seed: int = 0, key: tuple[str, ...] = ("capture", "packet_no")) -> DataFrame:
    """The attack's packets and a sample of benign ones on top, a fifth at most: those whose ``key`` has a low seeded hash, whatever the partitioning; a sampling operator."""
    low = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 20)) < int(min(share, 0.2) * (1 << 20))
    return attack.unionByName(benign.where(low), allowMissingColumns=True)


def family_index(df: DataFrame, families: list[str], default: int = 0) -> DataFrame:
    known = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, i)])
    return df.withColumn("family_index", F.coalesce(F.try_element_at(known, F.coalesce("family", F.lit(""))), F.lit(default)).cast("long"))


def learned_ports(packets: DataFrame) -> DataFrame:
    """The port that each mac was last seen on."""
    return packets.groupBy("src_mac").agg(F.max_by("in_port", F.struct("us", "packet_no")).alias("in_port"))


def meters(hits: DataFrame, seconds: int) -> DataFrame:
    """Spans during which a host is metered: a hit starts one or extends it, ``seconds`` without a hit end it. ``hits``: host, us."""
    w = W.partitionBy("host").orderBy("us")
    new = F.coalesce(F.col("us") - F.lag("us").over(w) > seconds * 1_000_000, F.lit(True))
    spans = hits.withColumn("span", F.sum(new.cast("int")).over(w))
    return spans.groupBy("host", "span").agg(F.min("us").alias("from_us"), (F.max("us") + seconds * 1_000_000).alias("until_us"), F.count("*").alias("hits"))


def host_summary(counts: DataFrame, flags: DataFrame, top: int = 5) -> DataFrame:
    """Each capture's first hosts by packets in attack windows, then by all packets. ``flags``: capture, window_index, is_attack."""
    j = counts.join(flags, ["capture", "window_index"])
    g = j.groupBy("capture", "host").agg(F.sum("cnt").alias("total"), F.sum(F.when(F.col("is_attack"), F.col("cnt")).otherwise(0)).alias("attack"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("capture").orderBy(F.desc("attack"), F.desc("total"), "host"))).where(F.col("rank") <= top)
