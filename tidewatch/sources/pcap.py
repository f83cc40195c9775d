"""Packet captures as DataFrames: PCAP and PCAPNG files of any size, read by byte range and decoded in bounded batches.

A file of more than ``range_bytes`` is read twice: a first pass goes from header to header in all ranges at once and finds where each range's
frames begin and how many there are; after a check of all seams the second decodes them. Smaller files are read once. Tasks read their
range by themselves; where they can't (a store that only Spark reads), files come whole through Spark's binary reader.

``packet_no`` counts a file's frames from 0, those that can't be decoded included; ``packet_limit`` is per file. What is
lost - bytes without a header, frames without a meaning - is counted by :func:`damage`.
"""

from __future__ import annotations

import struct
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import net
from tidewatch.sources import ranges as rg
from tidewatch.sources.shared import written

SCHEMA = (
    "capture string, packet_no long, us long, frame_len int, ip_len int, src_mac string, dst_mac string, src_ip string, dst_ip string, ttl int, src_port int, dst_port int, "
    "is_tcp int, is_udp int, is_icmp int, tcp_flags int, payload binary, is_arp int, arp_opcode int, arp_sender_mac string, arp_sender_ip string, arp_target_mac string, arp_target_ip string"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
BATCH, SHOWN, RANGE, TASK = 5000, 2048, 64 << 20, 4 << 20


def _mac(b: bytes) -> str:
    return b.hex(":")


def _ip4(b: bytes) -> str:
    return ".".join(map(str, b))


def decoded(frame: bytes) -> dict:
    """Fields of an Ethernet frame; what a layer lacks is missing."""
    out = {"dst_mac": _mac(frame[0:6]), "src_mac": _mac(frame[6:12]), "is_tcp": 0, "is_udp": 0, "is_icmp": 0, "is_arp": 0}
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    while kind in (0x8100, 0x88A8):
        kind, at = struct.unpack_from(">H", frame, at + 2)[0], at + 4
    if kind == 0x0806:
        op = struct.unpack_from(">H", frame, at + 6)[0]
        out |= {"is_arp": 1, "arp_opcode": op, "arp_sender_mac": _mac(frame[at + 8 : at + 14]), "arp_sender_ip": _ip4(frame[at + 14 : at + 18]), "arp_target_mac": _mac(frame[at + 18 : at + 24]), "arp_target_ip": _ip4(frame[at + 24 : at + 28])}
        return out
    if kind == 0x0800:
        proto, end = frame[at + 9], at + struct.unpack_from(">H", frame, at + 2)[0]
        out |= {"ip_len": struct.unpack_from(">H", frame, at + 2)[0], "ttl": frame[at + 8], "src_ip": _ip4(frame[at + 12 : at + 16]), "dst_ip": _ip4(frame[at + 16 : at + 20])}
        fragment = struct.unpack_from(">H", frame, at + 6)[0] & 0x1FFF
        at += 4 * (frame[at] & 15)
        if fragment:
            return out
        out["is_icmp"] = int(proto == 1)
    elif kind == 0x86DD:
        import ipaddress

        proto = frame[at + 6]
        out |= {"ip_len": struct.unpack_from(">H", frame, at + 4)[0], "ttl": frame[at + 7], "src_ip": str(ipaddress.IPv6Address(frame[at + 8 : at + 24])), "dst_ip": str(ipaddress.IPv6Address(frame[at + 24 : at + 40]))}
        end = at + 40 + out["ip_len"]
        at += 40
    else:
        return out
    if proto == 6:
        out |= {"is_tcp": 1, "src_port": struct.unpack_from(">H", frame, at)[0], "dst_port": struct.unpack_from(">H", frame, at + 2)[0], "tcp_flags": frame[at + 13], "payload": frame[at + 4 * (frame[at + 12] >> 4) : end][:SHOWN]}
    elif proto == 17:
        out |= {"is_udp": 1, "src_port": struct.unpack_from(">H", frame, at)[0], "dst_port": struct.unpack_from(">H", frame, at + 2)[0], "payload": frame[at + 8 : end][:SHOWN]}
    return out


def _captures(files: DataFrame) -> DataFrame:
    """Adds the captures' names: a file's own, with its folder's where several files have the same, and its whole path where even that isn't enough."""
    own, two = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    several = lambda name: F.count("*").over(W.partitionBy(name)) > 1
    named = files.withColumns({"__own": own, "__two": two}).withColumns({"__a": several("__own"), "__b": several("__two")})
    return named.withColumn("capture", F.when(~F.col("__a"), F.col("__own")).when(~F.col("__b"), F.col("__two")).otherwise(F.col("path"))).drop("__own", "__two", "__a", "__b")


def _walked(rows: DataFrame, mode: str) -> DataFrame:
    """``rows`` (path, size, low, high, known, order) with what a walk over each range [low, high) has found: where it began and ended, whether adrift, its
    frames, bytes lost, and for blocks the byte order taken and left, whether a section began, and its interfaces."""

    def work(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                low, high, known = row["low"], row["high"], row["known"]
                part, layout = rg.read_part(row["path"], low, high, row["size"])
                if layout is None and mode == "FAILFAST":
                    raise ValueError(f"{row['path']}: neither PCAP nor PCAPNG")
                out = row | {"capture_file": layout is not None, "start": None, "stop": high, "adrift": False, "frames": 0, "lost": high - low, "taken": None, "left": None, "restarted": False, "links": []}
                if layout is not None:
                    layout = replace(layout, order=row["order"] or layout.order)
                    start = rg.first_offset(layout) if low == 0 else known
                    if start is None:
                        start = rg.resync(part, low, high, layout)
                    walk = rg.Walk(high if start is None else start, layout, adrift=start is None)
                    n = sum(1 for _ in rg.frames(part, walk, high))
                    out |= {"start": start, "stop": walk.at, "adrift": walk.adrift, "frames": n, "lost": walk.lost, "taken": layout.order, "left": walk.layout.order, "restarted": walk.restarted, "links": [{"link": a, "resolution": b} for a, b in walk.layout.links]}
                found.append(out)
            yield pa.RecordBatch.from_pylist(found, _WALKED)

    return rows.mapInArrow(work, f"{_RANGES}, capture_file boolean, start long, stop long, adrift boolean, frames long, lost long, taken string, left string, restarted boolean, links array<struct<link:int,resolution:int>>")


_RANGES = "path string, capture string, size long, range_no long, low long, high long, known long, order string"
_WALKED = pa.schema(
    [("path", pa.string()), ("capture", pa.string()), *((c, pa.int64()) for c in ("size", "range_no", "low", "high", "known")), ("order", pa.string()), ("capture_file", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("adrift", pa.bool_()), ("frames", pa.int64()), ("lost", pa.int64()),
     ("taken", pa.string()), ("left", pa.string()), ("restarted", pa.bool_()), ("links", pa.list_(pa.struct([("link", pa.int32()), ("resolution", pa.int32())])))]
)


def _spread(rows: DataFrame) -> DataFrame:
    """Ranges (rows with low and high) dealt out to tasks, each with one range or about ``TASK`` bytes of small ones (ten thousand tasks at most, and enough to use
    all cores): the rows are few and small, and what they stand for is large. A task holds one range at a time."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("high") - F.col("low")), F.lit(0))).first()
    wanted = max(-(-size // TASK), 3 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, min(n, wanted, 10_000)))


def index(files: DataFrame, range_bytes: int, mode: str = "PERMISSIVE") -> DataFrame:
    """``files`` (path, capture, size) by range: where the frames begin, how many they are, the number of the first, and the interfaces known by then.

    All ranges are walked at once, each from the first believable header. Then each is held against the furthest that the ranges before it have come: where
    it began elsewhere (or took another byte order) it is walked again from there, until all fit. The first wrong range of a file is
    right after a round, so the rounds end; guesses that are wrong at all are rare.
    """
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    rows = files.select("path", "capture", "size", low.alias("low")).withColumns({"range_no": F.expr(f"low div {range_bytes}"), "high": F.least(F.col("low") + range_bytes, "size"), "known": F.lit(None).cast("long"), "order": F.lit(None).cast("string")})
    names = [c.split()[0] for c in _RANGES.split(", ")]
    walked = written(_walked(_spread(rows.select(*names)), mode), "walked")
    whole = W.partitionBy("path").orderBy("range_no")
    past = whole.rowsBetween(W.unboundedPreceding, -1)
    while True:
        held = walked.withColumns({"__reached": F.max("stop").over(past), "__adrift": F.lag("adrift").over(whole), "__left": F.lag("left").over(whole)})
        # only behind a range that ended in search of a header a guess has nothing to be held against
        held = held.withColumn("__free", F.col("__adrift") & (F.col("__reached") <= F.col("low")))
        elsewhere = ~F.col("__free") & (F.col("start").isNull() | (F.col("start") != F.col("__reached")))
        wrong = F.col("capture_file") & (F.col("range_no") > 0) & (elsewhere | (F.col("__left") != F.col("taken")))
        held = held.withColumns({"__wrong": wrong, "known": F.when(~F.col("__free"), F.col("__reached")), "order": F.coalesce("__left", "order")})
        again = held.where("__wrong").select(*names)
        if again.isEmpty():
            break
        walked = written(held.where("not __wrong").select(*walked.columns).unionByName(_walked(_spread(again), mode)), "walked")
    section = F.sum(F.col("restarted").cast("int")).over(whole)
    known = F.flatten(F.collect_list(F.when(F.size("links") > 0, F.col("links"))).over(W.partitionBy("path", "__section").orderBy("range_no").rowsBetween(W.unboundedPreceding, 0)))
    sought = F.when(F.col("capture_file") & F.col("__free"), F.coalesce("start", "high") - F.col("low")).otherwise(0)
    out = held.withColumn("lost", F.col("lost") + sought).withColumn("__section", section).withColumn("__links", known)
    first = F.coalesce(F.sum("frames").over(past), F.lit(0))
    return out.withColumns({"links": F.lag("__links").over(whole), "first_no": first}).drop(*[c for c in out.columns if c.startswith("__")], "restarted", "left")


def _files(spark: SparkSession, path) -> DataFrame:
    listed = spark.read.format("binaryFile").load(path).where("length > 0").select("path", F.col("length").alias("size"))
    return _captures(listed)


def read(spark: SparkSession, path, packet_limit: int | None = None, mode: str = "PERMISSIVE", range_bytes: int = RANGE) -> DataFrame:
    """Decoded packets of all files that ``path`` (a pattern, folder or list) names. With mode FAILFAST a bad file fails the job."""
    return _found(spark, path, packet_limit, mode, range_bytes).where("packet_no is not null").select(*NAMES)


def damage(spark: SparkSession, path, mode: str = "PERMISSIVE", range_bytes: int = RANGE) -> DataFrame:
    """A row a file: its frames, how many of them couldn't be decoded, and the bytes that belong to no frame or block."""
    rows = _found(spark, path, None, mode, range_bytes).where("packet_no is null")
    return rows.groupBy("capture").agg(F.sum("__frames").alias("frames"), F.sum("__undecoded").alias("undecoded"), F.sum("__lost").alias("lost_bytes"))


def _found(spark: SparkSession, path, packet_limit: int | None, mode: str, range_bytes: int) -> DataFrame:
    """Packets, and for each range a row without a number that counts what was in it."""
    if range_bytes < 1:
        raise ValueError("range_bytes is positive")
    files = _files(spark, path)
    some = files.select("path").first()
    if some is not None and not rg.reachable(some.path):
        content = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
        whole = files.join(content, "path")
    else:
        whole = files.where(F.col("size") <= range_bytes).withColumn("content", F.lit(None).cast("binary"))
        whole = whole.repartition(max(1, min(files.count(), 10_000)))
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["path", "capture", "size", "low", "high", "start", "taken", "links", "first_no", "lost", "content"]
    links = "array<struct<link:int,resolution:int>>"
    parts = whole.select("path", "capture", "size", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"), none("long").alias("start"), none("string").alias("taken"), none(links).alias("links"), F.lit(0).cast("long").alias("first_no"), none("long").alias("lost"), "content")
    if some is not None and rg.reachable(some.path):
        large = files.where(F.col("size") > range_bytes)
        if not large.isEmpty():
            ranged = index(large, range_bytes, mode).withColumn("content", none("binary"))
            if packet_limit is not None:
                ranged = ranged.where(F.col("first_no") < packet_limit)
            parts = parts.unionByName(_spread(ranged.select(*columns)))

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _packets(row, packet_limit, mode)

    return parts.select(*columns).mapInArrow(work, f"{SCHEMA}, __frames long, __undecoded long, __lost long")


def _packets(row: dict, packet_limit: int | None, mode: str):
    """Batches of the packets of a range (of a whole file, if nothing is known of it), and at the end what was in it."""
    if row["content"] is not None:
        part, layout = rg.Part(row["content"], 0, row["size"]), rg.layout_of(row["content"][: rg.HEAD])
    else:
        part, layout = rg.read_part(row["path"], row["low"] if row["start"] is None else min(row["start"], row["high"]), row["high"], row["size"])
    n = undecoded = 0
    lost = row["lost"]
    if layout is None:
        if mode == "FAILFAST":
            raise ValueError(f"{row['path']}: neither PCAP nor PCAPNG")
        lost = row["high"] - row["low"]
    elif lost is None or row["start"] is not None:
        if row["taken"] is not None:
            layout = replace(layout, order=row["taken"], links=tuple((x["link"], x["resolution"]) for x in row["links"] or ()))
        walk = rg.Walk(rg.first_offset(layout) if row["start"] is None else row["start"], layout)
        rows: list[dict] = []
        for us, frame, full, link in rg.frames(part, walk, row["high"]):
            no = row["first_no"] + n
            if packet_limit is not None and no >= packet_limit:
                break
            n += 1
            try:
                rows.append({"capture": row["capture"], "packet_no": no, "us": us, "frame_len": full} | (decoded(frame) if link == 1 else {}))
            except (struct.error, IndexError, ValueError):
                undecoded += 1
                continue
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
        lost = walk.lost if lost is None else lost
    yield _batch([{"capture": row["capture"], "__frames": n, "__undecoded": undecoded, "__lost": lost}])


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_FIELDS = pa.schema([*((c.split()[0], _ARROW[c.split()[1]]) for c in SCHEMA.split(", ")), *((c, pa.int64()) for c in ("__frames", "__undecoded", "__lost"))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _FIELDS], schema=_FIELDS)


def dos_packets(raw: DataFrame) -> DataFrame:
    """The columns that the DoS features read. A packet's length is its IP length; a SYN is any packet with that flag."""
    flags = F.coalesce("tcp_flags", F.lit(0))
    fin, syn, rst, ack = (flags.bitwiseAND(bit) != 0 for bit in (1, 2, 4, 16))
    text = F.decode(F.col("payload"), "ISO-8859-1")
    candidate = (F.col("is_udp") == 1) & ((F.col("dst_port") == net.SSDP_PORT) | net.is_ssdp_address(F.col("dst_ip")))
    s = F.when(candidate, net.ssdp(text))
    return raw.select("*", F.col("ip_len").alias("len"), syn.cast("int").alias("tcp_syn"), (syn & ack).cast("int").alias("tcp_synack"), *[c.cast("int").alias(f"tcp_{n}") for n, c in (("ack", ack), ("rst", rst), ("fin", fin))], s["method"].alias("ssdp_method"), s["st"].alias("ssdp_st"), s["man"].alias("ssdp_man"), s["user_agent"].alias("ssdp_user_agent"))


def arp_packets(raw: DataFrame, broadcast_is_gratuitous: bool = True) -> DataFrame:
    """The columns that the ARP features read. A reply is gratuitous where sender and target address agree, or its target mac is
    all zeros or ones (or, without ``broadcast_is_gratuitous``, is the sender's own)."""
    reply = F.col("arp_opcode") == 2
    other = F.col("arp_target_mac").isin("00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff") if broadcast_is_gratuitous else F.col("arp_sender_mac") == F.col("arp_target_mac")
    own = (F.col("arp_sender_ip") == F.col("arp_target_ip")) | other
    return raw.select("*", F.col("frame_len").alias("len"), F.coalesce(reply & own, F.lit(False)).cast("int").alias("arp_is_gratuitous"))
