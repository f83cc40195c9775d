"""Captures as a sink: packets become frames (by expressions) and are written as PCAP files, one a task, that appear when the job has ended.

``write(framed(packets), folder)``: what augmentation has renamed or moved in time can be read again by anything that reads captures.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidewatch.functions.net import ipv4_number
from tidewatch.sources.shards import _store

HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1)


def _hex(number, digits: int) -> Column:
    """A whole number (null: 0) as so many hex digits."""
    n = number if isinstance(number, Column) else F.lit(number)
    return F.lpad(F.hex(F.coalesce(n, F.lit(0)).cast("long")), digits, "0")


def framed(packets: DataFrame) -> DataFrame:
    """Adds frame (bytes): Ethernet and IPv4 with a TCP, UDP or ICMP header, from src_ip, dst_ip, src_port, dst_port, ttl and the flags; without payload.

    Missing columns, addresses that aren't IPv4 and macs that aren't macs are zeros.
    """
    has = lambda name: F.col(name) if name in packets.columns else F.lit(None)
    mac = lambda name: F.when(has(name).cast("string").rlike("^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"), F.regexp_replace(has(name).cast("string"), ":", "")).otherwise("0" * 12)
    ip = lambda name: _hex(ipv4_number(has(name).cast("string")), 8)
    bit = lambda name, value: F.coalesce(has(name).cast("int"), F.lit(0)) * value
    flags = bit("tcp_fin", 1) + bit("tcp_syn", 2) + bit("tcp_rst", 4) + F.greatest(bit("tcp_ack", 16), bit("tcp_synack", 16))
    ports = F.concat(_hex(has("src_port"), 4), _hex(has("dst_port"), 4))
    tcp, udp, icmp = (F.coalesce(has(f"is_{p}") == 1, F.lit(False)) for p in ("tcp", "udp", "icmp"))
    inner = F.when(tcp, F.concat(ports, F.lit("0" * 16 + "50"), _hex(flags, 2), F.lit("2000" + "0" * 8))).when(udp, F.concat(ports, F.lit("00080000"))).when(icmp, F.lit("0800" + "0" * 12)).otherwise("")
    proto = F.when(tcp, 6).when(udp, 17).when(icmp, 1).otherwise(255)
    size = F.lit(20) + (F.length(inner) / 2).cast("int")
    text = F.concat(mac("dst_mac"), mac("src_mac"), F.lit("08004500"), _hex(size, 4), F.lit("0" * 8), _hex(has("ttl"), 2), _hex(proto, 2), F.lit("0000"), ip("src_ip"), ip("dst_ip"), inner)
    return packets.withColumn("frame", F.unhex(text))


@dataclass
class Written(WriterCommitMessage):
    files: list


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.run = options["path"], uuid.uuid4().hex[:12]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, out = f"part-{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}.pcap", None
        for batch in iterator:
            if out is None:
                out = store.open_output_stream(posixpath.join(root, f".{name}"))
                out.write(HEADER)
            us, frames, sizes = (batch.column(i).to_pylist() for i in range(3))
            out.write(b"".join(struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(f), n) + f for t, f, n in zip(us, frames, sizes, strict=True)))
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.move(posixpath.join(root, f".{name}"), posixpath.join(root, name))

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.delete_file(posixpath.join(root, f".{name}"))


class CaptureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_files"

    def schema(self) -> str:
        raise ValueError("captures are read by tidewatch.sources.pcap.read")

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options)


def write(packets: DataFrame, path: str, wire_len: Column | None = None) -> None:
    """``packets`` (us, frame; rows without either are left out) as captures in a folder, each task's in order of time. ``wire_len``: the length on the wire (the frame's own)."""
    packets.sparkSession.dataSource.register(CaptureFiles)
    size = F.greatest(F.length("frame"), wire_len if wire_len is not None else F.lit(0)).cast("long")
    rows = packets.where("us is not null and frame is not null").select(F.col("us").cast("long").alias("us"), "frame", size.alias("size")).sortWithinPartitions("us")
    rows.write.format("capture_files").mode("append").save(path)
