"""Captures from bytes, labels from CSV, and streams against batches."""

import struct

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import pcap, ranges, tables
from tidewatch.streaming import windows as sw

M1, M2 = bytes.fromhex("020000000001"), bytes.fromhex("020000000002")


def ip4(proto, body, src="10.0.0.1", dst="10.0.0.2", ttl=64):
    a = lambda t: bytes(map(int, t.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, ttl, proto, 0) + a(src) + a(dst) + body


def eth(kind, body):
    return M2 + M1 + struct.pack(">H", kind) + body


def udp(s, d, data):
    return struct.pack(">HHHH", s, d, 8 + len(data), 0) + data


def tcp(s, d, flags, data=b""):
    return struct.pack(">HHIIBBHHH", s, d, 0, 0, 0x50, flags, 0, 0, 0) + data


ARP = eth(0x0806, struct.pack(">HHBBH", 1, 0x0800, 6, 4, 2) + M1 + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 9]))
SEARCH = b'M-SEARCH * HTTP/1.1\r\nMAN: "ssdp:discover"\r\nST: a\r\n\r\n'
FRAMES = [eth(0x0800, ip4(17, udp(5000, 1900, SEARCH), dst="239.255.255.250")), eth(0x0800, ip4(6, tcp(1234, 80, 0x12))), ARP, eth(0x0800, ip4(1, b"\x08\x00\x00\x00")), eth(0x86DD, b"\x60\0\0\0" + struct.pack(">HBB", 8, 17, 9) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + udp(1, 2, b"")), eth(0x0800, b"\x45")]


def classic(frames, magic=0xA1B2C3D4, order="<"):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack(order + "IIII", 100 + i, 5 if magic == 0xA1B2C3D4 else 5000, len(f), len(f)) + f for i, f in enumerate(frames))


def modern(frames, resolution=9):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, resolution) + struct.pack("<HH", 0, 0))
    for i, f in enumerate(frames):
        t = (100 + i) * 10**9 + 5000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


@pytest.mark.parametrize("data", [classic(FRAMES), classic(FRAMES, order=">"), classic(FRAMES, 0xA1B23C4D), modern(FRAMES)])
def test_captures(spark, tmp_path, data):
    (tmp_path / "a.pcap").write_bytes(data)
    (tmp_path / "cut.pcap").write_bytes(data[:-10])
    (tmp_path / "junk.pcap").write_bytes(b"not a capture at all, really")
    raw = pcap.read(spark, f"{tmp_path}/*.pcap")
    rows = {r.packet_no: r for r in pcap.dos_packets(raw).where("capture = 'a.pcap'").collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]  # the broken frame is left out
    assert all(rows[i].us == (100 + i) * 1_000_000 + 5 for i in rows)
    assert (rows[0].is_udp, rows[0].dst_port, rows[0].ssdp_method, rows[0].ssdp_st, rows[0].len) == (1, 1900, "M-SEARCH", "a", 28 + len(SEARCH))
    # SYN-ACK counts as SYN as well
    assert (rows[1].is_tcp, rows[1].tcp_syn, rows[1].tcp_synack, rows[1].src_port) == (1, 1, 1, 1234)
    assert rows[3].is_icmp == 1 and (rows[4].src_ip, rows[4].is_udp, rows[4].ttl) == ("::1", 1, 9)
    arp = pcap.arp_packets(raw).where("capture = 'a.pcap' and is_arp = 1").first()
    assert (arp.arp_opcode, arp.arp_sender_mac, arp.arp_target_ip, arp.arp_is_gratuitous) == (2, "02:00:00:00:00:01", "10.0.0.9", 1)
    assert raw.where("capture = 'cut.pcap'").count() == 5 and raw.where("capture = 'junk.pcap'").count() == 0
    assert pcap.read(spark, f"{tmp_path}/a.pcap", packet_limit=2).count() == 2
    with pytest.raises(Exception, match="neither PCAP"):
        pcap.read(spark, f"{tmp_path}/junk.pcap", mode="FAILFAST").count()


def test_tick_resolutions():
    assert ranges.ticks_to_us(3_000, 9) == 3
    assert ranges.ticks_to_us(1024, 0x80 | 10) == 1_000_000
    assert ranges.ticks_to_us(512, 256) == 2_000_000


def test_label_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text("pcap,start,end,family\na,1.5,1970-01-01T00:00:03.2Z,ssdp\nb,2,x,\n")
    rows = tables.read_intervals(spark, f"{tmp_path}/i.csv").orderBy("capture").collect()
    assert [(r.capture, r.start, r.end, r.family) for r in rows] == [("a", 1.5, 3.2, "ssdp"), ("b", 2.0, None, "attack")]
    (tmp_path / "l.csv").write_text("file,attack_label,attack_start_iso,family\nx/y.pcap,1,1970-01-01T00:00:10Z,dos\nz.pcap,0,,\n")
    got = {r.capture: (r.attack_label, r.attack_start) for r in tables.read_file_labels(spark, f"{tmp_path}/l.csv").collect()}
    assert got == {"y.pcap": (1, 10.0), "z.pcap": (0, None)}


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") * 37 % 6000).alias("s"), (F.col("id") % 3).alias("k")).select(F.timestamp_seconds("s").alias("ts"), F.col("k").cast("string").alias("k"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = {(r.start, r.k): r.n for r in sw.drained(sw.sliding_counts(stream, "10 minutes", "5 minutes", ["k"]), "t").collect()}
    last = rows.agg(F.max("ts")).first()[0]
    want = {(r.w.start, r.k): r["count"] for r in rows.groupBy(F.window("ts", "10 minutes", "5 minutes").alias("w"), "k").count().collect() if r.w.end <= last}
    assert got == want and got
