"""Captures by byte range: any number of ranges gives the packets of one walk, with damage at the seams and headers inside of frames."""

import random
import struct

import pytest

from tidewatch.sources import pcap
from tidewatch.sources import ranges as rg


def udp(n: int, body: bytes) -> bytes:
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28 + len(body), 0, 0, 64, 17, 0, bytes((10, 0, 0, 1)), bytes((10, 0, n >> 8 & 255, n & 255)))
    return b"\x02" * 12 + b"\x08\x00" + ip + struct.pack(">HHHH", n % 60_000, 1900, 8 + len(body), 0) + body


def bodies(rng, n):
    """Payloads, some of which are captures themselves: headers in them must not be taken for frames."""
    inner = b"".join(struct.pack("<IIII", 9, 9, 30, 30) + b"z" * 30 for _ in range(12))
    for i in range(n):
        yield inner if i % 9 == 0 else rng.randbytes(rng.randint(0, 300))


def classic(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack(order + "IIII", i, 7, len(f), len(f)) + f for i, f in enumerate(frames))


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def blocks(frames, order="<", links=((1, 6), (1, 9))):
    out = block(order, rg.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += b"".join(block(order, 1, struct.pack(order + "HHI", link, 0, 65535) + struct.pack(order + "HH", 9, 1) + bytes([res, 0, 0, 0]) + b"\0\0\0\0") for link, res in links)
    for i, f in enumerate(frames):
        which = i % len(links)
        ticks = i * 10 ** links[which][1]
        out += block(order, 6, struct.pack(order + "IIIII", which, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def files(tmp_path):
    rng = random.Random(5)
    frames = [udp(i, b) for i, b in enumerate(bodies(rng, 150))]
    made = {"little.pcap": classic(frames), "big.pcap": classic(frames, ">", True), "block.pcapng": blocks(frames), "sections.pcapng": blocks(frames[:70], "<") + blocks(frames[70:], ">", ((1, 3),)), "cut.pcap": classic(frames)[:-11], "short.pcap": classic(frames[:2]), "junk.pcap": b"no capture at all", "empty.pcap": b""}
    for name, at in (("little.pcap", 9000), ("block.pcapng", 12_004)):
        broken = bytearray(made[name])
        broken[at : at + 700] = b"\xff" * 700
        made[f"broken-{name}"] = bytes(broken)
    made["lost.pcap"] = classic(frames)[:5000] + b"\xff" * 20_000 + classic(frames)[24:]
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    return made


COLUMNS = ("capture", "packet_no", "us", "frame_len", "src_port", "dst_ip", "payload")


def test_any_number_of_ranges(spark, tmp_path):
    made = files(tmp_path)
    rows = lambda size: sorted(tuple(r[c] for c in COLUMNS) for r in pcap.read(spark, f"{tmp_path}/*.pcap*", range_bytes=size).select(*COLUMNS).collect())
    whole = rows(1 << 26)
    of = lambda name: [r for r in whole if r[0] == name]
    for name in ("little.pcap", "big.pcap", "block.pcapng", "sections.pcapng"):
        assert [r[1] for r in of(name)] == list(range(150)) and [r[4] for r in of(name)] == list(range(150))
    assert len(of("cut.pcap")) == 149 and len(of("short.pcap")) == 2 and not of("junk.pcap")
    for name in ("broken-little.pcap", "broken-block.pcapng"):
        assert 140 < len(of(name)) < 150 and {r[4] for r in of(name)} >= {0, 149}
    assert len(of("lost.pcap")) > 150
    largest = max(map(len, made.values()))
    for size in (-(-largest // 8), 2777):
        assert rows(size) == whole
    counts = {}
    for size in (1 << 26, 6000):
        counts[size] = {r.capture: (r.frames, r.undecoded, r.lost_bytes) for r in pcap.damage(spark, f"{tmp_path}/*.pcap*", range_bytes=size).collect()}
    assert counts[1 << 26] == counts[6000]
    assert counts[6000]["little.pcap"] == (150, 0, 0) and counts[6000]["junk.pcap"] == (0, 0, 17)
    assert counts[6000]["broken-little.pcap"][2] > 0 and counts[6000]["cut.pcap"][2] > 0


def test_limit_and_names(spark, tmp_path):
    frames = [udp(i, b"x" * 50) for i in range(40)]
    for folder, n in (("a", 40), ("b", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.pcap").write_bytes(classic(frames[:n]))
    got = pcap.read(spark, f"{tmp_path}/*/same.pcap", packet_limit=7, range_bytes=900).groupBy("capture").count().collect()
    assert {(r.capture, r["count"]) for r in got} == {("a/same.pcap", 7), ("b/same.pcap", 3)}
    with pytest.raises(ValueError):
        pcap.read(spark, f"{tmp_path}/a", range_bytes=0)


def test_walks_agree_at_every_cut():
    """Without Spark: two ranges cut at every byte, the second begun where it believes to be at home."""
    rng = random.Random(6)
    frames = [udp(i, b) for i, b in enumerate(bodies(rng, 12))]
    for data in (classic(frames), blocks(frames)):
        part, layout = rg.Part(data, 0, len(data)), rg.layout_of(data[:24])
        whole = rg.Walk(rg.first_offset(layout), layout)
        all_ = list(rg.frames(part, whole, len(data)))
        assert len(all_) == 12 and whole.lost == 0
        for cut in range(30, len(data), 7):
            first = rg.Walk(rg.first_offset(layout), layout)
            a = list(rg.frames(part, first, cut))
            second = rg.Walk(first.at, first.layout)
            assert a + list(rg.frames(part, second, len(data))) == all_
