"""Frames of capture files by byte range: layouts, walks over a part of a file, and how a walk finds its first frame.

A range begins anywhere. Its walk looks for the first place from which several headers follow one another (or the file ends), and
then goes from header to header. Such a guess is checked afterwards against where the walk of the range before has ended
(see :func:`tidewatch.sources.pcap.index`), so that ranges give the same frames as one walk over the whole file.

Damage: where a header is impossible, the walk goes on at the next place that looks like a chain of headers; bytes passed over are counted.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field, replace

import numpy as np

#: Bytes of a frame at most (fixed value of the formats' tools), headers in a row that make a place believable, bytes at the head of a file that tell its layout.
MOST, CHAIN, HEAD = 262_144, 4, 24
#: How far behind its end a range is read: what its last frame and a chain may need.
BEHIND = 2 * MOST + 4096
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\xc3\xd4": (">", False), b"\xa1\xb2\x3c\x4d": (">", True)}
SECTION, INTERFACE, PACKET = 0x0A0D0D0A, 1, 6
BLOCKS = (SECTION, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs")


@dataclass(frozen=True)
class Layout:
    """How a file (or a section of it) is written: byte order, and per kind of file the ticks of a second, link types and resolutions."""

    order: str = "<"
    blocks: bool = False
    nano: bool = False
    link: int = 1
    links: tuple[tuple[int, int], ...] = field(default=())


def layout_of(head: bytes) -> Layout | None:
    """The layout that a file's first bytes tell; None for what isn't a capture."""
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        return Layout("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", True)
    if len(head) >= HEAD and head[:4] in CLASSIC:
        order, nano = CLASSIC[head[:4]]
        return Layout(order, False, nano, struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF)
    return None


def first_offset(layout: Layout) -> int:
    return 0 if layout.blocks else HEAD


@dataclass
class Part:
    """Bytes of a file from ``base`` on; ``size`` is the whole file's."""

    data: bytes
    base: int
    size: int

    def get(self, at: int, n: int) -> bytes:
        return self.data[at - self.base : at - self.base + n]


def record(part: Part, at: int, layout: Layout, strict: bool = False) -> tuple[int, int] | None:
    """(length of what stands at ``at``, its kind) - a header with its frame, or a block - or None where that can't be.

    Of a block both lengths are compared if the end is at hand. ``strict`` also asks for what headers nearly always keep: a part of
    a second below one, and no more kept of a frame than it had.
    """
    if layout.blocks:
        head = part.get(at, 12)
        if len(head) < 12:
            return None
        order = layout.order
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, n = struct.unpack_from(order + "II", head)
        if n < 12 or n % 4 or n > MOST + 4096 or at + n > part.size or (kind not in BLOCKS and kind & 0x7FFFFFFF > 0xFFFF):
            return None
        tail = part.get(at + n - 4, 4)
        return (n, kind) if len(tail) < 4 or struct.unpack(order + "I", tail)[0] == n else None
    head = part.get(at, 16)
    if len(head) < 16:
        return None
    _, frac, kept, full = struct.unpack(layout.order + "IIII", head)
    if kept > MOST or at + 16 + kept > part.size:
        return None
    odd = not kept or frac >= (10**9 if layout.nano else 10**6) or full < kept or full > 1 << 26
    return None if strict and odd else (16 + kept, 0)


def believable(part: Part, at: int, layout: Layout) -> bool:
    """Do ``CHAIN`` records follow one another from here, or all that are left of the file (or of what is at hand)?"""
    for _ in range(CHAIN):
        have = part.base + len(part.data)
        if at == part.size or have < part.size and at > have - 16:
            return True
        found = record(part, at, layout, strict=True)
        if found is None:
            return False
        at += found[0]
    return True


def resync(part: Part, at: int, end: int, layout: Layout) -> int | None:
    """The first believable place in [at, end). Blocks stand at multiples of four."""
    step = 4 if layout.blocks else 1
    at += -at % step
    while at < end:
        if layout.blocks:
            if believable(part, at, layout) and at + 12 <= part.size:
                return at
            at += step
            continue
        # of the next places only those with possible lengths and ticks are tried
        chunk = np.frombuffer(part.get(at, min(end - at, 1 << 16) + 15), np.uint8)
        n = len(chunk) - 15
        if n <= 0:
            return None
        words = [chunk[i : i + n].astype(np.uint32) for i in range(16)]
        join = lambda i: sum(words[i + j] << np.uint32(8 * (j if layout.order == "<" else 3 - j)) for j in range(4))
        frac, kept, full = join(4), join(8), join(12)
        could = (frac < (10**9 if layout.nano else 10**6)) & (kept > 0) & (kept <= MOST) & (full >= kept) & (full <= 1 << 26)
        for i in np.flatnonzero(could).tolist():
            if believable(part, at + i, layout):
                return at + i
        at += n
    return None


def _interface(body: bytes, order: str) -> tuple[int, int]:
    """(link type, resolution) of an interface's description."""
    resolution, o = 6, 8
    while o + 4 <= len(body):
        code, n = struct.unpack_from(order + "HH", body, o)
        if code == 0:
            break
        if code == 9 and n >= 1:
            resolution = body[o + 4]
        o += 4 + n + (-n % 4)
    return struct.unpack_from(order + "H", body)[0], resolution


def ticks_to_us(ticks: int, resolution: int) -> int:
    """Resolutions from 256 are a divisor, with the high bit a power of two, else a power of ten."""
    divisor = resolution if resolution >= 256 else 1 << (resolution & 0x7F) if resolution & 0x80 else 10**resolution
    return ticks * 1_000_000 // divisor


@dataclass
class Walk:
    """A walk's state: where it stands, the layout as blocks have changed it, whether a section began, bytes passed over, and whether it has ended
    adrift: at the end of its range, in search of a header."""

    at: int
    layout: Layout
    restarted: bool = False
    lost: int = 0
    adrift: bool = False


def frames(part: Part, walk: Walk, end: int):
    """(microseconds, frame, length on the wire, link type) of all frames whose record begins before ``end``; moves ``walk`` to the first record
    behind them. From a record that can't be it goes to the next believable one, and adrift to ``end`` if there is none before."""
    while walk.at < end:
        at, layout = walk.at, walk.layout
        found = record(part, at, layout)
        if found is None:
            there = resync(part, at + 1, min(end, part.size), layout)
            walk.at, walk.adrift = (end, True) if there is None else (there, False)
            walk.lost += walk.at - at
            continue
        size, kind = found
        walk.at += size
        if not layout.blocks:
            sec, frac, kept, full = struct.unpack(layout.order + "IIII", part.get(at, 16))
            yield sec * 1_000_000 + (frac // 1000 if layout.nano else frac), part.get(at + 16, kept), full, layout.link
            continue
        body = part.get(at + 8, size - 12)
        if kind == SECTION:
            walk.layout = replace(layout, order="<" if body[:4] == b"\x4d\x3c\x2b\x1a" else ">", links=())
            walk.restarted = True
        elif kind == INTERFACE and len(body) >= 8:
            walk.layout = replace(layout, links=(*layout.links, _interface(body, layout.order)))
        elif kind == PACKET and len(body) >= 20:
            i, high, low, kept, full = struct.unpack_from(layout.order + "IIIII", body)
            link, resolution = layout.links[i] if i < len(layout.links) else (1, 6)
            yield ticks_to_us(high << 32 | low, resolution), body[20 : 20 + kept], full, link


def reachable(path: str) -> bool:
    """Can tasks read ranges of the file by themselves?"""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return (found[1].lower() if found else "") in SCHEMES


def opened(path: str):
    """A file that can be read at any place, by its scheme."""
    from pyarrow import fs

    if not reachable(path):
        raise ValueError(f"ranges of {path} can't be read: only {', '.join(s for s in SCHEMES if s)} are known")
    if re.match(r"(file:)?/", path):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", path))
    store, inner = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
    return store.open_input_file(inner)


def read_part(path: str, start: int, end: int, size: int) -> tuple[Part, Layout | None]:
    """The bytes that a walk over [start, end) may need, and the file's layout."""
    with opened(path) as f:
        head = f.read_at(HEAD, 0)
        return Part(f.read_at(min(size, end + BEHIND) - start, start), start, size), layout_of(head)
