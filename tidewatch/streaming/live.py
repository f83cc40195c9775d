"""Captures that are still being written, as a streaming source: ``spark.readStream.format("live_capture").load(folder)``.

The offset of a file is the byte behind its last whole record, with the number of packets up to there and, for blocks, the interfaces. A record that isn't
whole yet waits for the next trigger; nothing is read twice or left out, over restarts as well, since the stream's checkpoint holds the offsets.
A trigger goes no further than ``bytes_per_trigger`` in a file; what is left comes with the next one. The driver looks at headers only, and tasks
decode a range of a file each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewatch.sources import pcap
from tidewatch.sources import ranges as rg


def _listed(folder: str, suffixes: tuple[str, ...]) -> dict[str, int]:
    """Capture files directly in a folder, with their sizes."""
    from pyarrow import fs

    if re.match(r"(file:)?/", folder):
        store, inner = fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    else:
        store, inner = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", folder))
    found = store.get_file_info(fs.FileSelector(inner))
    return {f"{folder.rstrip('/')}/{f.base_name}": f.size for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffixes)}


@dataclass
class Piece(InputPartition):
    """A range of a file at whose ends records meet."""

    path: str
    low: int
    high: int
    first_no: int
    order: str
    links: list

    def __init__(self, path, low, high, first_no, order, links):
        super().__init__((path, low, high, first_no, order, links))
        self.path, self.low, self.high, self.first_no, self.order, self.links = path, low, high, first_no, order, links


def advanced(path: str, size: int, state: dict | None, most: int) -> dict | None:
    """The state of a file's walk (at, no, order, links) after what is whole of its next ``most`` bytes; None while its head isn't there."""
    with rg.opened(path) as f:
        layout = rg.layout_of(f.read_at(rg.HEAD, 0))
        if layout is None:
            return state
        if state is None:
            state = {"at": rg.first_offset(layout), "no": 0, "order": layout.order, "links": []}
        start = state["at"]
        end = min(size, start + most)
        part = rg.Part(f.read_at(min(size, end + rg.BEHIND) - start, start) if end > start else b"", start, size)
    layout = replace(layout, order=state["order"], links=tuple(map(tuple, state["links"])))
    walk, no, at = rg.Walk(start, layout), state["no"], start
    while at < end:
        found = rg.record(part, at, walk.layout)
        if found is None:
            if waits(part, at, walk.layout):
                break
            at = rg.resync(part, at + 1, end, walk.layout)
            if at is None:  # nothing to go on with yet
                break
            walk.at = at
            continue
        walk.at = at
        no += sum(1 for _ in rg.frames(part, walk, at + 1))
        at = walk.at
    return {"at": walk.at, "no": no, "order": walk.layout.order, "links": [list(x) for x in walk.layout.links]}


def waits(part: rg.Part, at: int, layout: rg.Layout) -> bool:
    """Is what stands at ``at`` the beginning of a record whose end isn't written yet?"""
    head = part.get(at, 16)
    if len(head) < (12 if layout.blocks else 16):
        return True
    size = int.from_bytes(head[4:8] if layout.blocks else head[8:12], "little" if layout.order == "<" else "big")
    return size <= rg.MOST + 4096 and at + size + (0 if layout.blocks else 16) > part.size


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".pcap,.pcapng,.cap").split(","))
        self.most = int(options.get("bytes_per_trigger", 256 << 20))
        self.known: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files = _listed(self.folder, self.suffixes)
        for path, size in sorted(files.items()):
            state = advanced(path, size, self.known.get(path), self.most)
            if state is not None:
                self.known[path] = state
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list:
        pieces = []
        for path, state in sorted(end.items()):
            self.known.setdefault(path, state)
            before = start.get(path)
            low = before["at"] if before else 0
            if state["at"] > low:
                pieces.append(Piece(path, low, state["at"], before["no"] if before else 0, before["order"] if before else "", before["links"] if before else []))
        return pieces

    def read(self, piece: Piece):
        import pyarrow.compute as pc

        known = piece.low > 0
        links = [{"link": a, "resolution": b} for a, b in piece.links]
        row = {"path": piece.path, "capture": piece.path.rpartition("/")[2], "size": piece.high, "low": piece.low, "high": piece.high, "start": piece.low if known else None, "taken": piece.order if known else None, "links": links, "first_no": piece.first_no, "lost": None, "content": None}
        for batch in pcap._packets(row, None, "PERMISSIVE"):
            yield batch.filter(pc.is_valid(batch.column("packet_no"))).select(pcap.NAMES)

    def commit(self, end: dict) -> None:
        pass


class LiveCaptures(DataSource):
    """Options: path (a folder), suffixes, bytes_per_trigger."""

    @classmethod
    def name(cls) -> str:
        return "live_capture"

    def schema(self) -> str:
        return pcap.SCHEMA

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(self.options)


def live(spark: SparkSession, folder: str, **options):
    """Packets of the captures that grow in a folder, as a stream."""
    spark.dataSource.register(LiveCaptures)
    return spark.readStream.format("live_capture").options(**{k: str(v) for k, v in options.items()}).load(folder)
