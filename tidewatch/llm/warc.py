"""Not-modified revisit resolution over web-archive records.

A crawler stores a *revisit* record, without a body, when a server says that a page has not
changed. Resolving it is an as-of join: by canonical URL, the latest full response before it.
Its validators (ETag, Last-Modified) must agree with the revisit's where both have them, and the
headers that a 304 answer may update (RFC 9111, 4.3.4) are merged over the stored ones.

A URL may hold any share of the records, so no URL is one group: records are dealt by URL and time
bucket. Within a bucket a window carries the latest response forward; across buckets one row
for each carries it on. Only ids and headers move, never bodies.

Defined results: a record without URL or date resolves to nothing; of responses at the same time
the larger record id is the later; a revisit is never resolved by a response of its own time;
repeated revisits give repeated rows; a revisit whose validators disagree keeps its own headers; header names are
compared and returned in lower case, and entity tags are compared weakly.
"""

from __future__ import annotations

import datetime
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

#: Headers that describe the connection or the stored body and never change by a 304.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that don't choose a page.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)="
BUCKET_SECONDS = 6 * 3600


def canonical(url: Column) -> Column:
    """Without scheme, "www." or "m.", default port, fragment, tracking parameters, index page, ".html" or closing slash;
    host in lower case; parameters sorted."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(?:80|443)$", "")
    host = F.regexp_replace(host, r"^(?:www|m)\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(path, r"(?:/index)?\.html?$|/+$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _agree(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def _opaque(tag: Column) -> Column:
    """An entity tag without its mark of weakness: a 304 answer is matched by weak comparison (RFC 9110, 8.8.3.2)."""
    return F.regexp_replace(tag, r"^\s*W/", "")


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case alone the last value stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.transform(F.array(entries), last)[0])


def merged_headers(stored_headers: Column, fresh: Column) -> Column:
    """Names in lower case; those of a 304 win, but for the ones it may not change. Without headers on one side the other's stay, null without any."""
    none = F.create_map().cast("map<string,string>")
    allowed = F.map_filter(F.coalesce(fresh, none), lambda k, _: ~k.isin(*KEPT_HEADERS))
    old = F.coalesce(stored_headers, none)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)
    return F.when(stored_headers.isNotNull() | fresh.isNotNull(), merged)


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``records``: record_id, url, seconds (long), kind ('response' or 'revisit'), status, digest, headers (map).

    One row for each revisit: record_id, url, canonical_url, seconds, status, resolved_id (null if none), resolved_seconds, digest
    of the response, valid (null where nothing precedes it) and its merged headers.
    """
    slim = records.select("record_id", "url", canonical(F.col("url")).alias("canonical_url"), "seconds", "kind", "status", "digest", lowered(F.col("headers")).alias("headers"))
    slim = stored(slim, "records")
    usable = slim.where("canonical_url is not null and seconds is not null")
    # a row for each URL and second that a response or a revisit has, so that of a URL, however often it is asked for, a bucket holds no more rows than seconds
    ends = usable.where((F.col("kind") == "response") & (F.col("status") == 200)).groupBy("canonical_url", "seconds").agg(F.max_by(F.struct("seconds", "record_id", "digest", "headers"), "record_id").alias("last"))
    asked = usable.where("kind = 'revisit'").select("canonical_url", "seconds").distinct()
    points = ends.join(asked.withColumn("asked", F.lit(True)), ["canonical_url", "seconds"], "full_outer").withColumn("bucket", F.floor(F.col("seconds") / bucket_seconds).cast("long"))
    points = stored(points, "points")
    # strictly earlier in time: within the bucket, else of the buckets before it
    inside = W.partitionBy("canonical_url", "bucket").orderBy("seconds").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("canonical_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = points.groupBy("canonical_url", "bucket").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("seconds"))).alias("end"))
    carried = buckets.withColumn("carried", F.last("end", ignorenulls=True).over(before)).where("carried is not null").select("canonical_url", "bucket", "carried")
    here = points.withColumn("here", F.last("last", ignorenulls=True).over(inside)).where("asked")
    sources = here.join(carried, ["canonical_url", "bucket"], "left").select("canonical_url", "seconds", F.coalesce("here", "carried").alias("source"))
    found = usable.where("kind = 'revisit'").join(sources, ["canonical_url", "seconds"], "left").drop("kind")
    lost = slim.where("kind = 'revisit' and (canonical_url is null or seconds is null)").withColumn("source", F.lit(None).cast(found.schema["source"].dataType)).drop("kind")
    own, old = F.col("headers"), F.col("source.headers")
    valid = F.when(
        F.col("source").isNotNull(),
        _agree(_opaque(F.element_at(own, "etag")), _opaque(F.element_at(old, "etag"))) & _agree(F.element_at(own, "last-modified"), F.element_at(old, "last-modified")),
    )
    both = found.unionByName(lost).withColumn("valid", valid)
    took = F.coalesce(F.col("valid"), F.lit(False))
    return both.select(
        "record_id",
        "url",
        "canonical_url",
        "seconds",
        F.when(took, F.lit(200)).otherwise(F.col("status")).alias("status"),
        F.when(took, F.col("source.record_id")).alias("resolved_id"),
        F.when(took, F.col("source.seconds")).alias("resolved_seconds"),
        F.when(took, F.col("source.digest")).alias("digest"),
        "valid",
        F.when(took, merged_headers(old, own)).otherwise(own).alias("headers"),
    )


RECORD = "record_id string, url string, seconds long, kind string, status int, digest string, headers map<string,string>"
_KINDS = {"response", "revisit"}


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines as a dict with names in lower case; a repeated name keeps its last value."""
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class Damage:
    """What of an archive file couldn't be read: parts that don't unpack, records without a usable length, and bytes passed over."""

    def __init__(self) -> None:
        self.members = self.records = self.bytes = 0


def _members(data: bytes, damage: Damage, step: int = 1 << 16):
    """The parts of a file that is compressed record by record; a plain file as it is. A part that doesn't unpack is counted, and reading goes on at
    the next one's first bytes."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    start = 0
    while start < len(data):
        tool, parts, at = zlib.decompressobj(31), [], start
        try:
            while not tool.eof and at < len(data):
                parts.append(tool.decompress(data[at : at + step]))
                at += min(step, len(data) - at)
        except zlib.error:
            pass
        if tool.eof:
            start = at - len(tool.unused_data)
            yield b"".join(parts)
            continue
        there = data.find(b"\x1f\x8b\x08", start + 1)
        there = len(data) if there < 0 else there
        damage.members += 1
        damage.bytes += there - start
        start = there


def records_of(data: bytes, damage: Damage | None = None):
    """Response and revisit records of an archive file; what is damaged is passed over and counted."""
    damage = damage or Damage()
    for member in _members(data, damage):
        yield from _records(io.BytesIO(member), damage)


def _records(stream: io.BytesIO, damage: Damage):
    size = len(stream.getbuffer())
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            damage.bytes += len(line) if line.strip() else 0
            continue
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        own = _fields(head)
        length = own.get("content-length", "")
        if not length.isdigit() or stream.tell() + int(length) > size:
            damage.records += 1
            continue
        block = stream.read(int(length))
        if own.get("warc-type") not in _KINDS:
            continue
        lines = block.split(b"\r\n\r\n", 1)[0].split(b"\r\n")
        first = lines[0].split()
        status = int(first[1]) if len(first) > 1 and first[0].startswith(b"HTTP/") and first[1].isdigit() else None
        try:
            seconds = int(datetime.datetime.fromisoformat(own["warc-date"].replace("Z", "+00:00")).timestamp())
        except (KeyError, ValueError):
            seconds = None
        yield {
            "record_id": own.get("warc-record-id"),
            "url": own.get("warc-target-uri", "").strip("<>") or None,
            "seconds": seconds,
            "kind": own["warc-type"],
            "status": status,
            "digest": own.get("warc-payload-digest"),
            "headers": list(_fields(lines[1:]).items()) if status is not None else [],
        }


def damaged(spark: SparkSession, path) -> DataFrame:
    """A row a file with what :func:`read` leaves out of it: path, damaged_members, damaged_records, lost_bytes."""

    def work(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Damage()
                for _ in records_of(data.as_py() or b"", found):
                    pass
                yield pa.RecordBatch.from_pylist([{"path": name, "damaged_members": found.members, "damaged_records": found.records, "lost_bytes": found.bytes}])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, damaged_members long, damaged_records long, lost_bytes long")


def read(spark: SparkSession, path) -> DataFrame:
    """The records of archive files, by Spark's binary reader: one task a file, in batches, without bodies."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
    schema = pa.schema(list(zip((c.split()[0] for c in RECORD.split(", ")), kinds, strict=True)))

    def work(batches):
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for row in records_of(data.as_py() or b""):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, RECORD)
