"""Keyed state of one's own: windows that count late packets while they are open, meters that end by timer, alarms with a cooldown.

All are processors of Spark's state API over a state store on disk (:func:`store`). State is a few numbers a key, of windows those that are
open, which are width over hop and one more, and of meters the spans that the watermark hasn't passed. A key's rows of a micro-batch are put in order
first, so a trigger's size bounds what is held; triggers themselves have to come in that order, but for meters, whose hits may be late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def store(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in the store that these processors need."""
    spark.conf.set(STORE, ROCKS)


def _ordered(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class OpenWindows(StatefulProcessor):
    """Windows [u0 + i * hop, + width) of a capture from its first packet on; one has ended once a packet at or after its end has arrived."""

    def __init__(self, width: int, hop: int):
        self.width, self.hop = width, hop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("windows", "u0 long, seen long, at array<long>, n array<long>, value array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows, "order")
        ends = frame["us"].isna()
        flush = bool(ends.any())
        packets = frame[~ends]
        us, value = packets["us"].to_numpy(np.int64), packets["value"].to_numpy(np.float64)
        known: dict[int, tuple[int, float]] = {}
        u0 = seen = None
        if self.state.exists():
            u0, seen, at, n, total = self.state.get()
            known = {i: (c, v) for i, c, v in zip(at, n, total, strict=True)}
        if len(us):
            u0 = int(us[0]) if u0 is None else u0
            first = u0 - self.width if seen is None else seen  # nothing has ended before the first packet
            reached = np.maximum.accumulate(np.concatenate([[first], us]))
            before, seen = reached[:-1], int(reached[-1])
            offset = us - u0
            high = offset // self.hop
            low = np.where(offset < self.width, 0, (offset - self.width) // self.hop + 1)
            copies = np.where(offset < 0, 0, np.maximum(high - low + 1, 0))
            row = np.repeat(np.arange(len(us)), copies)
            index = low[row] + np.arange(len(row)) - (np.cumsum(copies) - copies)[row]
            still = u0 + index * self.hop + self.width > before[row]
            places, which = np.unique(index[still], return_inverse=True)
            counts, sums = np.bincount(which, minlength=len(places)), np.bincount(which, weights=value[row[still]], minlength=len(places))
            for i, c, v in zip(places.tolist(), counts.tolist(), sums.tolist(), strict=True):
                old = known.get(i, (0, 0.0))
                known[i] = old[0] + int(c), old[1] + v
        done = sorted(i for i in known if flush or u0 + i * self.hop + self.width <= seen)
        if done:
            yield pd.DataFrame({"capture": [key[0]] * len(done), "window_index": done, "w_start": [u0 + i * self.hop for i in done], "n": [known[i][0] for i in done], "value": [known[i][1] for i in done]})
        if flush:
            self.state.clear()
        elif u0 is not None:
            left = sorted(set(known) - set(done))
            self.state.update((u0, seen, left, [known[i][0] for i in left], [known[i][1] for i in left]))

    def close(self) -> None:
        pass


def late_windows(packets: DataFrame, width: int, hop: int) -> DataFrame:
    """A stream's windows in the order of arrival: capture, window_index, w_start, n and value, each emitted once, when it has ended.

    ``packets``: capture, order (of arrival), us (long; null: the capture's end, at which all that is open is emitted), value. A packet
    that comes after its window's end is left out, one that comes late while it is open is counted: as :func:`operators.windows.assign_arrival`.
    """
    store(packets.sparkSession)
    rows = packets.select("capture", "order", "us", F.col("value").cast("double").alias("value"))
    return rows.groupBy("capture").transformWithStateInPandas(OpenWindows(width, hop), "capture string, window_index long, w_start long, n long, value double", "Append", "None")


class Meters(StatefulProcessor):
    """Spans of a bucket of hosts: a hit begins one or extends it, and the bucket's timer ends those that no hit can extend any more."""

    def __init__(self, seconds: int):
        self.size = seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("spans", "hosts array<string>, ended array<long>, host array<string>, from_us array<long>, last_us array<long>, hits array<long>, timer long")

    def _joined(self, spans: pd.DataFrame) -> pd.DataFrame:
        """A host's spans that are no further apart than the size, as one; in the order of time."""
        code, hosts = pd.factorize(spans["host"])
        order = np.lexsort((spans["from_us"].to_numpy(), code))
        code, begun, last, hits = code[order], *(spans[c].to_numpy()[order] for c in ("from_us", "last_us", "hits"))
        reached = pd.Series(last).groupby(code).cummax().to_numpy()
        at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (begun[1:] - reached[:-1] > self.size)))
        return pd.DataFrame({"host": hosts[code[at]], "from_us": begun[at], "last_us": np.maximum.reduceat(last, at), "hits": np.add.reduceat(hits, at)})

    def _settled(self, spans: pd.DataFrame, ended: dict[str, int], timer: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Emits the spans that end before the watermark, numbered on, and keeps the others with a timer for the first of them."""
        # the first whole millisecond at which no hit can extend the span
        due = (spans["last_us"] + self.size) // 1000 + 1
        over = due <= now
        done, left = spans[over], spans[~over]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(due[~over].min()) if len(left) else None
        if timer is not None:
            self.handle.registerTimer(timer)
        if len(done):
            span = done["host"].map(lambda h: ended.get(h, 0)) + done.groupby("host").cumcount() + 1
            yield pd.DataFrame({"host": done["host"], "span": span, "from_us": done["from_us"], "until_us": done["last_us"] + self.size, "hits": done["hits"]})
            ended = ended | dict(zip(done["host"], span.tolist(), strict=True))
        self.state.update((list(ended), list(ended.values()), *(left[c].tolist() for c in ("host", "from_us", "last_us", "hits")), timer))

    def _kept(self) -> tuple[pd.DataFrame, dict[str, int], int | None]:
        hosts, ended, host, begun, last, hits, timer = self.state.get()
        return pd.DataFrame({"host": np.array(host, object), "from_us": np.array(begun, np.int64), "last_us": np.array(last, np.int64), "hits": np.array(hits, np.int64)}), dict(zip(hosts, ended, strict=True)), timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = [self._joined(pd.DataFrame({"host": f["host"], "from_us": f["us"], "last_us": f["us"], "hits": np.ones(len(f), np.int64)})) for f in rows]
        kept, ended, timer = self._kept() if self.state.exists() else (spans[0][:0], {}, None)
        spans = self._joined(pd.concat([kept, *spans], ignore_index=True))
        yield from self._settled(spans, ended, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans, ended, _ = self._kept()
        yield from self._settled(spans, ended, None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def meter_spans(hits: DataFrame, seconds: int, lateness: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """A stream's spans during which hosts are metered, each emitted when the watermark has passed its end: as :func:`operators.augment.meters`.

    ``hits``: host, ts (timestamp). Rows without a host only move the watermark (a capture's end). Hits may come in any order within ``lateness``.
    Hosts share state and timer by ``buckets`` (the same over restarts): a call of Python costs about as much as some hundred hosts of one.
    """
    store(hits.sparkSession)
    # a condition on the time too, or it would be applied before the watermark sees the rows
    named = F.when(F.col("ts").isNotNull(), F.col("host").isNotNull())
    rows = hits.withColumn("us", F.unix_micros("ts")).withWatermark("ts", lateness).where(named)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Meters(seconds), "host string, span long, from_us long, until_us long, hits long", "Append", "EventTime")


class Alarms(StatefulProcessor):
    """Runs of flagged events of each key of a bucket, counted up to an alarm and then passed over."""

    def __init__(self, required: int, cooldown: int):
        self.required, self.cooldown = required, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alarms", "keys array<string>, run array<long>, cool array<long>, alarms array<long>")

    def _passed(self, flags: np.ndarray, run: int, cool: int, alarms: int) -> tuple[list[int], tuple[int, int, int]]:
        """The places of alarms among a key's next events, and what is left at their end."""
        # from one run's end to the next: between alarms only the ends of runs matter
        ends = np.append(np.flatnonzero(~flags), len(flags))
        found, at = [], 0
        while at < len(flags):
            if cool:
                passed = min(cool, len(flags) - at)
                at, cool, run = at + passed, cool - passed, 0
                continue
            end = int(ends[np.searchsorted(ends, at)])
            if run + end - at >= self.required:
                at += self.required - run
                alarms, run, cool = alarms + 1, 0, self.cooldown
                found.append(at - 1)
            else:
                run = 0 if end < len(flags) else run + end - at
                at = end + 1
        return found, (run, cool, alarms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows, "order")
        code, keys = pd.factorize(frame["key"], use_na_sentinel=False)
        place = np.argsort(code, kind="stable")
        flags, orders = frame["flag"].fillna(False).to_numpy(bool)[place], frame["order"].to_numpy(np.int64)[place]
        cuts = np.searchsorted(code[place], np.arange(len(keys) + 1))
        known = {}
        if self.state.exists():
            names, *numbers = self.state.get()
            known = dict(zip(names, zip(*numbers, strict=True), strict=True))
        out = []
        for k, low, high in zip((None if pd.isna(k) else k for k in keys), cuts[:-1], cuts[1:], strict=True):
            run, cool, alarms = known.get(k, (0, 0, 0))
            found, known[k] = self._passed(flags[low:high], run, cool, alarms)
            out += [(k, orders[low + i], alarms + n) for n, i in enumerate(found, 1)]
        self.state.update((list(known), *map(list, zip(*known.values(), strict=True))))
        if out:
            yield pd.DataFrame(out, columns=["key", "order", "alarm_no"])

    def close(self) -> None:
        pass


def alarms(events: DataFrame, key: str, required: int, cooldown: int, buckets: int = 1024) -> DataFrame:
    """Keyed decisions over a stream: an alarm when ``required`` flagged events of a key have come in a row, then
    ``cooldown`` events are passed over. ``events``: key, order (long), flag (boolean). Keys share state by ``buckets``, as in :func:`meter_spans`."""
    store(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("key"), "order", "flag")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Alarms(required, cooldown), "key string, order long, alarm_no long", "Append", "None")
