"""Finite machines over ordered rows of any number: a segment's rows become one transition function, and functions are composed.

A machine has few states once its counters are saturated. What a segment does to each of them - the state it leads to, what it adds to a counter,
where its first event is - is worked out for all states at once, without knowing the one it will begin in; segments are then joined in a tree. So
a capture's windows are cut into pieces of ``SEGMENT`` rows that run beside one another, and no task holds more than a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows of a segment, and segments (or functions of functions) that are joined at once.
SEGMENT = 4096


class Machine:
    """States are found from ``start`` on by ``step(state, symbol)``, which gives the next state, what is added to the counter, and the kind of event (0: none)."""

    def __init__(self, start: Hashable, symbols: int, step: Callable[[Hashable, int], tuple[Hashable, int, int]]):
        number, rows = {start: 0}, []
        todo = [start]
        for state in todo:  # grows as new states turn up
            row = []
            for symbol in range(symbols):
                after, gain, event = step(state, symbol)
                if after not in number:
                    number[after] = len(todo)
                    todo.append(after)
                row.append((number[after], gain, event))
            rows.append(row)
        table = np.array(rows, np.int64)
        self.states = todo
        self.next, self.gain, self.event = (np.ascontiguousarray(table[:, :, i].T) for i in range(3))


def joined(after: np.ndarray, gain: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One function from a row of them (a line for each, a column for each state), joined pairwise. ``first`` says where the first event is, -1 for none."""
    while len(after) > 1:
        odd = len(after) % 2
        rest = after[-1:], gain[-1:], first[-1:]
        a, b = slice(0, len(after) - odd, 2), slice(1, len(after), 2)
        through = after[a]
        gain = gain[a] + np.take_along_axis(gain[b], through, 1)
        first = np.where(first[a] >= 0, first[a], np.take_along_axis(first[b], through, 1))
        after = np.take_along_axis(after[b], through, 1)
        if odd:
            after, gain, first = (np.concatenate(x) for x in zip((after, gain, first), rest, strict=True))
    return after[0], gain[0], first[0]


def through(rows: DataFrame, machine: Machine, symbol: Column, order: str, tag: Column, top: Column, segment: int = SEGMENT) -> DataFrame:
    """(capture, state, gain, event, tag, top): what the machine does to each capture's rows in ``order`` (whole numbers; rows of one number in any order).

    ``gain`` is the counter's sum, ``event`` and ``tag`` are the first event's kind and its row's tag (null without any), ``top`` the largest ``top``.
    """
    place = F.col(order).cast("long")
    slim = rows.select("capture", place.alias("at"), F.floor(place / segment).cast("long").alias("piece"), symbol.cast("int").alias("symbol"), tag.alias("tag"), top.cast("double").alias("top"))
    # as a type of which every part may be null, as results are declared
    tag_type, size = StructType.fromDDL(f"tag {slim.schema['tag'].dataType.simpleString()}")["tag"].dataType, len(machine.states)
    arrow = pa.schema([("capture", to_arrow_type(slim.schema["capture"].dataType)), ("piece", pa.int64()), ("next", pa.list_(pa.int64())), ("gain", pa.list_(pa.int64())), ("event", pa.list_(pa.int64())), ("tags", pa.list_(to_arrow_type(tag_type))), ("top", pa.float64())])
    spelled = f"capture {slim.schema['capture'].dataType.simpleString()}, piece long, next array<long>, gain array<long>, event array<long>, tags array<{tag_type.simpleString()}>, top double"

    def made(table: pa.Table, after, gain, event, tags, columns: int) -> pa.Table:
        """One function of those of the table's rows; ``tags`` has an item for every ``columns`` states."""
        place = np.where(event > 0, np.arange(event.size).reshape(event.shape), -1)
        after, gain, first = joined(after, gain, place)
        kind = np.where(first >= 0, event.reshape(-1)[np.maximum(first, 0)], 0)
        found = [tags[i // columns].as_py() if i >= 0 else None for i in first.tolist()]
        top = max(table.column("top").drop_null().to_pylist(), default=None)
        return pa.Table.from_pylist([{"capture": table.column("capture")[0].as_py(), "piece": table.column("piece")[0].as_py(), "next": after.tolist(), "gain": gain.tolist(), "event": kind.tolist(), "tags": found, "top": top}], arrow)

    def first_round(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        symbols = table.column("symbol").to_numpy()
        return made(table, machine.next[symbols], machine.gain[symbols], machine.event[symbols], table.column("tag").combine_chunks(), size)

    def next_round(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        lists = lambda name: np.array(table.column(name).to_pylist(), np.int64).reshape(len(table), size)
        return made(table, lists("next"), lists("gain"), lists("event"), table.column("tags").combine_chunks().flatten(), 1)

    pieces = slim.groupBy("capture", "piece").applyInArrow(first_round, spelled)
    again = lambda df, piece: df.withColumnRenamed("piece", "at").withColumn("piece", piece).groupBy("capture", "piece").applyInArrow(next_round, spelled)
    pieces = again(pieces, F.floor(F.col("at") / segment).cast("long"))
    whole = again(pieces, F.lit(0).cast("long"))
    return whole.select("capture", F.col("next")[0].alias("state"), F.col("gain")[0].alias("gain"), F.col("event")[0].alias("event"), F.col("tags")[0].alias("tag"), "top")
