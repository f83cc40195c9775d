"""Assignment of packets to overlapping windows [start, start + W), in whole microseconds.

Policies differ in their anchor: the capture's first packet (``first``: as it arrives; ``sorted``: by time) or a
multiple of the hop (``aligned``). Assignment is arithmetic and one explode; a packet is copied ceil(W/S) times.
Where an aggregate can be merged, :func:`panes` avoids the copies: hop-sized panes are aggregated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.ordered import running


def check(width: int, hop: int) -> None:
    if width <= 0 or hop <= 0:
        raise ValueError(f"width and hop are positive, not {width} and {hop}")


def anchors(packets: DataFrame, hop: int, policy: str = "sorted") -> DataFrame:
    """One row a capture: its anchor u0 and its last window index."""
    low = F.min_by("us", "packet_no") if policy == "first" else F.min("us")
    a = packets.groupBy("capture").agg(low.alias("u0"), F.max("us").alias("u_last"))
    if policy == "aligned":
        a = a.withColumn("u0", F.floor(F.col("u0") / hop) * hop)
    return a.withColumn("k_last", F.floor((F.col("u_last") - F.col("u0")) / hop).cast("long")).select("capture", "u0", "k_last")


def indices(offset: Column, width: int, hop: int) -> Column:
    """The indices of all windows that hold an offset (not negative) from the anchor."""
    high = F.floor(offset / hop).cast("long")
    low = F.when(offset < width, F.lit(0)).otherwise(F.floor((offset - width) / hop) + 1).cast("long")
    return F.sequence(low, high)


def assign(packets: DataFrame, width: int, hop: int, policy: str = "sorted", max_windows: int | None = None) -> DataFrame:
    """Packets with window_index, w_start and w_end; one row for each window that a packet is in.

    Packets before the anchor (late ones under ``first``) are in no window.
    """
    check(width, hop)
    rows = packets.join(anchors(packets, hop, policy).drop("k_last"), "capture").where("us >= u0")
    rows = rows.withColumn("window_index", F.explode(indices(F.col("us") - F.col("u0"), width, hop)))
    if max_windows is not None:
        rows = rows.where(F.col("window_index") < max_windows)
    start = F.col("u0") + F.col("window_index") * hop
    return rows.withColumn("w_start", start).withColumn("w_end", start + width).drop("u0")


def assign_arrival(packets: DataFrame, width: int, hop: int, order: str = "packet_no") -> DataFrame:
    """As a stream without allowed lateness: a window has ended once a packet at or after its end has arrived.

    ``order`` gives the arrival; the anchor is the first arrival's time.
    """
    check(width, hop)
    first = packets.groupBy("capture").agg(F.min_by("us", order).alias("u0"))
    seen = running(packets, ["capture"], order, {"seen": (F.max, "us")}, own=False)
    rows = seen.join(first, "capture").where("us >= u0")
    rows = rows.withColumn("window_index", F.explode(indices(F.col("us") - F.col("u0"), width, hop)))
    open_ = F.col("seen").isNull() | (F.col("u0") + F.col("window_index") * hop + width > F.col("seen"))
    return rows.where(open_).withColumn("w_start", F.col("u0") + F.col("window_index") * hop).drop("u0", "seen")


def every_window(packets: DataFrame, width: int, hop: int, policy: str = "sorted", max_windows: int | None = None) -> DataFrame:
    """All windows of each capture, empty ones included."""
    check(width, hop)
    a = anchors(packets, hop, policy)
    last = F.col("k_last") if max_windows is None else F.least(F.col("k_last"), F.lit(max_windows - 1))
    rows = a.withColumn("window_index", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("u0") + F.col("window_index") * hop
    return rows.select("capture", "window_index", start.alias("w_start"), (start + width).alias("w_end"))


def panes(packets: DataFrame, width: int, hop: int, sums: dict[str, Column], policy: str = "sorted") -> DataFrame:
    """Sums per window without copying packets: hop-sized panes first, then width / hop panes a window."""
    check(width, hop)
    if width % hop:
        raise ValueError("panes need a width that is a multiple of the hop")
    rows = packets.join(anchors(packets, hop, policy).drop("k_last"), "capture").where("us >= u0")
    rows = rows.withColumn("pane", F.floor((F.col("us") - F.col("u0")) / hop).cast("long"))
    small = rows.groupBy("capture", "u0", "pane").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    spread = small.withColumn("window_index", F.explode(F.sequence(F.greatest(F.col("pane") - (width // hop - 1), F.lit(0)), F.col("pane"))))
    return spread.groupBy("capture", "window_index", (F.col("u0") + F.col("window_index") * hop).alias("w_start")).agg(*[F.sum(n).alias(n) for n in sums])


def microbin(width: int, bins: int) -> Column:
    """The bin of a packet within its window, 0 .. bins-1."""
    place = F.floor(((F.col("us") - F.col("w_start")) * bins) / width).cast("int")
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), place))


def sequences(windows: DataFrame, length: int, stride: int, tail: bool = True) -> DataFrame:
    """Runs of ``length`` rows every ``stride``, and one more that ends with the last row where the stride leaves some over.

    Adds seq_no (from 0), seq_start and position. Captures with fewer rows give none. ``windows`` has capture and window_index.
    """
    row = F.row_number().over(W.partitionBy("capture").orderBy("window_index")) - 1
    rows = windows.withColumn("row", row)
    counts = windows.groupBy("capture").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= length)
    starts = F.sequence(F.lit(0), F.col("n") - length, F.lit(stride))
    if tail:
        starts = F.array_distinct(F.concat(starts, F.array(F.col("n") - length)))
    plan = counts.select("capture", F.posexplode(starts).alias("seq_no", "seq_start"))
    plan = plan.withColumn("row", F.explode(F.sequence(F.col("seq_start"), F.col("seq_start") + length - 1)))
    return plan.join(rows, ["capture", "row"]).withColumn("position", F.col("row") - F.col("seq_start")).drop("row")


def chunks(windows: DataFrame, length: int) -> DataFrame:
    """Runs that don't overlap. A capture with fewer rows is filled up by its last; what is left over otherwise is dropped."""
    rows = windows.withColumn("row", F.row_number().over(W.partitionBy("capture").orderBy("window_index")) - 1)
    n = windows.groupBy("capture").agg(F.count("*").cast("int").alias("n"))
    rows = rows.join(n, "capture")
    last = (F.col("n") < length) & (F.col("row") == F.col("n") - 1)
    places = F.when(last, F.sequence(F.col("row"), F.lit(length - 1))).otherwise(F.array(F.col("row")))
    rows = rows.withColumn("row", F.explode(places)).withColumn("chunk", F.floor(F.col("row") / length).cast("int"))
    full = F.when(F.col("n") < length, F.lit(1)).otherwise(F.floor(F.col("n") / length))
    return rows.where(F.col("chunk") < full).withColumn("position", F.col("row") % length).drop("row", "n")


def history(windows: DataFrame, column: str, length: int, zero: Column) -> DataFrame:
    """Each row with the last ``length`` values, its own the last, filled with ``zero`` on the left."""
    past = W.partitionBy("capture").orderBy("window_index").rowsBetween(-(length - 1), 0)
    got = F.collect_list(column).over(past)
    return windows.withColumn("history", F.concat(F.array_repeat(zero, F.lit(length) - F.size(got)), got))


def before(df: DataFrame, keys: list[str], order: str, column: str, length: int, bucket: int = 4096) -> DataFrame:
    """Rows with a value, and what came before each of its key: previous (the last value, over any gap), and of the last ``length`` values their
    number, mean and deviation (population): history_n, history_mean, history_std; null where nothing came before.

    ``order`` is a whole number, of which a key has each once. A key's rows are cut into buckets of it that run beside one another; a bucket hands on its last
    ``length`` values, and takes those of the buckets before it.
    """
    if length < 1:
        raise ValueError("length is 1 at least")
    value, latest = F.col(column).cast("double"), lambda a: F.slice(a, F.greatest(F.size(a) - length, F.lit(0)) + 1, length)
    rows = df.where(F.col(column).isNotNull()).withColumn("__bucket", F.floor(F.col(order) / bucket).cast("long"))
    group = [*keys, "__bucket"]
    here = rows.withColumn("__here", F.collect_list(value).over(W.partitionBy(*group).orderBy(order).rowsBetween(-length, -1)))
    tails = here.groupBy(*group).agg(F.max_by(latest(F.concat("__here", F.array(value))), order).alias("__tail"))
    # every bucket has a value at least, so as many buckets as values are enough
    past = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(-length, -1)
    carried = tails.select(*group, latest(F.flatten(F.collect_list("__tail").over(past))).alias("__carried"))
    both = here.join(carried, group).withColumn("__past", latest(F.concat("__carried", "__here")))
    n = F.size("__past")
    mean = F.aggregate("__past", F.lit(0.0), lambda t, x: t + x) / n
    out = both.withColumns({"previous": F.when(n > 0, F.element_at("__past", -1)), "history_n": n, "history_mean": F.when(n > 0, mean)})
    spread = F.sqrt(F.aggregate("__past", F.lit(0.0), lambda t, x: t + (x - F.col("history_mean")) * (x - F.col("history_mean"))) / n)
    return out.withColumn("history_std", F.when(n > 0, spread)).drop("__bucket", "__here", "__carried", "__past")


def bounds(packets: DataFrame) -> DataFrame:
    """Packets, first and last time (as they arrive) and duration of each capture."""
    b = packets.groupBy("capture").agg(F.count("*").alias("packets"), F.min_by("us", "packet_no").alias("first_us"), F.max_by("us", "packet_no").alias("last_us"))
    return b.withColumn("duration_us", F.col("last_us") - F.col("first_us"))
