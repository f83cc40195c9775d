"""Column builders for windowed statistics. None of them runs a job."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def entropy(n: Column) -> Column:
    """Shannon entropy in bits of groups whose sizes are ``n``: an aggregate over value counts."""
    total = F.sum(n).cast("double")
    return F.coalesce(F.log2(total) - F.sum(n * F.log2(n.cast("double"))) / total, F.lit(0.0))


def gini(counts: Column) -> Column:
    """Gini coefficient of an array of counts, zeros included; 0 if all are zero.

    With the counts ascending, (n + 1 - 2 * sum(cum) / cum_n) / n.
    """
    ordered = F.array_sort(counts)
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("area"))
    sums = F.aggregate(ordered, start, lambda s, x: F.struct((s["run"] + x).alias("run"), (s["area"] + s["run"] + x).alias("area")))
    n = F.size(counts)
    return F.coalesce((n + 1 - 2 * F.try_divide(sums["area"].cast("double"), sums["run"].cast("double"))) / n, F.lit(0.0))


def rounded(c: Column, places: int = 6) -> Column:
    """Half away from zero in double arithmetic, as SQL engines round doubles; ``F.round`` goes by the decimal digits
    that a double prints as, and differs where a mean is a half in the next place. NaN, infinity and null stay."""
    c = c.cast("double")
    y = F.abs(c * 10.0**places)
    whole = F.floor(y)
    up = whole + (y - whole >= 0.5).cast("int")
    # beyond 2^52 doubles have no fraction
    return F.when(y < 2.0**52, F.signum(c) * up / 10.0**places + 0.0).otherwise(c)


def wrapped_sum(c: Column) -> Column:
    """The exact sum of whole numbers, brought into 64 bits by whole turns of 2^64 where it doesn't fit them: a check value that no number of rows breaks."""
    turn, half = F.lit(Decimal(1 << 64)), F.lit(Decimal(1 << 63))
    return (F.pmod(F.sum(c.cast("decimal(19,0)")) + half, turn) - half).cast("long")


def single(c: Column) -> Column:
    """Rounded to a 32-bit float and widened again."""
    return c.cast("float").cast("double")


def percentile(c: Column, q) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(c, q)


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the points, constant beyond the ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        slope = (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1])
        out = F.when(x <= xs[i], ys[i - 1] + (x - xs[i - 1]) * slope).otherwise(out)
    return F.when(x <= xs[0], float(ys[0])).otherwise(out)
