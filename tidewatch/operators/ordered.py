"""Running sums and maxima in an order, and exact quantiles, without a task that holds all rows of a group.

The order is cut at about equal numbers of rows (by approximate quantiles, which decide only where the cuts are), the aggregate
runs within each part, and what the parts before it come to, a row for each group and part, is put on top. Rows that are equal in
the order stay together, so the result doesn't depend on the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.sources.shared import written

#: Parts into which the order is cut, and the accuracy of the cuts.
PARTS, ACCURACY = 256, 10_000


def _part(df: DataFrame, order: str) -> Column:
    """The number of cuts below a value, in two steps of at most 16 comparisons; nulls are in the lowest part, as they sort first."""
    cuts = sorted(set(df.agg(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)], ACCURACY)).first()[0] or []))
    below = lambda some: F.size(F.filter(some, lambda cut: cut < F.col(order)))
    if len(cuts) <= 16:
        return below(F.lit(cuts)) if cuts else F.lit(0)
    sixteens = below(F.lit(cuts[15::16])) * 16
    return sixteens + below(F.slice(F.lit(cuts), sixteens + 1, F.lit(16)))


def _same(keys: list[str]) -> Column:
    return F.expr(" and ".join(f"here.`{k}` <=> there.`{k}`" for k in keys) or "true")


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple], descending: bool = False, own: bool = True, then: list[str] = ()) -> DataFrame:
    """``df`` with running aggregates in each group of ``keys``.

    ``values``: name -> (F.sum, F.max or F.min, column). ``own`` says whether a row counts itself; where nothing comes before it, the value is
    null. ``order`` is a numeric column and ``then`` the columns that order its ties. Null keys are a group.
    """
    keys = list(keys)
    rows = df.withColumn("__part", _part(df, order))
    group = [*keys, "__part"]
    by = [F.desc(order) if descending else F.asc(order), *then]
    within = W.partitionBy(*group).orderBy(*by).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    here = rows.withColumns({f"__in_{n}": f(c).over(within) for n, (f, c) in values.items()})
    parts = rows.groupBy(*group).agg(*[f(c).alias(f"__of_{n}") for n, (f, c) in values.items()])
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("__part") if descending else F.asc("__part")).rowsBetween(W.unboundedPreceding, -1)
    before = parts.select(*group, *[f(f"__of_{n}").over(earlier).alias(f"__before_{n}") for n, (f, _) in values.items()])
    both = here.alias("here").join(before.alias("there"), _same(group))
    merged = {n: _merged(f, F.col(f"__in_{n}"), F.col(f"__before_{n}")).alias(n) for n, (f, _) in values.items()}
    return both.select(*[F.col(f"here.`{c}`") for c in df.columns], *merged.values())


def _merged(f, a: Column, b: Column) -> Column:
    if f is F.sum:
        return F.coalesce(a + b, a, b)
    return F.greatest(a, b) if f is F.max else F.least(a, b)  # both skip nulls


def quantiles(df: DataFrame, columns: list[str], qs: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, name, q, value): exact quantiles of several columns, linear between order statistics; nulls are left out.

    Values are counted first, and the counts kept as a table, so what is put in order (and read three times for it) are distinct values.
    """
    keys = list(keys)
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("__v"))
    group = [*keys, "name"]
    counts = long.select(*keys, "__v.name", "__v.value").where("value is not null").groupBy(*group, "value").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    upto = running(counts, group, "value", {"upto": (F.sum, "n")})
    total = counts.groupBy(*group).agg((F.sum("n") - 1).alias("last"))
    rows = upto.alias("here").join(total.alias("there"), _same(group)).select(*[F.col(f"here.`{k}`") for k in group], "value", "n", "upto", "last")
    # the order statistics on both sides of the place; the value at one of them is that of the first count to go beyond it
    rows = rows.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).withColumn("place", F.col("q") * F.col("last"))
    holds = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
    low, high = F.floor("place"), F.ceil("place")
    ends = rows.where(holds(low) | holds(high)).groupBy(*group, "q").agg(F.max("place").alias("place"), F.min("value").alias("a"), F.max("value").alias("b"))
    return ends.select(*group, "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b")).alias("value"))


def quantile_values(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float]]:
    """name -> the quantiles ``qs``, for columns that have values."""
    found: dict[str, dict[float, float]] = {}
    for r in quantiles(df, columns, qs).collect():
        found.setdefault(r["name"], {})[r["q"]] = r["value"]
    return {c: [found[c][q] for q in qs] for c in columns if c in found}
