"""Ordered folds as expressions: one narrow array a group, sorted once, and a reduction over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def folded(order: list[str], columns: list[str], start: dict[str, Column], step) -> Column:
    """An aggregate: the group's rows in ``order`` are folded. ``step(state, row)`` gives the next state as a dict of columns."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *columns)))
    first = F.struct(*[c.alias(n) for n, c in start.items()])

    def merge(s: Column, x: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in step(s, x).items()])

    return F.aggregate(rows, first, merge)
