"""Window helpers of (symbol, date) panels."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_symbol(order: str = "date"):
    return Window.partitionBy("symbol").orderBy(order)


def roll(agg, x: Column, n: int, offset: int = 0, order: str = "date") -> Column:
    """agg over the last n rows, null until n of them are non-null; offset -1 leaves out the current row."""
    w = by_symbol(order).rowsBetween(-(n - 1) + offset, offset)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def average_rank(x: Column, within: list[str]) -> Column:
    """Rank from 1 with ties averaged; null for null."""
    w = Window.partitionBy(*within).orderBy(x.asc_nulls_last())
    same = Window.partitionBy(*within, x)
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def running(agg, x: Column, within: list[str], order) -> Column:
    return agg(x).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
