"""Running values and searches over long arrays of one row, in time about linear in their length.

Spark's higher-order functions have no running aggregate, and an array that
grows by one element at a time is copied each time. So arrays are cut into
blocks of ``BLOCK``, blocks of those, and every copy or search is of one block.

An array that a lambda captures must not be computed inside of it again and
again. Each helper refers to such a column twice, and puts it in a projection
of its own, so the optimizer leaves it there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def captured(array: Column, use: Column) -> Column:
    """use, which has array inside a lambda; null where array is null."""
    return F.when(F.size(array) >= 0, use)


def blocks(array: Column) -> Column:
    """The array in pieces of ``BLOCK`` elements; none of an empty one."""
    n = F.size(array)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return captured(array, F.transform(starts, lambda b: F.slice(array, b * BLOCK + 1, BLOCK)))


def _block_running(values: Column, base: Column, combine: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(base.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(values, start, step, lambda s: s["out"])


def with_running(df: DataFrame, arrays: dict[str, str], combine: Callable[[Column, Column], Column], zero: int = 0) -> DataFrame:
    """df plus a column for each name of a bigint array: for each element, those before it combined, from ``zero`` on."""
    total = lambda b: F.aggregate(b, F.lit(zero).cast("long"), lambda x, y: combine(x, y))
    running = lambda b, at: _block_running(b, at, combine)
    each = lambda make: {k: v for x, out in arrays.items() for k, v in [make(x, out)]}
    df = df.withColumns(each(lambda x, out: (f"{out}_one", blocks(F.col(x)))))
    df = df.withColumns(each(lambda x, out: (f"{out}_sums", F.transform(f"{out}_one", total))))
    df = df.withColumns(each(lambda x, out: (f"{out}_two", blocks(F.col(f"{out}_sums")))))
    df = df.withColumns(each(lambda x, out: (f"{out}_tops", _block_running(F.transform(f"{out}_two", total), F.lit(zero), combine))))
    df = df.withColumns(each(lambda x, out: (f"{out}_base", F.flatten(F.zip_with(f"{out}_two", f"{out}_tops", running)))))
    df = df.withColumns(each(lambda x, out: (out, F.flatten(F.zip_with(f"{out}_one", f"{out}_base", running)))))
    return df.drop(*[f"{out}_{x}" for out in arrays.values() for x in ("one", "two", "sums", "tops", "base")])


def with_index(df: DataFrame, spans: dict[str, str]) -> DataFrame:
    """df plus a column for each name of an array of spans (structs with start and end, sorted by start): them in blocks of blocks with their reach."""
    reach = lambda b, lo, hi: F.struct(F.array_min(F.transform(b, lambda x: x[lo])).alias("lo"), F.array_max(F.transform(b, lambda x: x[hi])).alias("hi"), b.alias("items"))
    df = df.withColumns({f"{out}_one": F.transform(blocks(F.col(x)), lambda b: reach(b, "start", "end")) for x, out in spans.items()})
    return df.withColumns({out: F.transform(blocks(F.col(f"{out}_one")), lambda b: reach(b, "lo", "hi")) for out in spans.values()}).drop(*[f"{out}_one" for out in spans.values()])


def _meets(x: Column, lo: Column, hi: Column, scope: int) -> Column:
    return (x["start"] <= hi + scope) & (x["end"] >= lo - scope)


def any_near(index: Column, lo: Column, hi: Column, scope: int = 0, also: Callable[[Column], Column] | None = None) -> Column:
    """Whether a span of the index comes within ``scope`` of [lo, hi], and is fit as ``also`` says."""
    block = lambda b: (b["lo"] <= hi + scope) & (b["hi"] >= lo - scope)
    fits = (lambda x: _meets(x, lo, hi, scope)) if also is None else (lambda x: _meets(x, lo, hi, scope) & also(x))
    return F.exists(index, lambda c: block(c) & F.exists(c["items"], lambda b: block(b) & F.exists(b["items"], fits)))


def spans_within(index: Column, lo: Column, hi: Column) -> Column:
    """The spans of the index that meet [lo, hi), in order."""
    block = lambda b: (b["lo"] < hi) & (b["hi"] > lo)
    inner = F.flatten(F.transform(F.filter(index, block), lambda c: F.filter(c["items"], block)))
    return F.filter(F.flatten(F.transform(inner, lambda b: b["items"])), lambda x: (x["start"] < hi) & (x["end"] > lo))
