"""Running sums and exact quantiles of groups of any size.

A window over a whole group sorts it in one task, and an exact percentile holds
all of its distinct values in one buffer. Here a group is cut into ranges of the
ordering column by an approximate quantile sketch; a window runs within each
range, and sums of the ranges carry over. Wherever the cuts fall, the results
are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.tables import settled

RANGES = 64
ONE_SORT = 1 << 17


def by_or_all(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """df and its keys; without any, a constant column _all."""
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def running_before(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """df plus, for each name, the sum over the group's rows of smaller ``order``, and name_total, the group's sum.

    df has one row for each group and value of ``order``, without nulls. It is
    settled, as it is read several times; up to ``ONE_SORT`` rows plain windows
    give the same sums.
    """
    df = settled(df)
    if df.count() <= ONE_SORT:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        df = df.withColumns({f"_value_{k}": v for k, v in sums.items()})
        df = df.withColumns({k: F.coalesce(F.sum(f"_value_{k}").over(before), F.lit(0)) for k in sums} | {f"{k}_total": F.sum(f"_value_{k}").over(whole) for k in sums})
        return df.drop(*[f"_value_{k}" for k in sums])
    at = ", ".join(str(i / RANGES) for i in range(1, RANGES))
    cuts = df.groupBy(*keys).agg(F.expr(f"percentile_approx({order}, array({at}), 1000)").alias("_cuts"))
    # One row for each group; that of a constant key is surely small.
    ranged = df.withColumns(sums).join(F.broadcast(cuts) if keys == ["_all"] else cuts, keys)
    ranged = ranged.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    per = ranged.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = per.withColumns({f"_base_{s}": zero(F.sum(f"_sum_{s}").over(before)) for s in sums} | {f"{s}_total": F.sum(f"_sum_{s}").over(group) for s in sums})
    per = per.drop(*[f"_sum_{s}" for s in sums])
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumns({f"_in_{s}": zero(F.sum(s).over(within)) for s in sums})
    out = ranged.join(F.broadcast(per) if keys == ["_all"] else per, [*keys, "_range"])
    return out.withColumns({s: F.col(f"_in_{s}") + F.col(f"_base_{s}") for s in sums}).drop("_range", *[f"_{k}_{s}" for s in sums for k in ("in", "base")])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], name: str = "quantiles") -> DataFrame:
    """(keys, name): the exact quantiles of each group by linear interpolation, as an array; nulls take no part."""
    rows, by = by_or_all(df.filter(F.col(value).isNotNull()), keys)
    one = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    one = running_before(one, by, "_v", {"_below": F.col("_n")})
    place = [p * (F.col("_below_total") - 1) for p in probs]
    holds = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_n")), F.col("_v")))
    ends = [x for i, k in enumerate(place) for x in (holds(F.floor(k)).alias(f"_lo{i}"), holds(F.ceil(k)).alias(f"_hi{i}"), F.max(k - F.floor(k)).alias(f"_f{i}"))]
    mixed = F.array(*[F.when(F.col(f"_f{i}") == 0, F.col(f"_lo{i}")).otherwise(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))) for i in range(len(probs))])
    return one.groupBy(*by).agg(*ends).select(*keys, mixed.alias(name))
