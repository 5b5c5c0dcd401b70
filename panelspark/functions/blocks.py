"""Recursions over long groups by blocks, so that no task holds a group.

A group's rows are cut into ranges of the ordering column. An exponential mean
is an affine map of what stood before it, so each range is summed up by its
map, the few maps of a group are applied in turn, and every range runs again
from the mean that it starts from. An expanding percentile counts smaller
values among earlier rows: those of the same range of time, those of earlier
ranges in the same range of values, and whole cells of (time, value) below.
Wherever the cuts fall, results are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.kernels import expanding_percentile
from panelspark.sources.tables import settled

RANGES = 64


def _ranged(df: DataFrame, keys: list[str], column: str, name: str, ranges: int) -> DataFrame:
    """df plus ``name``: the range of the group's approximate quantiles that column falls in; -1 for null."""
    at = ", ".join(str(i / ranges) for i in range(1, ranges))
    cuts = df.groupBy(*keys).agg(F.expr(f"percentile_approx({column}, array({at}), 1000)").alias("_cuts"))
    own = F.when(F.col(column).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(column))))
    return df.join(cuts, keys).withColumn(name, own).drop("_cuts")


def _mean_from(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """The exponential mean of numbers that goes on from start; NaN: it begins with the first number."""
    if np.isnan(start):
        return pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
    return pd.Series(np.append(start, x)).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]


def exponential_mean(df: DataFrame, keys: list[str], order: str, value: str, alpha: float, least: int = 1, name: str = "ewm", ranges: int = RANGES) -> DataFrame:
    """df plus the recursive mean m += alpha (x - m) over the rows of each group in order.

    It begins at the first number; a null leaves it as it is, and it is null
    before ``least`` numbers. ``order`` is a number that tells a group's rows
    apart. Null keys have no mean and are left out, an empty table gives none.
    """
    rows = settled(_ranged(df, keys, order, "_block", ranges))
    schema = T.StructType([*[rows.schema[k] for k in (*keys, "_block")], T.StructField("_n", T.LongType()), T.StructField("_fresh", T.DoubleType()), T.StructField("_on", T.DoubleType())])

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(dtype=float)
        x = x[~np.isnan(x)]
        some = len(x) > 0
        return pdf.iloc[:1][[*keys, "_block"]].assign(_n=len(x), _fresh=_mean_from(x, alpha, np.nan)[-1] if some else np.nan, _on=_mean_from(x, alpha, 0.0)[-1] if some else 0.0)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, seen, out = np.nan, 0, []
        pdf = pdf.sort_values("_block")
        for n, fresh, on in zip(pdf["_n"], pdf["_fresh"], pdf["_on"], strict=True):
            out.append((mean, seen))
            if n:
                mean, seen = fresh if np.isnan(mean) else mean * (1 - alpha) ** n + on, seen + n
        return pdf[[*keys, "_block"]].assign(_start=[m for m, _ in out], _seen=[s for _, s in out])

    maps = rows.select(*keys, "_block", order, value).groupBy(*keys, "_block").applyInPandas(summary, schema)
    start = T.StructType([*[rows.schema[k] for k in (*keys, "_block")], T.StructField("_start", T.DoubleType()), T.StructField("_seen", T.LongType())])
    starts = maps.groupBy(*keys).applyInPandas(carry, start)
    full = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    columns = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(dtype=float)
        seen = pdf["_seen"].iloc[0] + np.cumsum(~np.isnan(x))
        return pdf[columns].assign(**{name: np.where(seen >= max(1, least), _mean_from(x, alpha, pdf["_start"].iloc[0]), np.nan)})

    out = rows.join(starts, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(run, full)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def percentile_so_far(df: DataFrame, keys: list[str], order: str, value: str, least: int = 252, name: str = "percentile", ranges: int = RANGES) -> DataFrame:
    """df plus (numbers so far that are at most the current one - 1) / (numbers so far - 1), null before ``least`` numbers and for null."""
    rows = df.withColumn("_v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
    rows = settled(_ranged(_ranged(rows, keys, order, "_block", ranges), keys, "_v", "_level", ranges))
    some = rows.filter("_level >= 0")
    # Whole cells of earlier blocks and lower levels, and all numbers of earlier blocks.
    cells = some.groupBy(*keys, "_block", "_level").agg(F.count(F.lit(1)).alias("_k"))
    places = cells.groupBy(*keys).agg(F.max("_block").alias("_b")).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("_block"))
    grid = places.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).join(cells, [*keys, "_block", "_level"], "left").na.fill(0, ["_k"])
    earlier = Window.partitionBy(*keys, "_level").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_before", F.coalesce(F.sum("_k").over(earlier), F.lit(0)))
    lower = Window.partitionBy(*keys, "_block").orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(*keys, "_block", "_level", F.coalesce(F.sum("_before").over(lower), F.lit(0)).alias("_lower"), F.sum("_before").over(Window.partitionBy(*keys, "_block")).alias("_seen"))

    fields = [*[rows.schema[k] for k in keys], rows.schema[order]]
    of_block = T.StructType([*fields, T.StructField("_among", T.DoubleType()), T.StructField("_no", T.LongType())])
    of_level = T.StructType([*fields, T.StructField("_same", T.LongType())])

    def within_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        no = np.arange(len(pdf))
        share = expanding_percentile(pdf["_v"].to_numpy(), 1)
        return pdf[[*keys, order]].assign(_among=np.where(no > 0, np.rint(np.nan_to_num(share) * no) + 1, 1.0), _no=no)

    def within_level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, out = pdf.sort_values("_block", kind="stable"), np.zeros(0), []
        for _, own in pdf.groupby("_block", sort=True):
            v = own["_v"].to_numpy()
            out.append(np.searchsorted(held, v, side="right"))
            held = np.sort(np.concatenate([held, v]), kind="stable")
        return pdf[[*keys, order]].assign(_same=np.concatenate(out))

    slim = some.select(*keys, order, "_v", "_block", "_level")
    a = slim.groupBy(*keys, "_block").applyInPandas(within_block, of_block)
    b = slim.groupBy(*keys, "_level").applyInPandas(within_level, of_level)
    counts = slim.drop("_v").join(a, [*keys, order]).join(b, [*keys, order]).join(grid, [*keys, "_block", "_level"])
    n, at_most = F.col("_seen") + F.col("_no") + 1, F.col("_lower") + F.col("_same") + F.col("_among")
    share = F.when(n >= max(2, least), (at_most - 1) / (n - 1))
    return rows.drop("_v", "_block", "_level").join(counts.select(*keys, order, share.alias(name)), [*keys, order], "left").select(*df.columns, name)
