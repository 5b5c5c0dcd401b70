"""Corporate actions: as-traded and total-return prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import by_symbol

PRICES = ("open", "high", "low", "close")


def cumulative_split_factor(df: DataFrame) -> DataFrame:
    """Product of the ratios strictly after a row."""
    after = by_symbol().rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("split_factor", F.coalesce(F.product("split_ratio").over(after), F.lit(1.0)))


def reconstruct_raw(df: DataFrame) -> DataFrame:
    """As-traded prices; volume stays."""
    df = df if "split_factor" in df.columns else cumulative_split_factor(df)
    return df.withColumns({f"{p}_raw": F.col(f"{p}_split") * F.col("split_factor") for p in PRICES})


def compute_adj_close(df: DataFrame) -> DataFrame:
    """Close scaled by the product over later rows of 1 - dividend / close before, where both are positive."""
    before = F.lag("close_split").over(by_symbol())
    term = F.when((F.col("dividend") > 0) & (before > 0), 1 - F.col("dividend") / before).otherwise(1.0)
    after = by_symbol().rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("_term", term)
    return df.withColumn("adj_close", F.col("close_split") * F.coalesce(F.product("_term").over(after), F.lit(1.0))).drop("_term")


def apply_corporate_actions(df: DataFrame) -> DataFrame:
    return compute_adj_close(reconstruct_raw(df))


def adjust_for_split(positions: DataFrame) -> DataFrame:
    """shares times the ratio, cost_basis over it; a ratio that is null or not positive changes nothing."""
    r = F.when(F.col("split_ratio") > 0, F.col("split_ratio")).otherwise(1.0)
    return positions.withColumn("shares", F.col("shares") * r).withColumn("cost_basis", F.col("cost_basis") / r)


def add_adjusted_open(df: DataFrame) -> DataFrame:
    factor = F.when(F.col("close_split") > 0, F.col("adj_close") / F.col("close_split")).otherwise(1.0)
    return df.withColumn("adj_factor", factor).withColumn("adj_open", F.col("open_split") * F.col("adj_factor"))
