"""Forward labels; null at the tail of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.windows import by_symbol


def tradeable_forward_return(horizon: int = 1) -> Column:
    """Open of the next row to the open ``horizon`` rows later."""
    o = F.col("adj_open")
    return F.try_divide(F.lead(o, 1 + horizon).over(by_symbol()), F.lead(o, 1).over(by_symbol())) - 1


def research_forward_return(horizon: int = 1) -> Column:
    c = F.col("adj_close")
    return F.try_divide(F.lead(c, horizon).over(by_symbol()), c) - 1


def add_labels(df: DataFrame, horizon: int = 1) -> DataFrame:
    n = f"{horizon}d"
    df = df.withColumn(f"tradeable_return_{n}", tradeable_forward_return(horizon)).withColumn(f"research_return_{n}", research_forward_return(horizon))
    r = F.col(f"tradeable_return_{n}")
    return df.withColumn(f"tradeable_direction_{n}", F.when(r.isNotNull(), (r > 0).cast("double")))


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull())
