"""Trading sessions as tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# National holidays on fixed days (month * 100 + day).
HOLIDAYS = (126, 501, 815, 1002, 1225)


def sessions(spark: SparkSession, start: date, end: date, holidays: DataFrame | None = None) -> DataFrame:
    """(date): weekdays from start to end without fixed holidays, nor those of the table (date) given."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")) if start <= end else spark.createDataFrame([], "date date")
    days = days.filter(~F.dayofweek("date").isin(1, 7) & ~(F.month("date") * 100 + F.dayofmonth("date")).isin(*HOLIDAYS))
    return days if holidays is None else days.join(holidays.select("date"), "date", "left_anti")


def is_session(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days plus is_session."""
    known = calendar.select("date", F.lit(True).alias("_yes")).distinct()
    return days.join(known, "date", "left").withColumn("is_session", F.coalesce("_yes", F.lit(False))).drop("_yes")


def next_session(days: DataFrame, calendar: DataFrame, lookahead: int = 10) -> DataFrame:
    """days plus next_session: the first session after the date within ``lookahead`` days, else null.

    The calendar is exploded backwards to the days that may look ahead to a
    session, so the forward as-of join is an equi-join on the day.
    """
    back = calendar.select(F.col("date").alias("_s"), F.explode(F.sequence(F.lit(1), F.lit(lookahead))).alias("_k"))
    ahead = back.select(F.expr("date_sub(_s, _k)").alias("date"), "_s").groupBy("date").agg(F.min("_s").alias("next_session"))
    return days.join(ahead, "date", "left")


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, date): sessions between a symbol's first and last bar without a bar."""
    span = bars.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    due = span.select("symbol", F.explode(F.sequence("_a", "_b")).alias("date")).join(calendar.select("date"), "date", "left_semi")
    return due.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti").select("symbol", "date")


def unexpected_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    return bars.join(calendar.select("date"), "date", "left_anti").select("symbol", "date")


def session_index(df: DataFrame) -> DataFrame:
    """(date, session_idx): the distinct dates of df numbered from 0. One row for each date."""
    return df.select("date").distinct().withColumn("session_idx", F.row_number().over(Window.orderBy("date")) - 1)
