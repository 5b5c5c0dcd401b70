"""Data-quality checks: each reports issue rows, none repairs.

An issue is (severity, code, symbol, issue_date, n): n counts what was found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import by_symbol
from panelspark.operators.calendar import missing_sessions, unexpected_sessions

JUMP_WARNING, JUMP_ERROR, LARGE_DIVIDEND = 0.20, 0.50, 0.25
STALE_REPEATS = 4
PRICES = ["open_split", "high_split", "low_split", "close_split"]


def _issue(df: DataFrame, severity, code, date=None, n=None) -> DataFrame:
    column = lambda x: x if not isinstance(x, str) else F.lit(x)
    return df.select(column(severity).alias("severity"), column(code).alias("code"), "symbol", (F.lit(None) if date is None else F.col(date)).cast("date").alias("issue_date"), (F.lit(1) if n is None else F.col(n)).cast("long").alias("n"))


def no_data(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return _issue(universe.select("symbol").join(bars.select("symbol"), "symbol", "left_anti"), "ERROR", "NO_DATA")


def not_sorted(bars: DataFrame, seq_col: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(seq_col)
    late = bars.withColumn("_before", F.lag("date").over(w)).filter("_before > date").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return _issue(late, "ERROR", "NOT_SORTED", n="n")


def duplicate_dates(bars: DataFrame) -> DataFrame:
    found = bars.groupBy("symbol", "date").count().filter("count > 1").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return _issue(found, "ERROR", "DUPLICATE_DATES", n="n")


def bar_checks(bars: DataFrame) -> DataFrame:
    """INVALID_PRICE for each column, the five bounds, volumes and large dividends, in one pass over the bars."""
    p = {c: F.col(c) for c in PRICES}
    hi, lo, op, cl = p["high_split"], p["low_split"], p["open_split"], p["close_split"]
    tests = [("ERROR", f"INVALID_PRICE:{c}", x.isNull() | (x <= 0)) for c, x in p.items()]
    tests += [("ERROR", "HIGH_BELOW_LOW", hi < lo), ("ERROR", "HIGH_BELOW_OPEN", hi < op), ("ERROR", "HIGH_BELOW_CLOSE", hi < cl), ("ERROR", "LOW_ABOVE_OPEN", lo > op), ("ERROR", "LOW_ABOVE_CLOSE", lo > cl)]
    v = F.col("volume")
    tests += [("ERROR", "NEGATIVE_VOLUME", v < 0), ("WARNING", "ZERO_VOLUME", v == 0), ("WARNING", "LARGE_DIVIDEND", (F.col("dividend") > 0) & (F.try_divide("dividend", cl) > LARGE_DIVIDEND))]
    tests += [("ERROR", "INVALID_SPLIT", (F.col("split_ratio") <= 0) | ~F.col("split_ratio").between(0.01, 100)), ("ERROR", "NEGATIVE_DIVIDEND", F.col("dividend") < 0)]
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, t in tests]))
    found = bars.select("symbol", "date", F.explode(hits).alias("h")).groupBy("symbol", F.col("h.severity").alias("s"), F.col("h.code").alias("c")).agg(F.min("date").alias("d"), F.count(F.lit(1)).alias("n"))
    return _issue(found, F.col("s"), F.col("c"), "d", "n")


def move_checks(bars: DataFrame) -> DataFrame:
    """ABNORMAL_JUMP without a split on the row or the next; splits that reconcile or don't."""
    w = by_symbol()
    move = F.abs(F.try_divide("close_split", F.lag("close_split").over(w)) - 1)
    df = bars.select("symbol", "date", (F.col("split_ratio") != 1).alias("_s"), move.alias("_m"), F.coalesce(F.lead("split_ratio").over(w) != 1, F.lit(False)).alias("_n"))
    jump = df.filter((F.col("_m") > JUMP_WARNING) & ~F.col("_s") & ~F.col("_n"))
    jumps = _issue(jump, F.when(F.col("_m") > JUMP_ERROR, "ERROR").otherwise("WARNING"), "ABNORMAL_JUMP", "date")
    split = df.filter(F.col("_s") & F.col("_m").isNotNull())
    apart = F.col("_m") > JUMP_WARNING
    return jumps.unionByName(_issue(split, F.when(apart, "ERROR").otherwise("INFO"), F.when(apart, "SPLIT_RECONCILIATION").otherwise("SPLIT_APPLIED"), "date"))


def stale_prices(bars: DataFrame) -> DataFrame:
    """The longest run of closes that repeat, where it has ``STALE_REPEATS`` repeats or more; n counts its rows."""
    w = by_symbol()
    a, b = F.col("close_split"), F.lag("close_split").over(w)
    same = F.coalesce(F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b), F.lit(False))
    df = bars.select("symbol", "date", same.alias("_same"))
    df = df.withColumn("_run", F.sum((~F.col("_same")).cast("int")).over(w))
    runs = df.filter("_same").groupBy("symbol", "_run").agg(F.count(F.lit(1)).alias("k")).groupBy("symbol").agg((F.max("k") + 1).alias("n"))
    enough = bars.groupBy("symbol").count().filter("count >= 5").select("symbol")
    return _issue(runs.filter(F.col("n") > STALE_REPEATS).join(enough, "symbol", "left_semi"), "WARNING", "STALE_PRICES", n="n")


def calendar_checks(bars: DataFrame, calendar: DataFrame, exact: bool = True) -> DataFrame:
    count = lambda df: df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    out = _issue(count(missing_sessions(bars, calendar)), "WARNING" if exact else "INFO", "MISSING_SESSIONS", n="n")
    return out.unionByName(_issue(count(unexpected_sessions(bars, calendar)), "WARNING", "UNEXPECTED_SESSIONS", n="n")) if exact else out


def validate_bars(bars: DataFrame, calendar: DataFrame | None = None, universe: DataFrame | None = None, seq_col: str | None = None, exact: bool = True) -> DataFrame:
    parts = [duplicate_dates(bars), bar_checks(bars), move_checks(bars), stale_prices(bars)]
    parts += [calendar_checks(bars, calendar, exact)] if calendar is not None else []
    parts += [no_data(bars, universe)] if universe is not None else []
    parts += [not_sorted(bars, seq_col)] if seq_col else []
    return reduce(DataFrame.unionByName, parts)


def severity_rollup(issues: DataFrame) -> DataFrame:
    """(symbol, errors, warnings, infos, ok) for each symbol with issues."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return issues.groupBy("symbol").agg(n("ERROR").alias("errors"), n("WARNING").alias("warnings"), n("INFO").alias("infos")).withColumn("ok", F.col("errors") == 0)


def quarantine(bars: DataFrame, issues: DataFrame) -> DataFrame:
    """Bars of symbols without an ERROR."""
    return bars.join(issues.filter("severity = 'ERROR'").select("symbol").distinct(), "symbol", "left_anti")


def persistable(issues: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Warnings and errors with created_at, the time they are stored at: now, unless told."""
    return issues.filter("severity <> 'INFO'").withColumn("created_at", F.current_timestamp() if created_at is None else created_at.cast("timestamp"))


def open_counts(issues: DataFrame, since=None) -> DataFrame:
    """(severity, n) of stored issues, of those stored from ``since`` on. Whether an issue is of a date doesn't matter: many have none."""
    df = issues if since is None else issues.filter(F.col("created_at") >= F.lit(since))
    return df.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
