"""Features of (symbol, date) panels: 41 over a symbol's past, 4 across a date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.kernels import with_momentum
from panelspark.functions.windows import average_rank, by_symbol, roll
from panelspark.operators.actions import add_adjusted_open
from panelspark.operators.labels import add_labels

WARMUP = 252
YEAR = 252
PASSTHROUGH = ["date", "symbol", "open_raw", "close_raw", "volume", "dividend", "split_ratio", "adj_close", "adj_open"]
RANKED = ["return_5d", "return_20d", "volatility_20", "relative_volume_20"]


def simple_return(x: Column, n: int) -> Column:
    return F.try_divide(x, F.lag(x, n).over(by_symbol())) - 1


def log_return(x: Column, n: int = 1) -> Column:
    return F.log(F.try_divide(x, F.lag(x, n).over(by_symbol())))


def skip_momentum(x: Column, window: int, skip: int) -> Column:
    """Return from ``window`` to ``skip`` rows ago."""
    if skip >= window:
        raise ValueError("skip must be smaller than window")
    return F.try_divide(F.lag(x, skip).over(by_symbol()), F.lag(x, window).over(by_symbol())) - 1


def sma(x: Column, n: int) -> Column:
    return roll(F.avg, x, n)


def returns_block() -> dict[str, Column]:
    c, o = F.col("adj_close"), F.col("adj_open")
    out = {f"return_{n}d": simple_return(c, n) for n in (1, 2, 5, 10, 20, 60)}
    out["log_return_1d"] = log_return(c)
    out |= {f"momentum_{w}_{s}": skip_momentum(c, w, s) for w, s in ((20, 5), (60, 5), (120, 20))}
    up = F.coalesce((c > F.lag(c).over(by_symbol())).cast("double"), F.lit(0.0))
    out["up_day_ratio_20"] = roll(F.avg, up, 20)
    out["overnight_return"] = F.try_divide(o, F.lag(c).over(by_symbol())) - 1
    out["intraday_return"] = F.try_divide(c, o) - 1
    return out


def technical_block() -> dict[str, Column]:
    c = F.col("adj_close")
    out = {f"dist_sma_{n}": F.try_divide(c, sma(c, n)) - 1 for n in (20, 50, 200)}
    mid, sd = sma(c, 20), roll(F.stddev_pop, c, 20)
    out["bb_width"] = F.try_divide(4 * sd, mid)
    out["bb_position"] = F.try_divide(c - (mid - 2 * sd), 4 * sd)
    out["sma_50_over_200"] = F.try_divide(sma(c, 50), sma(c, 200)) - 1
    return out


def volatility_block() -> dict[str, Column]:
    r, o, h, lo, c = (F.col(x) for x in ("_r", "adj_open", "_h", "_l", "adj_close"))
    out = {f"volatility_{n}": roll(F.stddev_samp, r, n) * F.sqrt(F.lit(float(YEAR))) for n in (10, 20, 60)}
    hl = F.log(F.try_divide(h, lo))
    out["parkinson_vol_20"] = F.sqrt(roll(F.avg, hl * hl, 20) / (4 * F.log(F.lit(2.0)))) * F.sqrt(F.lit(float(YEAR)))
    co = F.log(F.try_divide(c, o))
    gk = roll(F.avg, 0.5 * hl * hl - (2 * F.log(F.lit(2.0)) - 1) * co * co, 20)
    out["garman_klass_vol_20"] = F.when(gk.isNotNull(), F.sqrt(F.greatest(gk, F.lit(0.0))) * F.sqrt(F.lit(float(YEAR))))
    down = F.when(r < 0, r).otherwise(0.0)
    out["downside_vol_20"] = roll(F.stddev_samp, down, 20) * F.sqrt(F.lit(float(YEAR)))
    return out


def volume_block() -> dict[str, Column]:
    v, c, r = F.col("volume").cast("double"), F.col("adj_close"), F.col("_r")
    turnover = F.log(F.nullif(v * c, F.lit(0.0)))
    return {
        "relative_volume_20": F.try_divide(v, roll(F.avg, v, 20, -1)),
        "volume_zscore_60": F.try_divide(v - roll(F.avg, v, 60, -1), roll(F.stddev_samp, v, 60, -1)),
        "log_turnover": turnover,
        "turnover_trend_20": turnover - roll(F.avg, turnover, 20),
        "volume_direction_20": F.try_divide(roll(F.sum, F.signum(r) * v, 20), roll(F.sum, v, 20)),
    }


def regime_block() -> dict[str, Column]:
    c, vol = F.col("adj_close"), F.col("volatility_20")
    fast, slow = sma(c, 50), sma(c, 200)
    ever = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(c.alias("c"), (-F.col("_no")).alias("no"))).over(by_symbol().rowsBetween(-(YEAR - 1), 0))
    z = F.try_divide(vol - F.avg(vol).over(ever), F.stddev_samp(vol).over(ever))
    return {
        "trend_regime": F.when(fast.isNull() | slow.isNull(), None).when((fast > slow) & (c > slow), 1.0).when((fast < slow) & (c < slow), -1.0).otherwise(0.0),
        "drawdown_from_peak": F.try_divide(c, F.max(c).over(ever)) - 1,
        "days_since_high_252": F.when(F.count(c).over(by_symbol().rowsBetween(-(YEAR - 1), 0)) == YEAR, (F.col("_no") + best["no"]).cast("double")),
        "vol_zscore_expanding": F.when(F.count(vol).over(ever) >= YEAR, z),
    }


def window_features(bars: DataFrame) -> DataFrame:
    """The features of enriched bars that windows express, and _tr. All share one sort by (symbol, date); no row sees a later one.

    Features that a query doesn't select are pruned from its plan.
    """
    df = add_adjusted_open(bars)
    h, lo = F.col("high_split") * F.col("adj_factor"), F.col("low_split") * F.col("adj_factor")
    before = F.lag("adj_close").over(by_symbol())
    df = df.withColumns({"_h": h, "_l": lo, "_no": F.row_number().over(by_symbol()), "_r": simple_return(F.col("adj_close"), 1)})
    df = df.withColumn("_tr", F.greatest(F.col("_h") - F.col("_l"), F.abs(F.col("_h") - before), F.abs(F.col("_l") - before)))
    df = df.withColumns(returns_block() | technical_block() | volatility_block() | volume_block())
    df = df.withColumn("vol_ratio_10_60", F.try_divide("volatility_10", "volatility_60"))
    return df.withColumns(regime_block()).drop("_h", "_l", "_no", "_r")


def symbol_features(bars: DataFrame) -> DataFrame:
    """All 41 features of enriched bars: those of windows, then those of the recursive kernels."""
    return with_momentum(window_features(bars))


def trim_warmup(df: DataFrame, sessions: int = WARMUP) -> DataFrame:
    """df without the first rows of each symbol."""
    return df.withColumn("_no", F.row_number().over(by_symbol())).filter(F.col("_no") > sessions).drop("_no")


def add_cross_sectional(panel: DataFrame, columns: list[str] = RANKED) -> DataFrame:
    """xs_rank_*: average rank over the non-null count within a date; null where the date has one symbol."""
    day = Window.partitionBy("date")
    ranks = {f"xs_rank_{c}": F.when(F.count(F.lit(1)).over(day) > 1, average_rank(F.col(c), ["date"]) / F.count(c).over(day)) for c in columns}
    return panel.withColumns(ranks)


def build_panel(bars: DataFrame, horizon: int = 1, sessions: int = WARMUP) -> DataFrame:
    """Features and labels of enriched bars, without warm-up rows. Two shuffles: by symbol, then by date."""
    return add_cross_sectional(trim_warmup(add_labels(symbol_features(bars), horizon), sessions))


def feature_names(panel: DataFrame) -> list[str]:
    known = set(PASSTHROUGH) | {"open_split", "high_split", "low_split", "close_split", "high_raw", "low_raw", "split_factor", "adj_factor"}
    return [c for c in panel.columns if c not in known and not c.startswith(("tradeable_", "research_"))]


def coverage_report(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing_rate, n_unique), worst first, in one pass."""
    row = panel.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in columns], *[F.count_distinct(c).alias(f"u_{c}") for c in columns])
    stacked = "stack(" + str(len(columns)) + ", " + ", ".join(f"'{c}', m_{c}, u_{c}" for c in columns) + ") as (feature, missing_rate, n_unique)"
    return row.selectExpr(stacked).orderBy(F.desc("missing_rate"), "feature")


def session_features(bars: DataFrame) -> DataFrame:
    """Eight features of as-is bars for the next session, and its open-to-close return as target."""
    w = by_symbol()
    c, o, h, lo = F.col("close"), F.col("open"), F.col("high"), F.col("low")
    r = F.try_divide(c, F.lag(c).over(w)) - 1
    df = bars.withColumn("return_1", r)
    out = {f"return_{n}": F.try_divide(c, F.lag(c, n).over(w)) - 1 for n in (5, 20)}
    out |= {"session_return": F.try_divide(c, o) - 1, "range": F.try_divide(h - lo, c), "gap": F.try_divide(o, F.lag(c).over(w)) - 1, "volatility": roll(F.stddev_samp, F.col("return_1"), 20), "close_position": F.try_divide(c - lo, h - lo)}
    return df.withColumns(out).withColumn("target", F.try_divide(F.lead(c).over(w), F.lead(o).over(w)) - 1)


def causality_violations(bars: DataFrame, build: Callable[[DataFrame], DataFrame], columns: list[str], cut, scale: float = 1.7, tolerance: float = 1e-9) -> DataFrame:
    """(feature, n) of values before the cut that change when later bars do; empty where all features are causal.

    build gives features per symbol and date from enriched bars. Prices from the
    cut on are scaled by a factor that differs from day to day.
    """
    late = F.col("date") >= F.lit(cut)
    factor = F.when(late, scale + (F.pmod(F.hash("date"), F.lit(7)) / 10.0)).otherwise(1.0)
    moved = bars.withColumns({c: F.col(c) * factor for c in ("open_split", "high_split", "low_split", "close_split", "adj_close")}).withColumn("volume", F.when(late, F.col("volume") + 7).otherwise(F.col("volume")))
    early = lambda df, name: build(df).filter(~late).select("symbol", "date", F.struct(*columns).alias(name))
    both = early(bars, "_a").join(early(moved, "_b"), ["symbol", "date"])

    def changed(c: str) -> Column:
        a, b = F.col(f"_a.{c}").cast("double"), F.col(f"_b.{c}").cast("double")
        return (~(a.isNull().eqNullSafe(b.isNull()))) | F.coalesce(F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.lit(1.0)), F.lit(False))

    counts = both.agg(*[F.sum(changed(c).cast("long")).alias(c) for c in columns])
    stacked = counts.selectExpr(f"stack({len(columns)}, {', '.join(f"'{c}', {c}" for c in columns)}) as (feature, n)")
    return stacked.filter("n > 0")
