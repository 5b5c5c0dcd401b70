"""Portfolios from weights and fills: returns, ledgers, and two ways to the same equity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.calendar import session_index
from panelspark.operators.decisions import COSTS_BPS, PER_SIDE
from panelspark.sources.tables import settled

YEAR = 252
FLAT = 1e-9
#: Part of the cash that is invested.
INVESTED = 0.999


def target_weights(panel: DataFrame) -> DataFrame:
    """panel plus weight: the last non-null target before the row's session, 0 before any."""
    w = Window.partitionBy("symbol").orderBy("date")
    carried = F.last("target_weight", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return panel.withColumn("weight", F.coalesce(carried, F.lit(0.0)))


def strategy_returns(weights: DataFrame, ret: str = "ret") -> DataFrame:
    """(date, gross, commission, spread, slippage, net, turnover, exposure, equity, total_costs), one row a date.

    Each symbol's change of weight is traded at the cost of its side. Equity is
    a running product over dates, after the sums over symbols.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    change = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    day = weights.withColumn("_d", change).groupBy("date").agg(F.sum(F.col("weight") * F.coalesce(F.col(ret), F.lit(0.0))).alias("gross"), F.sum("_d").alias("turnover"), F.sum("weight").alias("exposure"))
    day = day.withColumns({k: F.col("turnover") * v / 1e4 for k, v in COSTS_BPS.items()})
    day = day.withColumn("net", F.col("gross") - F.col("turnover") * PER_SIDE)
    every = Window.orderBy("date")
    return day.withColumns({"equity": F.product(1 + F.col("net")).over(every), "total_costs": F.sum(F.col("turnover") * PER_SIDE).over(every)})


def with_split_product(bars: DataFrame) -> DataFrame:
    """bars plus split_product: the product of the symbol's split ratios up to the day, its own included."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("split_product", F.product(F.coalesce("split_ratio", F.lit(1.0))).over(w))


def position_ledger(fills: DataFrame) -> DataFrame:
    """fills plus shares and cost_basis after each, episode, and realised on sells.

    fills has symbol, seq, side, shares_filled, price and split_ratio, the
    product of ratios up to the fill since some day before the symbol's first.
    Shares are counted in units of that day, so splits need no restating of
    earlier rows. A buy adds its cost to that of the shares held, a sale takes
    its part of it; within an episode (from flat to flat) that recursion is a
    running product of what sales leave, and a running sum over it. A sale may
    not exceed what is held.
    """
    w = Window.partitionBy("symbol").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    k = F.coalesce(F.col("split_ratio"), F.lit(1.0))
    buy = F.col("side") == "BUY"
    df = fills.withColumn("_u", F.col("shares_filled") / k).withColumn("_s", F.when(buy, F.col("_u")).otherwise(-F.col("_u")))
    df = df.withColumn("_held", F.sum("_s").over(run))
    flat = F.abs("_held") < FLAT
    df = df.withColumn("episode", F.coalesce(F.sum((~buy & flat).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = Window.partitionBy("symbol", "episode").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    left = F.when(buy | flat, 1.0).otherwise(F.col("_held") / (F.col("_held") + F.col("_u")))
    df = df.withColumn("_left", F.product(left).over(e))
    df = df.withColumn("_paid", F.col("_left") * F.sum(F.when(buy, F.col("shares_filled") * F.col("price") / F.col("_left")).otherwise(0.0)).over(e))
    before = F.lag("_paid").over(Window.partitionBy("symbol", "episode").orderBy("seq"))
    realised = F.when(~buy, F.col("shares_filled") * F.col("price") - F.col("_u") * before / (F.col("_held") + F.col("_u")))
    out = {"shares": F.when(flat, 0.0).otherwise(F.col("_held") * k), "cost_basis": F.when(flat, 0.0).otherwise(F.col("_paid") / F.col("_held") / k), "realised": realised}
    return df.withColumns(out).drop("_u", "_s", "_held", "_left", "_paid")


def snapshots(ledger: DataFrame, closes: DataFrame, initial: float) -> DataFrame:
    """(date, cash, holdings, equity, exposure, unrealised, realised, dividends, total_costs, n_positions) for every date of closes.

    closes has symbol, date, close and, where there are any, dividend (a share)
    and split_product, as the ledger's split_ratio. A position is as the last
    fill up to the day left it, splits since then applied. A dividend goes to
    what was held before the day's fills. On a day without a row of a symbol
    its last close counts. Fills are of dates that closes has.
    """
    k = F.coalesce(F.col("split_ratio"), F.lit(1.0))
    state = F.struct((F.col("shares") / k).alias("units"), (F.col("cost_basis") * k).alias("basis"), k.alias("k"))
    after = ledger.groupBy("symbol", "date").agg(F.max_by(state, "seq").alias("_after"))
    have = lambda c, other: (F.col(c) if c in closes.columns else F.lit(other)).cast("double").alias(c)
    days = closes.select("symbol", "date", F.col("close").cast("double").alias("close"), have("dividend", 0.0), have("split_product", None)).join(after, ["symbol", "date"], "full")
    index = session_index(closes)
    w = Window.partitionBy("symbol").orderBy("date")
    last = lambda c, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    end = index.agg(F.max("session_idx").alias("_end"))
    days = days.join(index, "date").crossJoin(F.broadcast(end)).withColumns({"_now": last("_after", 0), "_before": last("_after", -1), "_close": last("close", 0), "_until": F.coalesce(F.lead("session_idx").over(w) - 1, F.col("_end"))})
    shares = lambda s: F.col(f"{s}.units") * F.coalesce("split_product", f"{s}.k")
    cost = F.col("_now.units") * F.col("_now.basis")
    value = F.coalesce(shares("_now") * F.col("_close"), cost)
    held = days.filter(F.abs("_now.units") > FLAT).select(value.alias("value"), (value - cost).alias("gain"), F.explode(F.sequence("session_idx", "_until")).alias("session_idx"))
    values = held.groupBy("session_idx").agg(F.sum("value").alias("holdings"), F.sum("gain").alias("unrealised"), F.count(F.lit(1)).alias("n_positions"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    paid = days.groupBy("session_idx").agg(F.sum(shares("_before") * F.greatest(zero(F.col("dividend")), F.lit(0.0))).alias("_d"))
    flow = F.when(F.col("side") == "BUY", -F.col("shares_filled") * F.col("price")).otherwise(F.col("shares_filled") * F.col("price"))
    flows = ledger.groupBy("date").agg(F.sum(flow - F.col("total_cost")).alias("_f"), F.sum(zero(F.col("realised"))).alias("_r"), F.sum("total_cost").alias("_c"))
    total = lambda c: F.sum(zero(F.col(c))).over(Window.orderBy("session_idx"))
    out = index.join(values, "session_idx", "left").join(paid, "session_idx", "left").join(flows, "date", "left")
    out = out.withColumns({"holdings": zero(F.col("holdings")), "unrealised": zero(F.col("unrealised")), "n_positions": F.coalesce("n_positions", F.lit(0)), "dividends": total("_d"), "realised": total("_r"), "total_costs": total("_c"), "cash": F.lit(float(initial)) + total("_f") + total("_d")})
    out = out.withColumn("equity", F.col("cash") + F.col("holdings")).withColumn("exposure", F.coalesce(F.try_divide("holdings", "equity"), F.lit(0.0)))
    return out.select("date", "cash", "holdings", "equity", "exposure", "unrealised", "realised", "dividends", "total_costs", "n_positions")


def equity_both_ways(daily: DataFrame, initial: float) -> DataFrame:
    """daily plus from_profits, initial + realised + unrealised + dividends - costs, and the difference of equity from it."""
    other = F.lit(float(initial)) + F.col("realised") + F.col("unrealised") + F.col("dividends") - F.col("total_costs")
    return daily.withColumn("from_profits", other).withColumn("difference", F.col("equity") - other)


def reconcile(daily: DataFrame, initial: float, tolerance: float = 0.01) -> DataFrame:
    """Dates on which cash + holdings differ from initial + realised + unrealised + dividends - costs."""
    return equity_both_ways(daily, initial).filter(F.abs("difference") > tolerance)


def same_session_executions(fills: DataFrame) -> DataFrame:
    return fills.filter(F.col("decision_date") >= F.col("execution_date"))


def equal_weight_fills(bars: DataFrame, capital: float, every: int | None = None) -> DataFrame:
    """(symbol, date, seq, side, shares_filled, price, split_ratio, total_cost) of an equal-weight portfolio.

    Bought at the opens of the second session, and with ``every`` sold and
    bought again at the opens of each session that many later. Whole shares of
    0.999 of an equal part of the cash at hand, symbol by symbol, as long as the
    cash pays for them. A symbol without an open then keeps what it has. bars
    has symbol, date and open, as traded, and may have dividend and
    split_product. How much is bought depends on all that came before, so the
    rows of rebalancing days, one for each symbol, are folded in one task: one
    of ``every`` rows of the panel. Between them nothing is traded.
    """
    have = lambda c, other: F.coalesce(F.col(c).cast("double"), F.lit(other)) if c in bars.columns else F.lit(other)
    step = F.ceil((F.col("session_idx") - 1) / every).cast("int") if every else F.when(F.col("session_idx") <= 1, 0)
    at = F.col("session_idx") == (F.col("_step") * every + 1 if every else F.lit(1))
    day = bars.join(session_index(bars), "date").withColumn("_step", step).filter("_step is not null").withColumns({"_at": at, "_k": have("split_product", 1.0), "_d": have("dividend", 0.0)})
    priced = F.col("_at") & (F.col("open") > 0)
    pick = lambda c: F.max(F.when(priced, F.col(c))).alias(c)
    rows = day.groupBy("symbol", "_step").agg(pick("date"), pick("open"), pick("_k"), F.sum(F.greatest(F.col("_d"), F.lit(0.0)) * F.col("_k")).alias("_d"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, units, out = float(capital), {}, []
        for step, rows in pdf.sort_values(["_step", "symbol"]).groupby("_step"):
            cash += sum(units.get(s, 0.0) * d for s, d in zip(rows["symbol"], rows["_d"], strict=True))
            rows = rows[rows["open"].notna()]
            for s, day, price, k in zip(rows["symbol"], rows["date"], rows["open"], rows["_k"], strict=True):
                if held := units.pop(s, 0.0) * k:
                    cash += held * price * (1 - PER_SIDE)
                    out.append((s, day, 2 * int(step), "SELL", held, price, k))
            part = 1.0 / max(1, len(rows)) * cash * INVESTED
            for s, day, price, k in zip(rows["symbol"], rows["date"], rows["open"], rows["_k"], strict=True):
                shares = math.floor(part / price)
                if shares > 0 and shares * price * (1 + PER_SIDE) <= cash:
                    cash -= shares * price * (1 + PER_SIDE)
                    units[s] = shares / k
                    out.append((s, day, 2 * int(step) + 1, "BUY", float(shares), price, k))
        return pd.DataFrame(out, columns=["symbol", "date", "seq", "side", "shares_filled", "price", "split_ratio"])

    fills = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fold, "symbol string, date date, seq int, side string, shares_filled double, price double, split_ratio double")
    return fills.withColumn("total_cost", F.col("shares_filled") * F.col("price") * PER_SIDE)


def book(fills: DataFrame, bars: DataFrame, capital: float) -> tuple[DataFrame, DataFrame]:
    """(ledger, snapshots) of fills; bars has close, as traded, and may have dividend and split_product."""
    ledger = settled(position_ledger(fills))
    return ledger, snapshots(ledger, bars, capital)


def drawdowns(curve: DataFrame) -> DataFrame:
    """(name, max_drawdown, longest_underwater) of equity curves (name, date, equity)."""
    w = Window.partitionBy("name").orderBy("date")
    df = curve.withColumn("_peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_under", F.col("equity") < F.col("_peak")).withColumn("_run", F.sum((~F.col("_under")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy("name", "_run").agg(F.sum(F.col("_under").cast("long")).alias("k"), F.min(F.col("equity") / F.col("_peak") - 1).alias("d"))
    return runs.groupBy("name").agg(F.min("d").alias("max_drawdown"), F.max("k").alias("longest_underwater"))


def performance_metrics(curve: DataFrame, fills: DataFrame | None = None, capital: float | None = None) -> DataFrame:
    """One row for each name of (name, date, equity, exposure), with the figures of its fills where there are any.

    Years are sessions over 252, and so is what the error of the Sharpe ratio
    counts. Sharpe and Sortino are 0 where there are fewer than two returns
    (losses, for the second) or they don't vary. With a column total_costs,
    costs so far, there are total_costs, cost_drag (over ``capital``, or else
    the first equity) and gross_return_required to break even. fills has name
    and what a ledger has, realised included; a round trip ends with a sale.
    """
    w = Window.partitionBy("name").orderBy("date")
    df = curve.withColumn("_r", F.try_divide("equity", F.lag("equity").over(w)) - 1)
    down, root = F.when(F.col("_r") < 0, F.col("_r")), float(YEAR) ** 0.5
    ratio = lambda x: F.coalesce(F.when(F.stddev_samp(x) > 0, F.avg("_r") / F.stddev_samp(x)), F.lit(0.0)) * root
    aggs = {
        "n_sessions": F.count(F.lit(1)),
        "initial_equity": F.min_by("equity", "date"),
        "final_equity": F.max_by("equity", "date"),
        "annual_volatility": F.coalesce(F.stddev_samp("_r"), F.lit(0.0)) * root,
        "sharpe": ratio("_r"),
        "sortino": ratio(down),
        "win_rate": F.coalesce(F.avg((F.col("_r") > 0).cast("double")), F.lit(0.0)),
        "mean_exposure": F.avg("exposure") if "exposure" in curve.columns else F.lit(0.0),
    }
    aggs |= {"turnover": F.sum("turnover")} if "turnover" in curve.columns else {}
    aggs |= {"total_costs": F.max_by("total_costs", "date")} if "total_costs" in curve.columns else {}
    out = df.groupBy("name").agg(*[v.alias(k) for k, v in aggs.items()])
    years, start, own = F.col("n_sessions") / YEAR, F.col("initial_equity"), F.lit(float(capital)) if capital else F.col("initial_equity")
    out = out.withColumns({"years": years, "total_return": F.when(start != 0, F.col("final_equity") / start - 1).otherwise(0.0), "cagr": F.when(start > 0, F.pow(F.col("final_equity") / start, 1 / years) - 1).otherwise(0.0), "sharpe_stderr": F.sqrt(1 / years)})
    if "total_costs" in curve.columns:
        out = out.withColumn("cost_drag", F.coalesce(F.try_divide("total_costs", own), F.lit(0.0))).withColumn("gross_return_required", F.col("total_return") + F.col("cost_drag"))
    out = out.join(drawdowns(curve), "name")
    if fills is None:
        return out
    notional, sale = F.col("shares_filled") * F.col("price"), F.col("side") == "SELL"
    trips = F.count(F.when(sale, 1))
    traded = fills.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_fills"),
        trips.alias("n_round_trips"),
        F.sum(notional).alias("total_notional"),
        F.when(trips > 0, F.count(F.when(sale & (F.col("realised") > 0), 1)) / trips).alias("trade_win_rate"),
        F.when(trips > 0, F.avg("total_cost")).alias("mean_cost_per_fill"),
        *[F.sum(notional * bps / 1e4).alias(f"total_{c}") for c, bps in COSTS_BPS.items()],
    )
    return out.join(traded, "name", "left").withColumn("annual_turnover", F.try_divide("total_notional", own * F.col("years")))


def cost_totals(daily: DataFrame) -> DataFrame:
    """(component, total) of strategy_returns' costs."""
    long = daily.selectExpr(f"stack({len(COSTS_BPS)}, {', '.join(f"'{c}', {c}" for c in COSTS_BPS)}) as (component, cost)")
    return long.groupBy("component").agg(F.sum("cost").alias("total"))
