"""Queries over portfolios with fills, splits and dividends, whose SQL passes over the fills one by one; and over ticks by blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import blocks
from panelspark.functions.windows import by_symbol
from panelspark.operators import portfolio
from panelspark.operators.decisions import PER_SIDE
from panelspark.plans import panel, sql
from panelspark.plans.panel import register, rounded
from panelspark.sources import tables

CAPITAL = 1e6
#: What a symbol trades at every 20th of its bars, in shares of its first day: two buys, a part sold, a buy, all sold, nothing.
SCHEDULE = (100.0, 50.0, -60.0, 30.0, -120.0, 0.0)
COST = f"{PER_SIDE}::DOUBLE"


def traded_bars(spark, d):
    """Bars at prices as traded, with the splits so far."""
    return portfolio.with_split_product(panel.enriched(spark, d)).select("symbol", "date", F.col("open_raw").alias("open"), F.col("close_raw").alias("close"), "dividend", "split_ratio", "split_product")


def scheduled_fills(bars):
    b = bars.withColumn("no", F.row_number().over(by_symbol()) - 1).filter("no % 20 = 0")
    units = F.get(F.array(*[F.lit(x) for x in SCHEDULE]), (F.col("no") / 20 % len(SCHEDULE)).cast("int"))
    f = b.withColumn("_u", units).filter("_u <> 0").withColumn("shares_filled", F.abs("_u") * F.col("split_product"))
    f = f.select("symbol", "date", F.col("no").alias("seq"), F.when(F.col("_u") > 0, "BUY").otherwise("SELL").alias("side"), "shares_filled", F.col("open").alias("price"), F.col("split_product").alias("split_ratio"))
    return f.withColumn("total_cost", F.col("shares_filled") * F.col("price") * PER_SIDE)


_TRADED = f"SELECT *, product(split_ratio) OVER ({sql.W} ROWS UNBOUNDED PRECEDING) AS k, row_number() OVER ({sql.W}) - 1 AS no FROM enriched"
_SCHEDULED = f"SELECT symbol, date, no, row_number() OVER ({sql.W}) AS j, u, k, open_raw AS price, abs(u) * k AS shares FROM (SELECT *, [{', '.join(f'{x}::DOUBLE' for x in SCHEDULE)}][no // 20 % {len(SCHEDULE)} + 1] AS u FROM traded WHERE no % 20 = 0) WHERE u <> 0"
#: Units held and their cost after each fill of a symbol, one fill after the other.
_PASS = """SELECT symbol, date, no, j, u, k, price, shares, u AS held, shares * price AS paid, 0.0::DOUBLE AS realised FROM scheduled WHERE j = 1
  UNION ALL SELECT s.symbol, s.date, s.no, s.j, s.u, s.k, s.price, s.shares, p.held + s.u, CASE WHEN s.u > 0 THEN p.paid + s.shares * s.price WHEN p.held + s.u = 0 THEN 0 ELSE p.paid * (p.held + s.u) / p.held END,
    CASE WHEN s.u < 0 THEN s.shares * s.price + s.u * p.paid / p.held ELSE 0 END FROM pass p JOIN scheduled s ON s.symbol = p.symbol AND s.j = p.j + 1"""
_FLOWS = f"SELECT date, sum(CASE WHEN u > 0 THEN -shares * price ELSE shares * price END - shares * price * {COST}) AS f, sum(realised) AS r, sum(shares * price * {COST}) AS c FROM pass GROUP BY date"
#: What a symbol has on each session: its position as of the day, at its last close.
_MARKED = "SELECT d.date, t.symbol, t.close_raw * t.k * p.held AS worth, t.close_raw * t.k * p.held - p.paid AS gain, p.held FROM (SELECT DISTINCT date, symbol FROM (SELECT DISTINCT date FROM bars), (SELECT DISTINCT symbol FROM bars)) d ASOF JOIN traded t ON t.symbol = d.symbol AND d.date >= t.date ASOF JOIN pass p ON p.symbol = d.symbol AND d.date >= p.date"
_DIVIDENDS = "SELECT t.date, sum(t.dividend * t.k * p.held) AS paid FROM traded t ASOF JOIN pass p ON p.symbol = t.symbol AND t.date > p.date GROUP BY t.date"
_SNAPSHOT = """SELECT *, cash + holdings AS equity, holdings / (cash + holdings) AS exposure FROM (SELECT d.date, 1e6 + sum(coalesce(f, 0) + coalesce(v.paid, 0)) OVER (ORDER BY d.date) AS cash, coalesce(sum(v.paid) OVER (ORDER BY d.date), 0) AS dividends,
  coalesce(sum(c) OVER (ORDER BY d.date), 0) AS total_costs, coalesce(sum(r) OVER (ORDER BY d.date), 0) AS realised, coalesce(m.holdings, 0) AS holdings, coalesce(m.unrealised, 0) AS unrealised, coalesce(m.n, 0) AS n_positions
  FROM (SELECT DISTINCT date FROM bars) d LEFT JOIN flows USING (date) LEFT JOIN dividends v ON v.date = d.date LEFT JOIN (SELECT date, sum(worth) AS holdings, sum(gain) AS unrealised, count(*) FILTER (held > 0) AS n FROM marked GROUP BY date) m ON m.date = d.date)"""


def recursive_query(body: str, *names: str, **more: str) -> str:
    return "WITH RECURSIVE" + sql.query(body, *names, **more).removeprefix("WITH")


_BOOK = {"traded": _TRADED, "scheduled": _SCHEDULED, "pass": _PASS, "flows": _FLOWS, "marked": _MARKED, "dividends": _DIVIDENDS, "snapshot": _SNAPSHOT}


def scheduled_book(spark, d):
    """Ledger and days; the bars are settled, as both read them several times."""
    bars = tables.settled(traded_bars(spark, d))
    return portfolio.book(scheduled_fills(bars), bars, CAPITAL)


@register("l3_ledger", recursive_query("SELECT symbol, date, CASE WHEN u > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(held * k, 6) + 0.0 AS shares, round(CASE WHEN held > 0 THEN paid / held / k ELSE 0 END, 6) + 0.0 AS cost_basis, round(CASE WHEN u < 0 THEN realised END, 6) + 0.0 AS realised FROM pass", "enriched", traded=_TRADED, scheduled=_SCHEDULED, **{"pass": _PASS}))
def l3(spark, d):
    return rounded(portfolio.position_ledger(scheduled_fills(traded_bars(spark, d))), ["shares", "cost_basis", "realised"], ("symbol", "date", "side"))


_MONEY = ["cash", "total_costs", "holdings", "equity", "realised", "unrealised", "dividends"]


@register("l4_snapshots", recursive_query(f"SELECT date, n_positions, {sql.rounded(_MONEY, 4)}, round(exposure, 6) + 0.0 AS exposure FROM snapshot", "enriched", **_BOOK))
def l4(spark, d):
    daily = scheduled_book(spark, d)[1].withColumn("exposure", F.round("exposure", 6) + 0.0)
    return rounded(daily, _MONEY, ("date", "n_positions", "exposure"), 4)


@register("l5_reconciliation", recursive_query("SELECT date, round(equity, 4) AS equity, round(1e6 + realised + unrealised + dividends - total_costs, 4) AS from_profits, abs(equity - (1e6 + realised + unrealised + dividends - total_costs)) <= 0.01 AS agrees FROM snapshot", "enriched", **_BOOK))
def l5(spark, d):
    both = portfolio.equity_both_ways(scheduled_book(spark, d)[1], CAPITAL).withColumn("agrees", F.abs("difference") <= 0.01)
    return rounded(both, ["equity", "from_profits"], ("date", "agrees"), 4)


#: The summary of a curve (date, equity, exposure, total_costs) and of its fills (side, shares, price, realised).
_SUMMARY = f"""SELECT *, n_sessions / 252.0::DOUBLE AS years, final_equity / initial_equity - 1 AS total_return, pow(final_equity / initial_equity, 252.0::DOUBLE / n_sessions) - 1 AS cagr, sqrt(252.0::DOUBLE / n_sessions) AS sharpe_stderr,
  total_costs / 1e6 AS cost_drag, final_equity / initial_equity - 1 + total_costs / 1e6 AS gross_return_required, total_notional / 1e6 / (n_sessions / 252.0::DOUBLE) AS annual_turnover
  FROM (SELECT count(*) AS n_sessions, arg_min(equity, date) AS initial_equity, arg_max(equity, date) AS final_equity, coalesce(stddev_samp(x), 0) * sqrt(252) AS annual_volatility, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe,
    avg(x) / (stddev_samp(x) FILTER (x < 0)) * sqrt(252) AS sortino, avg(CAST(x > 0 AS DOUBLE)) FILTER (x IS NOT NULL) AS win_rate, avg(exposure) AS mean_exposure, arg_max(total_costs, date) AS total_costs FROM (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS x FROM daily)),
  (SELECT min(dd) AS max_drawdown, CAST(max(k) AS BIGINT) AS longest_underwater FROM (SELECT run, sum(CAST(under AS INT)) AS k, min(equity / peak - 1) AS dd FROM (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, equity < peak AS under FROM (SELECT *, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM daily))) GROUP BY run)),
  (SELECT count(*) AS n_fills, count(*) FILTER (side = 'SELL') AS n_round_trips, sum(shares * price) AS total_notional, count(*) FILTER (side = 'SELL' AND realised > 0) / count(*) FILTER (side = 'SELL') AS trade_win_rate, avg(shares * price * {COST}) AS mean_cost_per_fill,
    sum(shares * price * 0.0003::DOUBLE) AS total_commission, sum(shares * price * 0.0005::DOUBLE) AS total_spread, sum(shares * price * 0.0005::DOUBLE) AS total_slippage FROM trades)"""
_RATES = ["years", "total_return", "cagr", "annual_volatility", "sharpe", "sharpe_stderr", "sortino", "max_drawdown", "win_rate", "mean_exposure", "cost_drag", "gross_return_required", "annual_turnover", "trade_win_rate"]
_AMOUNTS = ["initial_equity", "final_equity", "total_costs", "total_notional", "mean_cost_per_fill", "total_commission", "total_spread", "total_slippage"]
_COUNTS = ["n_sessions", "longest_underwater", "n_fills", "n_round_trips"]
#: To a millionth, so that days without a move have none in any order of sums.
_ROUNDED = "SELECT * REPLACE (round(equity, 6) AS equity) FROM snapshot"
_SHOWN = f"SELECT {{}} AS name, {', '.join(_COUNTS)}, {sql.rounded(_RATES, 5)}, {sql.rounded(_AMOUNTS, 2)} FROM summary"


def summary(ledger, daily, name: str):
    out = portfolio.performance_metrics(daily.withColumns({"name": F.lit(name), "equity": F.round("equity", 6)}), ledger.withColumn("name", F.lit(name)), CAPITAL)
    return out.select("name", *_COUNTS, *[(F.round(c, 5) + 0.0).alias(c) for c in _RATES], *[(F.round(c, 2) + 0.0).alias(c) for c in _AMOUNTS])


@register("l11_performance", recursive_query(_SHOWN.format("'scheduled'"), "enriched", **_BOOK, trades="SELECT *, CASE WHEN u > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM pass", daily=_ROUNDED, summary=_SUMMARY))
def l11(spark, d):
    return summary(*scheduled_book(spark, d), "scheduled")


@register("l11_weighted_strategy", sql.query("SELECT count(*) AS n_sessions, round(avg(x) / stddev_samp(x) * sqrt(252), 5) AS sharpe, round(avg(x) / (stddev_samp(x) FILTER (x < 0)) * sqrt(252), 5) AS sortino, round(stddev_samp(x) * sqrt(252), 5) AS annual_volatility, round(avg(exposure), 5) AS mean_exposure, round(sum(turnover), 5) AS turnover, round(sum(turnover) * 0.0013::DOUBLE, 5) AS total_costs, round(arg_max(equity, date) / arg_min(equity, date) - 1, 5) + 0.0 AS total_return, round(pow(arg_max(equity, date) / arg_min(equity, date), 252.0::DOUBLE / count(*)) - 1, 5) + 0.0 AS cagr, round(avg(CAST(x > 0 AS DOUBLE)) FILTER (x IS NOT NULL), 5) AS win_rate, round(sqrt(252.0::DOUBLE / count(*)), 5) AS sharpe_stderr FROM (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS x FROM curve)", "scores", weights=panel._WEIGHTS, daily=panel._DAILY, curve=panel._CURVE))
def l11_weighted(spark, d):
    out = portfolio.performance_metrics(panel.curve(spark, d))
    return rounded(out, ["sharpe", "sortino", "annual_volatility", "mean_exposure", "turnover", "total_costs", "total_return", "cagr", "win_rate", "sharpe_stderr"], ("n_sessions",), 5)


# --- ticks ----------------------------------------------------------------------------------------------------------

_EWM = "SELECT event_type, event_id, round(CASE WHEN count(value) OVER w >= 26 THEN list_reduce(list(value) OVER w, lambda a, b: a + 0.1::DOUBLE * (b - a)) END, 9) + 0.0 AS ewm FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 600 PRECEDING AND CURRENT ROW)"


@register("q1_tick_exponential_mean", _EWM)
def q1(spark, d):
    ticks = tables.read_table(spark, d, "events").select("event_type", "event_id", "value")
    return rounded(blocks.exponential_mean(ticks, ["event_type"], "event_id", "value", 0.1, 26), ["ewm"], ("event_type", "event_id"), 9)


@register("q2_tick_percentile_so_far", "SELECT a.event_type, a.event_id, round(CASE WHEN count(*) >= 252 THEN (count(*) FILTER (b.value <= a.value) - 1) / (count(*) - 1) END, 9) + 0.0 AS percentile FROM events a JOIN events b ON b.event_type = a.event_type AND b.event_id <= a.event_id GROUP BY a.event_type, a.event_id")
def q2(spark, d):
    ticks = tables.read_table(spark, d, "events").select("event_type", "event_id", "value")
    return rounded(blocks.percentile_so_far(ticks, ["event_type"], "event_id", "value"), ["percentile"], ("event_type", "event_id"), 9)


# --- equal weights --------------------------------------------------------------------------------------------------

EVERY = 21


def equal_weight(spark, d, every: int | None):
    bars = tables.settled(traded_bars(spark, d))
    return portfolio.book(portfolio.equal_weight_fills(bars, CAPITAL, every), bars, CAPITAL)


def _equal(every: int | None) -> dict[str, str]:
    """A pass over sales and buys in order: cash, the cash to share out, and units and what one cost by symbol; then the days between."""
    n = every or 1_000_000
    wanted = "floor((1.0::DOUBLE / s.n * pot * 0.999::DOUBLE) / s.price)".replace("pot", "CASE WHEN f.buying = 0 THEN f.cash ELSE f.pot END")
    bought = f"{wanted} > 0 AND {wanted} * s.price * (1 + {COST}) <= f.cash"
    held, none = "f.units[s.slot]", "[0.0::DOUBLE for x in range((SELECT count(*) FROM slots))]"
    return {
        "traded": _TRADED,
        "slots": "SELECT symbol, row_number() OVER (ORDER BY symbol) AS slot FROM (SELECT DISTINCT symbol FROM bars)",
        "days": f"SELECT date, session_idx AS i, CAST(floor((session_idx - 1) / {n}.0) AS INT) AS p, session_idx = {n} * CAST(floor((session_idx - 1) / {n}.0) AS INT) + 1 AS starts FROM index",
        "steps": f"SELECT symbol, q AS p, max(date) FILTER (starts AND open_raw > 0) AS date, max(open_raw) FILTER (starts AND open_raw > 0) AS price, max(k) FILTER (starts) AS k, sum(dividend * k) AS d FROM (SELECT t.*, starts, CAST(ceil((i - 1) / {n}.0) AS INT) AS q FROM traded t JOIN days USING (date)) WHERE q <= (SELECT max(p) FROM days) GROUP BY symbol, q",
        "deeds": "SELECT *, row_number() OVER (ORDER BY p, buying, symbol) AS j, count(*) FILTER (buying = 1) OVER (PARTITION BY p) AS n FROM (SELECT *, 0 AS buying FROM steps UNION ALL SELECT *, 1 FROM steps WHERE price IS NOT NULL) JOIN slots USING (symbol)",
        "fold": f"""SELECT CAST(0 AS BIGINT) AS j, 1e6::DOUBLE AS cash, 0.0::DOUBLE AS pot, {none} AS units, {none} AS paid, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS realised, CAST(NULL AS INT) AS p, 0 AS buying
  UNION ALL SELECT s.j, f.cash + CASE WHEN s.buying = 0 THEN {held} * s.d + coalesce({held} * s.k * s.price * (1 - {COST}), 0) WHEN {bought} THEN -{wanted} * s.price * (1 + {COST}) ELSE 0 END, CASE WHEN f.buying = 0 THEN f.cash ELSE f.pot END,
    list_transform(f.units, lambda x, i: CASE WHEN i <> s.slot OR s.price IS NULL THEN x WHEN s.buying = 1 AND {bought} THEN {wanted} / s.k ELSE 0 END), list_transform(f.paid, lambda x, i: CASE WHEN i = s.slot AND s.buying = 1 THEN s.price * s.k ELSE x END),
    CASE WHEN s.buying = 0 THEN coalesce({held} * s.k * s.price / s.price, 0) WHEN {bought} THEN {wanted} ELSE 0 END, CASE WHEN s.buying = 0 THEN coalesce({held} * s.k * s.price - {held} * f.paid[s.slot], 0) ELSE 0 END, s.p, s.buying FROM fold f JOIN deeds s ON s.j = f.j + 1""",
        "trades": "SELECT s.symbol, s.date, CASE s.buying WHEN 1 THEN 'BUY' ELSE 'SELL' END AS side, f.shares, s.price, f.realised FROM fold f JOIN deeds s USING (j) WHERE f.shares > 0",
        "after": "SELECT p, arg_max(cash, j) AS cash, arg_max(units, j) AS units FROM fold WHERE p IS NOT NULL GROUP BY p",
        "marks": "SELECT d.date, sum(t.close_raw * t.k * a.units[d.slot]) AS holdings FROM (SELECT * FROM days, slots) d ASOF JOIN traded t ON t.symbol = d.symbol AND d.date >= t.date JOIN after a USING (p) GROUP BY d.date",
        "income": "SELECT date, sum(dividend * k * a.units[slot]) AS paid FROM traded JOIN days USING (date) JOIN slots USING (symbol) JOIN after a USING (p) WHERE NOT starts GROUP BY date",
        "outlay": f"SELECT date, sum(shares * price) AS traded, sum(shares * price * {COST}) AS c FROM trades GROUP BY date",
        "daily": """SELECT *, round(cash + holdings, 6) AS equity, holdings / (cash + holdings) AS exposure FROM (SELECT d.date, coalesce(a.cash, 1e6) + coalesce(sum(paid) OVER (PARTITION BY p ORDER BY d.date), 0) AS cash, coalesce(m.holdings, 0) AS holdings, coalesce(o.traded, 0) AS traded, coalesce(sum(o.c) OVER (ORDER BY d.date), 0) AS total_costs
  FROM days d LEFT JOIN after a USING (p) LEFT JOIN marks m ON m.date = d.date LEFT JOIN income i ON i.date = d.date LEFT JOIN outlay o ON o.date = d.date)""",
        "summary": _SUMMARY,
    }


@register("l7_buy_and_hold_fills", recursive_query("SELECT symbol, date, side, round(shares, 4) AS shares FROM trades", "enriched", "index", **_equal(None)))
def l7(spark, d):
    return portfolio.equal_weight_fills(traded_bars(spark, d), CAPITAL).select("symbol", "date", "side", F.round("shares_filled", 4).alias("shares"))


@register("l8_rebalanced_curve", recursive_query("SELECT date, round(cash, 2) + 0.0 AS cash, round(equity, 2) AS equity, round(traded, 2) + 0.0 AS traded, round(total_costs, 2) + 0.0 AS total_costs FROM daily", "enriched", "index", **_equal(EVERY)))
def l8(spark, d):
    ledger, daily = equal_weight(spark, d, EVERY)
    traded = ledger.groupBy("date").agg(F.sum(F.col("shares_filled") * F.col("price")).alias("traded"))
    return rounded(daily.join(traded, "date", "left").withColumn("traded", F.coalesce("traded", F.lit(0.0))), ["cash", "equity", "traded", "total_costs"], ("date",), 2)


@register("l8_equal_weight", recursive_query(_SHOWN.format("'equal weight'"), "enriched", "index", **_equal(EVERY)))
def l8_summary(spark, d):
    return summary(*equal_weight(spark, d, EVERY), "equal weight")


def compared(spark, d):
    """Curves and fills of the scheduled trades and of the equal-weight portfolio under a name each."""
    books = {"scheduled": scheduled_book(spark, d), "equal weight": equal_weight(spark, d, EVERY)}
    named = [(ledger.withColumn("name", F.lit(n)), daily.withColumn("name", F.lit(n))) for n, (ledger, daily) in books.items()]
    return named[0][1].unionByName(named[1][1]).withColumn("equity", F.round("equity", 6)), named[0][0].unionByName(named[1][0])


def _prefixed(ctes: dict[str, str], names: tuple[str, ...], to: str) -> dict[str, str]:
    """The expressions with those names changed."""
    import re

    change = lambda x: re.sub(rf"\b({'|'.join(names)})\b(?!\.|\()", lambda m: f"{to}_{m[1]}", x)
    return {change(k) if k in names else k: change(v) for k, v in ctes.items()}


_TABLE = ["total_return", "cagr", "sharpe", "sharpe_stderr", "max_drawdown", "annual_volatility", "cost_drag", "annual_turnover"]
_TWO = {"traded": _TRADED} | _prefixed({k: v for k, v in _equal(EVERY).items() if k != "traded"}, ("trades", "daily", "summary"), "ew") | {k: v for k, v in _BOOK.items() if k != "traded"} | {"trades": "SELECT *, CASE WHEN u > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM pass", "daily": _ROUNDED, "summary": _SUMMARY}


@register("l12_strategy_and_benchmark", recursive_query(f"SELECT 'scheduled' AS name, {sql.rounded(_TABLE, 5)} FROM summary UNION ALL SELECT 'equal weight', {sql.rounded(_TABLE, 5)} FROM ew_summary", "enriched", "index", **_TWO))
def l12(spark, d):
    curves, fills = compared(spark, d)
    return rounded(portfolio.performance_metrics(curves, fills, CAPITAL), _TABLE, ("name",), 5)
