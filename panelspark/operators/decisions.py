"""From calibrated scores to sized decisions, net of costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.ordered import by_or_all

# Costs in basis points a side, thresholds, risk buckets, and the factor of an edge.
COSTS_BPS = {"commission": 3.0, "spread": 5.0, "slippage": 5.0}
PER_SIDE = sum(COSTS_BPS.values()) / 1e4
ROUND_TRIP = 2 * PER_SIDE
EDGE_FACTOR = 1.755
FLOOR_MARGIN = 1.5
BUY, SELL, MAX_WEIGHT = 0.55, 0.45, 0.10
MAX_STALE = 3
RISK = ((0.20, "LOW"), (0.35, "MEDIUM"), (0.60, "HIGH"))
EXTREME = "EXTREME"
YEAR = 252


def cost_feasibility(panel: DataFrame, horizon: int = 1, by: tuple[str, ...] = ("symbol",), volatility: str = "return_1d", ic: float = 0.03) -> DataFrame:
    """(by, sigma, breakeven_ic, expected_edge, feasible, cost_floor) with the daily sigma of the group."""
    scale = F.col("sigma") * EDGE_FACTOR * float(horizon) ** 0.5
    out = panel.groupBy(*by).agg(F.stddev_samp(volatility).alias("sigma"))
    return out.withColumns({"breakeven_ic": F.try_divide(F.lit(ROUND_TRIP), scale), "expected_edge": scale * ic}).withColumns({"feasible": F.col("expected_edge") > ROUND_TRIP, "cost_floor": F.lit(ROUND_TRIP * FLOOR_MARGIN)})


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def risk_bucket(volatility: Column) -> Column:
    out = F.when(~finite(volatility), "MEDIUM")
    for top, name in RISK:
        out = out.when(volatility < top, name)
    return out.otherwise(EXTREME)


def gate(p: str = "calibrated_probability") -> Column:
    """The first failed gate of a row, or null. The position limit comes in decide()."""
    return F.when(F.col("data_age_sessions") > MAX_STALE, "STALE_DATA").when(~F.coalesce("features_complete", F.lit(False)), "MISSING_FEATURES").when(F.isnan(p) | (F.abs(F.col(p)) == float("inf")), "MISSING_PROBABILITY")


def decide(inputs: DataFrame, cap: int = 10, buy: float = BUY, sell: float = SELL, floor: float = ROUND_TRIP * FLOOR_MARGIN) -> DataFrame:
    """inputs plus signal, reject_reason, target_weight null where a position is kept, and risk_bucket.

    The likeliest symbols of a date come first, and no more than ``cap``
    positions are opened. How many are open before a row is a running count,
    so no loop over rows is needed: opening buys fill up to the cap, and sells
    of held symbols free places.
    """
    p, e, held = F.col("calibrated_probability"), F.col("expected_return"), F.coalesce(F.col("shares"), F.lit(0.0)) > 0
    df = inputs.withColumn("_gate", gate())
    passing = F.col("_gate").isNull()
    wants = passing & p.isNotNull() & (p >= buy) & finite(e) & (e >= floor)
    leaves = passing & p.isNotNull() & (p < sell) & held
    order = Window.partitionBy("decision_date").orderBy(F.desc_nulls_last("calibrated_probability"), "symbol")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("decision_date")
    n = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    at_open = F.sum(held.cast("int")).over(day)
    open_before = at_open + F.least(n(wants & ~held), F.greatest(F.lit(cap) - at_open, F.lit(0))) - n(leaves)
    df = df.withColumn("_full", ~held & (open_before >= cap))
    reason = F.coalesce("_gate", F.when(F.col("_full"), "POSITION_LIMIT").when(p.isNull(), "MISSING_PROBABILITY").when((p >= buy) & ~finite(e), "MISSING_PROBABILITY").when((p >= buy) & (e < floor), "BELOW_COST_FLOOR"))
    df = df.withColumn("reject_reason", reason)
    signal = F.when(F.col("reject_reason").isNotNull(), "HOLD").when(p >= buy, "BUY").when(p < sell, "SELL").otherwise("HOLD")
    df = df.withColumn("signal", signal).withColumn("risk_bucket", risk_bucket(F.col("volatility")))
    weight = F.when(F.col("signal") == "BUY", MAX_WEIGHT).when(F.col("signal") == "SELL", 0.0).when(~held, 0.0)
    return df.withColumn("target_weight", weight).drop("_gate", "_full")


def size_positions(decisions: DataFrame, method: str = "fixed", max_weight: float = MAX_WEIGHT, reference: float = 0.25, buy: float = BUY) -> DataFrame:
    """target_weight of BUY rows by method: fixed, volatility_target or confidence (half the weight at the threshold). Other rows stay."""
    v, p = F.col("volatility"), F.col("calibrated_probability")
    raw = {"fixed": F.lit(max_weight), "volatility_target": F.when(finite(v) & (v > 0), max_weight * reference / v).otherwise(max_weight / 2), "confidence": max_weight * (0.5 + 0.5 * F.least(F.greatest((F.coalesce(p, F.lit(0.0)) - buy) / max(1e-9, 1 - buy), F.lit(0.0)), F.lit(1.0)))}[method]
    clipped = F.least(F.greatest(raw, F.lit(0.0)), F.lit(max_weight))
    return decisions.withColumn("target_weight", F.when(F.col("signal") == "BUY", clipped).otherwise(F.col("target_weight")))


def with_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """decisions that have an outcome row (symbol, date, outcome), with it; a symbol and date that either side has twice stops the job."""

    def once(df: DataFrame, day: str, what: str) -> DataFrame:
        counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol", day)))
        return counted.filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"{what} have a symbol and date twice")).cast("boolean"))).drop("_n")

    own = outcomes.select("symbol", F.col("date").alias("decision_date"), "outcome")
    return once(decisions, "decision_date", "decisions").join(once(own, "decision_date", "outcomes"), ["symbol", "decision_date"])


def evaluate_decisions(decisions: DataFrame, outcomes: DataFrame, cost: float = ROUND_TRIP, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and returns of decisions joined to outcomes (symbol, date, outcome), one to one.

    Without buys returns are 0. A hit is a buy whose outcome is above 0, before
    costs. cost_drag_ratio, costs over the gross return, is infinite where that
    isn't positive. The Sharpe ratio takes trades as days, and needs two.
    """
    d = with_outcomes(decisions, outcomes)
    d = d if by else d.withColumn("_all", F.lit(0))
    buys = F.col("signal") == "BUY"
    r = F.when(buys, F.col("outcome"))
    n = lambda c: F.sum(c.cast("long"))
    some = n(buys) > 0
    gross = F.when(some, F.avg(r)).otherwise(0.0)
    out = d.groupBy(*(by or ("_all",))).agg(
        F.count(F.lit(1)).alias("n_decisions"),
        n(buys).alias("n_buys"),
        n(F.col("signal") == "SELL").alias("n_sells"),
        n(F.col("signal") == "HOLD").alias("n_holds"),
        n(F.col("reject_reason").isNotNull()).alias("n_rejected"),
        gross.alias("gross_return_per_trade"),
        F.when(some, F.avg(r) - cost).otherwise(0.0).alias("net_return_per_trade"),
        F.when(some, F.avg(F.coalesce(r > 0, F.when(buys, False)).cast("double"))).otherwise(0.0).alias("hit_rate"),
        F.when(n(buys) > 1, F.when(F.stddev_samp(r) > 0, (F.avg(r) - cost) / F.stddev_samp(r) * float(YEAR) ** 0.5).otherwise(0.0)).alias("net_sharpe_per_trade"),
    )
    g, k = F.col("gross_return_per_trade"), F.col("n_decisions")
    out = out.withColumns({"round_trip_cost": F.lit(cost), "total_net_return": F.col("net_return_per_trade") * F.col("n_buys"), "buy_rate": F.col("n_buys") / k, "rejection_rate": F.col("n_rejected") / k, "cost_drag_ratio": F.when(g > 0, cost / g).otherwise(float("inf"))})
    return out.drop("_all")


def threshold_grid(spark: SparkSession, low: int = 45, high: int = 80) -> DataFrame:
    return spark.range(low, high + 1).select((F.col("id") / 100).alias("buy"))


def score_thresholds(signals: DataFrame, grid: DataFrame, cost: float = ROUND_TRIP, floor: float = ROUND_TRIP * FLOOR_MARGIN, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, buy, n_rows, n_trades, trade_rate, gross, net, net_total, hit_rate): one pass over signals for the whole grid.

    net_total is the net return of all trades for each row, traded or not; a hit
    is a trade with a return above 0. Without trades returns are 0.

    signals has calibrated, realised and expected_return. The grid is a few
    dozen thresholds; a row counts once, at the highest one that it reaches,
    and sums from the highest down give those of each threshold.
    """
    at = sorted(r["buy"] for r in grid.select("buy").distinct().collect())  # a few dozen
    rows, keys = by_or_all(signals.filter("calibrated is not null and realised is not null"), list(by))
    step = F.size(F.filter(F.array(*[F.lit(float(x)) for x in at]), lambda x: x <= F.col("calibrated")))
    r = F.when(F.col("expected_return") >= floor, F.col("realised"))
    per = rows.groupBy(*keys, step.alias("_step")).agg(F.count(F.lit(1)).alias("_rows"), F.count(r).alias("_n"), F.sum(r).alias("_r"), F.sum((r > 0).cast("long")).alias("_hits"))
    steps = per.select(*keys).distinct().select(*keys, F.posexplode(F.array(F.lit(None).cast("double"), *[F.lit(float(x)) for x in at])).alias("_step", "buy"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce("_rows", F.lit(0))).over(Window.partitionBy(*keys))
    sums = {c: F.coalesce(F.sum(c).over(down), F.lit(0)) for c in ("_n", "_r", "_hits")}
    all_ = steps.join(per, [*keys, "_step"], "left").withColumns(sums | {"_rows": total}).filter("buy is not null")
    n, rows = F.col("_n"), F.col("_rows")
    of_trades = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    return all_.select(*by, "buy", rows.alias("n_rows"), n.alias("n_trades"), (n / rows).alias("trade_rate"), of_trades(F.col("_r")).alias("gross"), of_trades(F.col("_r") - cost * n).alias("net"), ((F.col("_r") - cost * n) / rows).cast("double").alias("net_total"), of_trades(F.col("_hits")).alias("hit_rate"))


def best_threshold(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, buy, sell, net_total): the highest net_total, the smallest threshold of those; the smallest of all if it trades nothing."""
    s = scores if by else scores.withColumn("_all", F.lit(0))
    top = s.groupBy(*(by or ("_all",))).agg(F.max(F.struct("net_total", (-F.col("buy")).alias("minus"), "n_trades")).alias("b"), F.min("buy").alias("_least"))
    buy = F.when(F.col("b.n_trades") > 0, -F.col("b.minus")).otherwise(F.col("_least"))
    return top.select(*by, buy.alias("buy"), F.greatest(buy - 0.02, F.lit(0.0)).alias("sell"), F.col("b.net_total").alias("net_total"))


def out_of_block_thresholds(signals: DataFrame, grid: DataFrame, blocks: DataFrame, min_rows: int = 500, cost: float = ROUND_TRIP, floor: float = ROUND_TRIP * FLOOR_MARGIN) -> DataFrame:
    """(block, buy, n_trades, net_total): the threshold chosen on the blocks before, scored on the block.

    Scores of blocks add up, so choosing on all blocks before is a running sum
    over (threshold, block), not a scan for each block.
    """
    rows = signals.join(blocks, "date")
    per = score_thresholds(rows, grid, cost, floor, ("block",))
    w = Window.partitionBy("buy").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_net": F.sum(F.col("net_total") * F.col("n_rows")).over(w), "_n": F.sum("n_trades").over(w), "_rows": F.sum("n_rows").over(w)})
    prior = per.filter(F.col("_rows") >= min_rows).select("block", "buy", (F.col("_net") / F.col("_rows")).alias("net_total"), F.col("_n").alias("n_trades"))
    chosen = best_threshold(prior, ("block",)).select("block", "buy")
    return chosen.join(per.select("block", "buy", "n_trades", "net_total"), ["block", "buy"])
