"""Portfolios against sequential passes and hand calculations."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.operators import decisions, metrics, models, monitoring, portfolio, quality, records

FILLS = "symbol string, date date, seq int, side string, shares_filled double, price double, split_ratio double, total_cost double"
BARS = "symbol string, date date, open double, close double, dividend double, split_ratio double"
DAY = [date(2023, 1, 2) + timedelta(days=i) for i in range(400)]


def by_hand():
    """100 bought at 10, 60 sold at 12, 20 bought at 15, a split of 2, a dividend of 0.5, all 120 sold at 9."""
    fills = [("A", DAY[0], 1, "BUY", 100.0, 10.0, 1.0, 1.0), ("A", DAY[1], 2, "SELL", 60.0, 12.0, 1.0, 2.0), ("A", DAY[2], 3, "BUY", 20.0, 15.0, 1.0, 3.0), ("A", DAY[5], 4, "SELL", 120.0, 9.0, 2.0, 4.0)]
    bars = [("A", DAY[0], 10.0, 11.0, 0.0, 1.0), ("A", DAY[1], 12.0, 12.0, 0.0, 1.0), ("A", DAY[2], 15.0, 16.0, 0.0, 1.0), ("A", DAY[3], 8.0, 8.5, 0.0, 2.0), ("A", DAY[4], 8.0, 8.0, 0.5, 1.0), ("A", DAY[5], 9.0, 9.0, 0.25, 1.0)]
    return fills, bars


def test_part_sales_leave_the_average_cost(spark):
    fills, _ = by_hand()
    led = {r["seq"]: r for r in portfolio.position_ledger(spark.createDataFrame(fills, FILLS)).collect()}
    # 40 of cost 10 and 20 of cost 15 cost 700: 11.67 a share, half of that after the split.
    assert (led[2]["shares"], led[2]["cost_basis"], led[2]["realised"]) == (40.0, pytest.approx(10.0), pytest.approx(120.0))
    assert (led[3]["shares"], led[3]["cost_basis"], led[3]["realised"]) == (60.0, pytest.approx(700 / 60), None)
    assert (led[4]["shares"], led[4]["cost_basis"], led[4]["realised"]) == (0.0, 0.0, pytest.approx(120 * 9 - 700))


def test_dividends_and_splits_of_open_positions(spark):
    fills, bars = by_hand()
    _, daily = portfolio.book(spark.createDataFrame(fills, FILLS), portfolio.with_split_product(spark.createDataFrame(bars, BARS)), 5000.0)
    got = [tuple(round(r[c], 6) for c in ("cash", "holdings", "dividends", "unrealised", "n_positions", "exposure")) for r in daily.orderBy("date").collect()]
    # Paid on the shares held before the day's fills: 60 on day 4 (0.5 on 120), 30 on day 5, when they are sold.
    cash = [5000 - 1001, 5000 - 1001 + 718, 5000 - 1001 + 718 - 303]
    assert [g[0] for g in got] == [*cash, cash[2], cash[2] + 60, cash[2] + 60 + 30 + 1076]
    assert [g[1] for g in got] == [1100, 480, 960, 1020, 960, 0] and [g[2] for g in got] == [0, 0, 0, 0, 60, 90]
    assert [g[3] for g in got] == [100, 80, 260, 320, 260, 0] and [g[4] for g in got] == [1, 1, 1, 1, 1, 0]
    assert got[0][5] == pytest.approx(1100 / (cash[0] + 1100), abs=1e-6)
    assert portfolio.reconcile(daily, 5000.0).count() == 0


def walk(symbols, days, seed):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        price = rng.uniform(5, 50)
        for d in days:
            if rng.random() < 0.05:
                continue
            split = 2.0 if rng.random() < 0.01 else 1.0
            price = price / split * math.exp(rng.gauss(0, 0.02))
            rows.append((s, d, price, price * math.exp(rng.gauss(0, 0.01)), round(rng.random(), 2) if rng.random() < 0.03 else 0.0, split))
    return rows


def sequential(rows, capital, every):
    """Session by session and symbol by symbol."""
    days = sorted({r[1] for r in rows})
    at = {(r[0], r[1]): r for r in rows}
    symbols = sorted({r[0] for r in rows})
    cash, held, last, out, traded = capital, dict.fromkeys(symbols, 0.0), {}, [], []
    for i, d in enumerate(days):
        now = {s: at[s, d] for s in symbols if (s, d) in at}
        for s, r in now.items():
            held[s] *= r[5]
            last[s] = last.get(s, r[3]) / r[5]
            cash += held[s] * r[4]
        if every and i > 0 and i % every == 1 or not every and i == 1:
            for s, r in now.items():
                if held[s]:
                    cash += held[s] * r[2] * (1 - 0.0013)
                    traded.append((s, d, "SELL", round(held[s], 6)))
                    held[s] = 0.0
            pot = cash
            for s, r in now.items():
                n = math.floor((1.0 / len(now) * pot * 0.999) / r[2])
                if n > 0 and n * r[2] * 1.0013 <= cash:
                    cash -= n * r[2] * 1.0013
                    held[s] = float(n)
                    traded.append((s, d, "BUY", float(n)))
        for s, r in now.items():
            last[s] = r[3]
        out.append((d, cash + sum(held[s] * last[s] for s in symbols if held[s])))
    return out, traded


@pytest.mark.parametrize("every", [21, 5, None])
def test_equal_weights_equal_a_sequential_pass_and_trade_on_rebalancing_days_only(spark, every):
    rows = walk(["A", "B", "C", "D", "E"], DAY[:120], 3)
    bars = portfolio.with_split_product(spark.createDataFrame(rows, BARS).repartition(4))
    ledger, daily = portfolio.book(portfolio.equal_weight_fills(bars, 1e5, every), bars, 1e5)
    want, traded = sequential(rows, 1e5, every)
    assert sorted((r["symbol"], r["date"], r["side"], round(r["shares_filled"], 6)) for r in ledger.collect()) == sorted(traded)
    got = [(r["date"], r["equity"]) for r in daily.orderBy("date").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9)
    assert portfolio.reconcile(daily, 1e5).count() == 0


def test_years_and_errors_count_sessions(spark):
    equity = [100.0 * 1.001**i for i in range(10)]
    curve = spark.createDataFrame([("x", DAY[i], e, 0.5, 0.1 * i) for i, e in enumerate(equity)], "name string, date date, equity double, exposure double, total_costs double")
    fills = spark.createDataFrame([("x", "BUY", 10.0, 5.0, 0.1, None), ("x", "SELL", 10.0, 6.0, 0.3, 10.0), ("x", "SELL", 10.0, 4.0, 0.2, -10.0)], "name string, side string, shares_filled double, price double, total_cost double, realised double")
    r = portfolio.performance_metrics(curve, fills, 200.0).first()
    assert r["cagr"] == pytest.approx(1.001 ** (9 * 252 / 10) - 1) and round(r["cagr"], 3) == 0.254
    assert round(r["sharpe_stderr"], 2) == 5.02 and r["years"] == pytest.approx(10 / 252) and r["mean_exposure"] == 0.5
    assert r["total_costs"] == pytest.approx(0.9) and r["cost_drag"] == pytest.approx(0.9 / 200) and r["gross_return_required"] == pytest.approx(r["total_return"] + 0.0045)
    assert (r["n_fills"], r["n_round_trips"], r["total_notional"], r["trade_win_rate"]) == (3, 2, 150.0, 0.5)
    assert r["annual_turnover"] == pytest.approx(150 / 200 / (10 / 252)) and r["mean_cost_per_fill"] == pytest.approx(0.2) and r["total_spread"] == pytest.approx(0.075)


def evaluated(spark, rows):
    d = spark.createDataFrame([("A", DAY[i], s, None) for i, (s, _) in enumerate(rows)], "symbol string, decision_date date, signal string, reject_reason string")
    o = spark.createDataFrame([("A", DAY[i], x) for i, (_, x) in enumerate(rows)], "symbol string, date date, outcome double")
    return d, o


def test_decisions_hit_above_zero_and_costs_come_off(spark):
    r = decisions.evaluate_decisions(*evaluated(spark, [("BUY", 0.001), ("BUY", 0.009), ("BUY", -0.004), ("HOLD", 0.5)]), cost=0.002).first()
    assert r["hit_rate"] == pytest.approx(2 / 3) and r["gross_return_per_trade"] == pytest.approx(0.002) and r["net_return_per_trade"] == pytest.approx(0.0) and r["cost_drag_ratio"] == pytest.approx(1.0)
    r = decisions.evaluate_decisions(*evaluated(spark, [("BUY", 0.01), ("BUY", 0.03)]), cost=0.01).first()
    assert r["net_sharpe_per_trade"] == pytest.approx(0.01 / (0.02 / 2**0.5) * 252**0.5) and r["total_net_return"] == pytest.approx(0.02)
    r = decisions.evaluate_decisions(*evaluated(spark, [("HOLD", 0.01)])).first()
    assert (r["gross_return_per_trade"], r["net_return_per_trade"], r["hit_rate"], r["cost_drag_ratio"], r["net_sharpe_per_trade"]) == (0.0, 0.0, 0.0, float("inf"), None)


def test_outcomes_are_one_to_one(spark):
    d, o = evaluated(spark, [("BUY", 0.01), ("HOLD", 0.0)])
    for a, b in ((d.unionByName(d), o), (d, o.unionByName(o))):
        with pytest.raises(Exception, match="twice"):
            decisions.with_outcomes(a, b).select("signal").collect()


def test_thresholds_earn_for_each_row(spark):
    s = spark.createDataFrame([(0.9, 0.01, 1.0), (0.9, 0.001, 1.0), (0.1, 0.5, 1.0), (0.1, 0.5, 1.0)], "calibrated double, realised double, expected_return double")
    got = {r["buy"]: r for r in decisions.score_thresholds(s, spark.createDataFrame([(0.5,), (0.95,)], "buy double"), cost=0.002).collect()}
    assert got[0.5]["hit_rate"] == 1.0 and got[0.5]["net_total"] == pytest.approx((0.011 - 0.004) / 4)
    assert [got[0.95][c] for c in ("n_trades", "gross", "net", "net_total", "hit_rate")] == [0, 0.0, 0.0, 0.0, 0.0]


def test_reliability_gap_is_predicted_less_observed(spark):
    df = spark.createDataFrame([(float(i % 4 == 0), i / 10) for i in range(11)] + [(None, 0.5)], "y double, p double")
    got = metrics.reliability_table(df, "y", "p", n_bins=2).orderBy("bin").collect()
    assert [(r["lower"], r["upper"], r["count"]) for r in got] == [(0.0, 0.5, 5), (0.5, 1.0, 6)]
    assert got[0]["gap"] == pytest.approx(0.2 - 2 / 5) and got[1]["gap"] == pytest.approx(0.75 - 1 / 6)
    one = metrics.reliability_table(spark.createDataFrame([(1.0, 0.3), (0.0, 0.3)], "y double, p double"), "y", "p").collect()
    assert len(one) == 1 and one[0]["lower"] < 0.3 < one[0]["upper"] and one[0]["gap"] == pytest.approx(-0.2)


def test_undated_issues_count_since_they_were_stored(spark):
    issues = spark.createDataFrame([("ERROR", "NO_DATA", None), ("WARNING", "X", DAY[0]), ("INFO", "Y", DAY[0])], "severity string, code string, issue_date date")
    stored = quality.persistable(issues, F.lit(DAY[10]))
    assert {r["severity"]: r["n"] for r in quality.open_counts(stored, DAY[5]).collect()} == {"ERROR": 1, "WARNING": 1}
    assert quality.open_counts(stored, DAY[20]).count() == 0 and quality.open_counts(quality.persistable(issues), DAY[20]).count() == 2


def test_drift_summary_is_of_measurable_features(spark):
    drift = spark.createDataFrame([("a", 0.3, 0.01, True, 0.1, False, "SIGNIFICANT"), ("b", 0.12, 0.04, False, 0.2, False, "MODERATE"), ("c", None, None, False, 0.9, True, "INSUFFICIENT")], "feature string, psi double, ks_p double, discovered boolean, current_missing double, insufficient boolean, severity string")
    r = monitoring.summarise_drift(drift).first().asDict()
    assert r == {"n_features": 3, "n_measurable": 2, "n_significant": 1, "n_moderate": 1, "max_psi": 0.3, "mean_psi": pytest.approx(0.21), "n_ks_naive": 2, "n_ks_fdr": 1, "max_missing_rate": 0.2}


def test_infinities_are_missing(spark):
    rows = [(p, float(i) if i % 10 else float("inf")) for p in ("reference", "current") for i in range(200)]
    r = monitoring.compute_drift(spark.createDataFrame(rows, "part string, x double"), ["x"]).first()
    assert r["n_current"] == 180 and r["current_missing"] == pytest.approx(0.1) and r["psi"] == pytest.approx(0.0, abs=1e-9) and math.isfinite(r["current_mean"])


def test_one_breach_is_no_signal(spark):
    resolved = spark.createDataFrame([("A", DAY[i], 0.5 + 0.1 * (i % 2), float(i % 2)) for i in range(80)], "symbol string, prediction_date date, calibrated_probability double, actual_direction double")
    drift = spark.createDataFrame([("a", 0.3, 0.01, True, 0.1, False, "SIGNIFICANT")], "feature string, psi double, ks_p double, discovered boolean, current_missing double, insufficient boolean, severity string")
    perf, cal = monitoring.rolling_performance(resolved, DAY[79]), monitoring.monitor_calibration(resolved, DAY[79], 0.03)

    def row(breaches):
        history = spark.createDataFrame([("a", DAY[i], b) for i, b in enumerate(breaches)], "feature string, checked_at date, breached boolean")
        return monitoring.health_row(drift, monitoring.drift_persistence(history), perf, cal, resolved, 0.5, 0.03).first()

    assert row([False, False, True])["drifted_features"] == 0 and row([False, False, True])["state"] == "HEALTHY"
    assert row([True, True, True])["drifted_features"] == 1 and row([True, True, True])["state"] == "WARNING" and row([True] * 3)["n_resolved"] == 80


def test_forecasts_refuse_rather_than_go_back(spark):
    rng = random.Random(1)
    full = [("A", DAY[i], rng.gauss(0, 1), rng.gauss(0, 0.01)) for i in range(380)] + [("A", DAY[380], 0.1, None)]
    rows = full + [("B", *r[1:]) for r in full[:-1]] + [("B", DAY[380], None, None)] + [("C", r[1], r[2], abs(r[3]) + 1e-9) for r in full[:-1]] + [("D", *r[1:]) for r in full[:50]]
    got = {r["symbol"]: r for r in models.forecast_symbols(spark.createDataFrame(rows, "symbol string, date date, x double, target double"), ["x"], least=300).collect()}
    assert {s: r["refused"] for s, r in got.items()} == {"A": None, "B": "INCOMPLETE_LATEST_ROW", "C": "ONE_DIRECTION_IN_A_FOLD", "D": "TOO_FEW_ROWS"}
    assert got["A"]["as_of"] == DAY[380] and got["A"]["validation_sessions"] == 300 and 0.3 < got["A"]["auc"] < 0.7 and got["B"]["direction"] is None


def test_history_refuses_a_changed_forecast(spark):
    f = spark.createDataFrame([("A", DAY[1], DAY[0], "UP", 0.6, 0.01), ("A", DAY[2], DAY[1], "DOWN", 0.4, -0.02), ("A", DAY[3], DAY[3], "UP", 0.5, 0.0), ("B", DAY[9], DAY[8], "UP", 0.7, 0.0)], "symbol string, forecast_session date, as_of date, direction string, probability_up double, expected_return double").withColumn("created_at", F.col("as_of").cast("timestamp"))
    bars = spark.createDataFrame([("A", DAY[1], 100.0, 102.0), ("A", DAY[2], 100.0, 101.0), ("A", DAY[3], 100.0, 101.0)], "symbol string, date date, open double, close double")
    stored = records.forecast_outcomes(f, bars)
    got = [tuple(r) for r in records.forecast_history(f, stored).select("forecast_session", "result", F.round("actual_return_pct", 6), F.round("error_pp", 6), "actual_open", "actual_close", "probability_up_pct").collect()]
    assert got == [(DAY[9], "PENDING", None, None, None, None, 70.0), (DAY[3], "INELIGIBLE", None, None, None, None, 50.0), (DAY[2], "WRONG", 1.0, 3.0, 100.0, 101.0, 40.0), (DAY[1], "CORRECT", 2.0, 1.0, 100.0, 102.0, 60.0)]
    changed = f.withColumn("direction", F.when(F.col("forecast_session") == DAY[2], "UP").otherwise(F.col("direction")))
    with pytest.raises(Exception, match="changed after resolution"):
        records.forecast_history(changed, stored).select("symbol").collect()


def test_normal_quantiles_to_the_last_digits(spark):
    from statistics import NormalDist

    from panelspark.functions import normal

    p = [1e-300, 1e-20, 1e-7, 0.001, 0.02425, 0.075, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, -0.1, None]], "p double")
    got = {r["p"]: r["z"] for r in df.select("p", normal.quantile("p").alias("z")).collect()}
    assert all(got[x] == pytest.approx(NormalDist().inv_cdf(x), rel=1e-13, abs=1e-15) for x in p) and [got[x] for x in (0.0, 1.0, -0.1, None)] == [None] * 4


@pytest.mark.parametrize("one_sort", [0, 1 << 17])
def test_ranks_by_ranges_average_ties(spark, monkeypatch, one_sort):
    import numpy as np

    from panelspark.functions import ordered

    monkeypatch.setattr(ordered, "ONE_SORT", one_sort)

    rng = np.random.default_rng(1)
    data = [(g, float(a), float(a + b)) for g in "xy" for a, b in zip(rng.integers(0, 50, 700), rng.integers(0, 40, 700), strict=True)] + [("x", None, 1.0)]
    df = spark.createDataFrame(data, "g string, a double, b double")
    for by in (["g"], []):
        for r in metrics.spearman(df, "a", "b", by).collect():
            own = np.array([(a, b) for g, a, b in data if a is not None and (not by or g == r["g"])])
            ranks = [(c[None, :] < c[:, None]).sum(axis=1) + ((c[None, :] == c[:, None]).sum(axis=1) + 1) / 2 for c in own.T]
            assert r["spearman"] == pytest.approx(np.corrcoef(*ranks)[0, 1]) and r["n"] == len(own)
