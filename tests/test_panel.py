"""Operators on small frames, and properties that SQL does not show."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import ordered
from panelspark.functions import normal
from panelspark.functions.kernels import ewm, expanding_percentile
from panelspark.operators import actions, calendar, decisions, features, folds, labels, metrics, models, monitoring, portfolio, quality, records
from panelspark.plans import checks
from panelspark.plans import panel as panel_plans
from panelspark.sources import tables
from panelspark.streaming import candles


def walk(symbols=("A", "B"), n=420, seed=1):
    rng, out = random.Random(seed), []
    for s in symbols:
        price, day = 500.0, date(2019, 1, 1)
        for _ in range(n):
            o = price * (1 + rng.gauss(0, 0.005))
            price *= 1 + rng.gauss(0.0004, 0.015)
            hi, lo = max(o, price) * (1 + abs(rng.gauss(0, 0.004))), min(o, price) * (1 - abs(rng.gauss(0, 0.004)))
            out.append((day, s, o, hi, lo, price, rng.randrange(10_000, 90_000), 1.0 if rng.random() < 0.01 else 0.0, 2.0 if rng.random() < 0.004 else 1.0))
            day += timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(), tables.BARS_RAW).cache()


def simple(spark, rows):
    """Bars from (day, close) with fixed other columns."""
    full = [(date(2023, 1, 2) + timedelta(days=d), "A", c, c * 1.01 if c else c, c * 0.99 if c else c, c, 100, div, split) for d, c, div, split in rows]
    return spark.createDataFrame(full, tables.BARS_RAW)


def by_day(df, *cols):
    return [tuple(r) for r in df.orderBy("date").select(*cols).collect()]


def test_split_factor_excludes_its_own_day(spark):
    df = actions.apply_corporate_actions(simple(spark, [(0, 50.0, 0.0, 1.0), (1, 51.0, 0.0, 2.0), (2, 52.0, 0.0, 1.0)]))
    assert by_day(df, "split_factor", "close_raw") == [(2.0, 100.0), (1.0, 51.0), (1.0, 52.0)]


def test_adjusted_close_scales_days_before_a_dividend(spark):
    df = actions.apply_corporate_actions(simple(spark, [(0, 100.0, 5.0, 1.0), (1, 100.0, 0.0, 1.0), (2, 98.0, 2.0, 1.0)]))
    assert [round(x, 9) for (x,) in by_day(df, "adj_close")] == [98.0, 98.0, 98.0]


def test_no_feature_sees_the_future(bars):
    cut = date(2020, 1, 15)
    changed = bars.withColumn("close_split", F.when(F.col("date") > cut, F.col("close_split") * 7).otherwise(F.col("close_split"))).withColumn("volume", F.when(F.col("date") > cut, 1).otherwise(F.col("volume")))
    names = None
    out = []
    for b in (bars, changed):
        df = features.symbol_features(b.withColumn("adj_close", F.col("close_split")).withColumns({f"{p}_raw": F.col(f"{p}_split") for p in ("open", "high", "low", "close")}).withColumn("split_factor", F.lit(1.0)))
        names = [c for c in features.feature_names(df) if c not in ("adj_factor",)]
        out.append(df.filter(F.col("date") <= cut).select("symbol", "date", *names))
    assert len(names) == 41
    assert out[0].exceptAll(out[1]).count() == 0


def test_panel_has_all_features_and_labels(bars):
    panel = features.build_panel(actions.apply_corporate_actions(bars))
    assert len(features.feature_names(panel)) == 45
    assert panel.count() == 2 * (420 - 252)
    tail = panel.filter("tradeable_direction_1d is null").groupBy("symbol").count().collect()
    assert {r["count"] for r in tail} == {2}


def test_labels_by_hand(spark):
    df = simple(spark, [(i, c, 0.0, 1.0) for i, c in enumerate((10.0, 11.0, 12.0, 9.0))])
    df = labels.add_labels(actions.add_adjusted_open(df.withColumn("adj_close", F.col("close_split"))))
    got = by_day(df, "tradeable_return_1d", "tradeable_direction_1d")
    assert got[0] == (pytest.approx(12 / 11 - 1), 1.0) and got[1] == (pytest.approx(9 / 12 - 1), 0.0) and got[2:] == [(None, None)] * 2


def test_kernels():
    x = np.array([np.nan, 1.0, 2.0, 4.0])
    assert np.allclose(ewm(x, 0.5, 2)[2:], [1.5, 2.75]) and np.isnan(ewm(x, 0.5, 2)[:2]).all()
    assert np.allclose(expanding_percentile(np.array([3.0, 1.0, 2.0, 2.0]), 2)[1:], [0, 0.5, 2 / 3])


def test_quality_codes(spark):
    df = simple(spark, [(0, 10.0, 0.0, 1.0), (1, 13.0, 0.0, 1.0), (2, 13.0, 0.0, 1.0), (3, 13.0, 0.0, 1.0), (4, 13.0, 0.0, 1.0), (5, 13.0, 0.0, 1.0), (6, 30.0, 0.0, 2.0), (7, None, 9.0, 1.0)])
    cal = calendar.sessions(spark, date(2023, 1, 1), date(2023, 2, 1))
    issues = quality.validate_bars(df.unionByName(df.limit(1)), cal, spark.createDataFrame([("A",), ("Z",)], "symbol string"))
    codes = {(r["code"], r["severity"], r["symbol"]) for r in issues.collect()}
    assert {("ABNORMAL_JUMP", "WARNING", "A"), ("STALE_PRICES", "WARNING", "A"), ("SPLIT_RECONCILIATION", "ERROR", "A"), ("DUPLICATE_DATES", "ERROR", "A"), ("NO_DATA", "ERROR", "Z"), ("INVALID_PRICE:close_split", "ERROR", "A"), ("UNEXPECTED_SESSIONS", "WARNING", "A")} <= codes
    assert quality.quarantine(df, issues).count() == 0
    late = df.withColumn("seq", F.when(F.dayofmonth("date") == 4, 99).otherwise(F.dayofmonth("date")))
    assert [(r["code"], r["n"]) for r in quality.not_sorted(late, "seq").collect()] == [("NOT_SORTED", 1)]
    assert quality.not_sorted(df.withColumn("seq", F.dayofmonth("date")), "seq").count() == 0


def test_folds_are_clean_and_purged(spark, bars):
    index = calendar.session_index(bars)
    bounds = folds.fold_bounds(spark, index.count(), n_folds=3, test=50, purge=2, embargo=3, min_train=100)
    rows = folds.assign_folds(bars.select("symbol", "date"), bounds, index)
    assert folds.unclean_folds(rows).count() == 0
    per = {r["fold"]: r for r in folds.fold_summary(rows).collect()}
    assert len(per) == 3 and all(r["n_val"] == 100 and r["n_purged"] == 4 for r in per.values()) and per[2]["n_embargoed"] == 0 and per[0]["n_embargoed"] == 6
    with pytest.raises(ValueError):
        folds.fold_bounds(spark, 60)
    with pytest.raises(ValueError):
        folds.fold_bounds(spark, 1000, purge=1)
    folds.assert_no_locked_rows(bars, date(2030, 1, 1))
    with pytest.raises(ValueError):
        folds.assert_no_locked_rows(bars, date(2019, 6, 1))


def one_by_one(rows, cap):
    """Decisions of one date in order, counting open positions as they change."""
    open_now, out = sum(r["shares"] > 0 for r in rows), {}
    for r in sorted(rows, key=lambda r: (r["p"] is None, -(r["p"] or 0), r["symbol"])):
        held = r["shares"] > 0
        if r["age"] > 3:
            signal = "STALE_DATA"
        elif not held and open_now >= cap:
            signal = "POSITION_LIMIT"
        elif r["p"] is None:
            signal = "MISSING_PROBABILITY"
        elif r["p"] >= 0.55:
            signal = "BELOW_COST_FLOOR" if r["e"] < 0.0039 else "BUY"
            open_now += signal == "BUY" and not held
        else:
            signal = "SELL" if r["p"] < 0.45 else "HOLD"
            open_now -= signal == "SELL" and held
        out[r["symbol"]] = signal
    return out


def test_decisions_equal_a_sequential_pass(spark):
    rng, rows = random.Random(9), []
    for day in range(300):
        for s in range(rng.randint(1, 9)):
            rows.append({"day": day, "symbol": f"S{s}", "p": rng.choice([None, 0.3, 0.44, 0.5, 0.56, 0.7, 0.7, 0.9]), "e": rng.choice([0.001, 0.01]), "shares": rng.choice([0.0, 0.0, 5.0]), "age": rng.choice([1, 1, 1, 5])})
    cap = 3
    df = spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=r["day"]), r["symbol"], r["p"], r["e"], 0.2, r["shares"], 1.0, r["age"], True) for r in rows], "decision_date date, symbol string, calibrated_probability double, expected_return double, volatility double, shares double, cost_basis double, data_age_sessions int, features_complete boolean")
    got = {(r["decision_date"], r["symbol"]): r["reject_reason"] or r["signal"] for r in decisions.decide(df, cap).collect()}
    for day in range(300):
        own = [r for r in rows if r["day"] == day]
        for s, signal in one_by_one(own, cap).items():
            assert got[(date(2020, 1, 1) + timedelta(days=day), s)] == signal
    kept = decisions.decide(df, cap).filter("signal = 'HOLD' and shares > 0").select("target_weight").distinct().collect()
    assert [r[0] for r in kept] == [None]


@pytest.mark.parametrize("one_sort", [0, ordered.ONE_SORT])
def test_sums_and_quantiles_of_groups_by_ranges(spark, monkeypatch, one_sort):
    monkeypatch.setattr(ordered, "ONE_SORT", one_sort)
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n, top in (("a", 3000, 400), ("b", 7, 3), ("c", 1, 1)) for v in rng.integers(0, top, n)] + [("a", 0.5), ("n", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    for keys in (["g"], []):
        got = {tuple(r[k] for k in keys): r["q"] for r in ordered.quantiles(df, keys, "v", probs, "q").collect()}
        held = {}
        for g, v in rows:
            if v is not None:
                held.setdefault((g,) if keys else (), []).append(v)
        assert got.keys() == held.keys() and all(np.allclose(got[k], np.quantile(held[k], probs), atol=1e-12) for k in held)
    one = df.filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in ordered.running_before(one, ["g"], "v", {"s": F.col("n")}).collect():
        own = [v for g, v in rows if g == r["g"] and v is not None]
        assert r["s"] == sum(v < r["v"] for v in own) and r["s_total"] == len(own)


def test_thresholds_count_each_row_once(spark):
    rng = np.random.default_rng(4)
    rows = [(float(p), float(r), float(e)) for p, r, e in zip(rng.random(400).round(2), rng.normal(0, 0.01, 400), rng.normal(0.004, 0.003, 400), strict=True)] + [(None, 0.1, 0.1), (0.7, None, 0.1)]
    got = {round(r["buy"], 2): r for r in decisions.score_thresholds(spark.createDataFrame(rows, "calibrated double, realised double, expected_return double"), decisions.threshold_grid(spark)).collect()}
    assert len(got) == 36
    full = [x for x in rows if x[0] is not None and x[1] is not None]
    for b, r in got.items():
        own = [x[1] for x in full if x[0] >= b and x[2] >= decisions.ROUND_TRIP * decisions.FLOOR_MARGIN]
        assert r["n_trades"] == len(own) and r["trade_rate"] == pytest.approx(len(own) / 400)
        assert r["net_total"] == pytest.approx((sum(own) - decisions.ROUND_TRIP * len(own)) / 400) and (not own or r["gross"] == pytest.approx(np.mean(own)) and r["hit_rate"] == pytest.approx(np.mean([x > 0 for x in own])))


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1.0, 0.8), (0.0, 0.8), (1.0, 0.9), (0.0, 0.1)], "y double, p double")
    m = metrics.classification_metrics(df, "y", "p", []).first()
    assert m["auc"] == 0.875 and m["base_rate"] == 0.5
    one = metrics.classification_metrics(df.filter("y = 1"), "y", "p", []).first()
    assert one["auc"] is None
    assert metrics.flag_suspicious(metrics.classification_metrics(df, "y", "p", [])).first()["flags"][0] == "AUC_IMPLAUSIBLE"


def test_ledger_reconciles_over_a_split(spark):
    fills = spark.createDataFrame([("A", date(2023, 1, 2), 1, "BUY", 10.0, 100.0, 1.0, 1.0), ("A", date(2023, 1, 4), 2, "SELL", 20.0, 60.0, 1.0, 2.0)], "symbol string, date date, seq int, side string, shares_filled double, price double, total_cost double, split_ratio double")
    led = portfolio.position_ledger(fills).orderBy("seq").collect()
    assert led[1]["shares"] == 0 and led[1]["realised"] == 200.0 and led[0]["cost_basis"] == 100.0
    closes = spark.createDataFrame([("A", date(2023, 1, 2), 101.0), ("A", date(2023, 1, 4), 60.0)], "symbol string, date date, close double")
    daily = portfolio.snapshots(portfolio.position_ledger(fills), closes, 5000.0)
    assert portfolio.reconcile(daily, 5000.0).count() == 0
    assert [round(r["equity"], 6) for r in daily.orderBy("date").collect()] == [5009.0, 5198.0]


def test_buy_and_hold(spark, bars):
    b = bars.select("symbol", "date", F.col("open_split").alias("open"), F.col("close_split").alias("close"))
    fills = portfolio.equal_weight_fills(b, 1e6)
    assert fills.agg(F.sum(F.col("shares_filled") * F.col("price"))).first()[0] <= 999_000
    daily = portfolio.snapshots(portfolio.position_ledger(fills), b.select("symbol", "date", "close"), 1e6)
    assert daily.count() == 420 and portfolio.reconcile(daily, 1e6).count() == 0


def test_false_discovery_and_cooldown(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.04), ("d", 0.9), ("e", None)], "feature string, p double").withColumn("g", F.lit(0))
    assert [r["feature"] for r in monitoring.benjamini_hochberg(df, "p", ["g"]).filter("discovered").orderBy("feature").collect()] == ["a", "b"]
    days = [("X", date(2023, 1, d)) for d in (1, 2, 4, 5, 6, 9, 10)]
    got = monitoring.emitted_alerts(spark.createDataFrame(days, "code string, day date"))
    assert sorted(r["day"].day for r in got.collect()) == [1, 4, 9]  # held back less than three days after the last one sent


def test_drift_is_found_where_it_is(spark):
    rng = np.random.default_rng(0)
    rows = [("reference" if i < 1000 else "current", float(rng.normal(i >= 1000, 1)), float(rng.normal())) for i in range(2000)]
    got = {r["feature"]: r for r in monitoring.compute_drift(spark.createDataFrame(rows, "part string, f0 double, f1 double"), ["f0", "f1"]).collect()}
    assert got["f0"]["severity"] == "SIGNIFICANT" and got["f0"]["discovered"] and got["f1"]["severity"] == "STABLE" and not got["f1"]["discovered"]


def test_candidates_and_verdicts(spark):
    p = spark.createDataFrame([(0.60, 0.03, 0.1, 600, 0.55, 0.03, 0.1, 600), (0.50, 0.09, 0.0, 10, 0.55, 0.03, 0.1, 600), (0.55, 0.05, 0.1, 600, 0.55, 0.03, 0.1, 600)], "candidate_auc double, candidate_ece double, candidate_sharpness double, candidate_n int, incumbent_auc double, incumbent_ece double, incumbent_sharpness double, incumbent_n int")
    assert [len(r["failed_checks"]) for r in monitoring.validate_candidates(p).collect()] == [0, 4, 0]  # equal AUC is not worse
    rows = [
        ((1, 9, 45, True, True, 900), ("BLOCKED", "DATA_QUALITY_SUSPECTED", False)),
        ((0, 8, 45, False, False, 900), ("HEALTHY", "DRIFT_ONLY_MODEL_COPING", False)),
        ((0, 9, 45, False, False, 900), ("WARNING", "DRIFT_ONLY_MODEL_COPING", False)),
        ((0, 0, 45, False, False, 10), ("HEALTHY", "NONE", False)),
        ((0, 0, 0, False, False, 10), ("HEALTHY", "NONE", False)),
        ((0, 0, 45, True, False, 499), ("DEGRADED", "LIKELY_RELATIONSHIP_CHANGE", False)),
        ((0, 0, 45, False, True, 500), ("RETRAIN_REQUIRED", "LIKELY_RELATIONSHIP_CHANGE", True)),
        ((0, 3, 45, True, True, 900), ("RETRAIN_REQUIRED", "LIKELY_REGIME_CHANGE", True)),
        ((0, 3, 45, True, False, 9), ("DEGRADED", "LIKELY_REGIME_CHANGE", False)),
    ]
    s = spark.createDataFrame([(i, *r[0]) for i, r in enumerate(rows)], "i int, dq_errors int, drifted_features int, n_features int, degraded boolean, calibration_drift boolean, n_resolved int")
    got = monitoring.retraining_verdict(s).orderBy("i").collect()
    assert [(r["state"], r["diagnosis"], r["should_retrain"]) for r in got] == [r[1] for r in rows]


def test_calibration_is_judged_on_the_longest_reportable_window(spark):
    df = spark.createDataFrame([(7, 400, 0.2, True), (30, 900, 0.04, True), (60, 900, 0.2, True), (90, 2000, 0.3, False)], "days int, n long, ece double, reportable boolean")
    assert monitoring.calibration_verdict(df, 0.03).first()[:] == (30, 0.04, False)
    assert monitoring.calibration_verdict(df.filter("days <> 30"), 0.03).first()["drifted"]
    assert not monitoring.calibration_verdict(df.filter("days <> 30"), 0.15).first()["drifted"]
    assert monitoring.calibration_verdict(df.filter("not reportable"), 0.03).first()[:] == (None, None, False)


def test_stages(spark):
    path = ["CANDIDATE", "VALIDATING", "VALIDATED", "STAGING", "PRODUCTION", "ARCHIVED"]
    moves = [("ok", s, i) for i, s in enumerate(path)]
    moves += [("early", s, i) for i, s in enumerate(["CANDIDATE", "VALIDATING", "VALIDATED", "ARCHIVED"])] + [("staged", s, i) for i, s in enumerate(["CANDIDATE", "VALIDATING", "VALIDATED", "STAGING", "ARCHIVED"])]
    moves += [("jump", "CANDIDATE", 0), ("jump", "PRODUCTION", 1), ("undead", "CANDIDATE", 0), ("undead", "FAILED", 1), ("undead", "VALIDATING", 2), ("born late", "STAGING", 0)]
    df = spark.createDataFrame(moves, "model_version string, to_stage string, occurred_at int")
    assert sorted((r["model_version"], r["to_stage"]) for r in records.illegal_transitions(spark, df).collect()) == [("born late", "STAGING"), ("jump", "PRODUCTION"), ("undead", "VALIDATING")]
    live = [("t", "a", "PRODUCTION", 1), ("t", "b", "PRODUCTION", 2), ("t", "a", "ARCHIVED", 3), ("t", "c", "STAGING", 4), ("t", "b", "ARCHIVED", 5), ("t", "c", "PRODUCTION", 5), ("u", "d", "PRODUCTION", 2)]
    got = records.shared_production(spark.createDataFrame(live, "task string, model_version string, to_stage string, occurred_at int")).collect()
    assert [(r["model_version"], r["n_live"]) for r in got] == [("b", 2)]


def test_confidence_sizes_start_at_half(spark):
    df = spark.createDataFrame([("BUY", 0.55, 0.2, None), ("BUY", 0.775, 0.2, None), ("BUY", 1.0, 0.2, None), ("SELL", 0.1, 0.2, 0.0), ("HOLD", 0.5, 0.2, None)], "signal string, calibrated_probability double, volatility double, target_weight double")
    assert [r["target_weight"] and round(r["target_weight"], 9) for r in decisions.size_positions(df, "confidence").collect()] == [0.05, 0.075, 0.1, 0.0, None]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), float("-inf")])
def test_expected_returns_must_be_finite(spark, bad):
    signals = spark.createDataFrame([(date(2023, 1, 2), "A")], "date date, symbol string")
    returns = spark.createDataFrame([(date(2023, 1, 2), "A", bad)], "date date, symbol string, y_pred double")
    with pytest.raises(Exception, match="expected return"):
        records.attach_expected_returns(signals, returns).collect()


def test_meta_features_refuse_repeated_keys(spark):
    one = spark.createDataFrame([(date(2023, 1, 2), "A", 1.0, 0.5), (date(2023, 1, 3), "A", 0.0, 0.4)], "date date, symbol string, y_true double, y_pred double")
    assert records.meta_features({"a": one, "b": one}).count() == 2
    with pytest.raises(Exception, match="b has a date and symbol twice"):
        records.meta_features({"a": one, "b": one.unionByName(one.limit(1))}).collect()


def test_ratios_are_zero_where_returns_do_not_vary(spark):
    curve = spark.createDataFrame([(n, date(2023, 1, 1 + i), e, 0.0, 0.0) for n, es in (("flat", [1.0] * 4), ("short", [1.0, 1.1]), ("one loss", [1.0, 0.9, 1.2])) for i, e in enumerate(es)], "name string, date date, equity double, exposure double, turnover double")
    got = {r["name"]: (round(r["sharpe"], 6), round(r["sortino"], 6)) for r in portfolio.performance_metrics(curve).collect()}
    r = np.array([-0.1, 1.2 / 0.9 - 1])
    assert got == {"flat": (0.0, 0.0), "short": (0.0, 0.0), "one loss": (round(float(r.mean() / r.std(ddof=1) * np.sqrt(252)), 6), 0.0)}


def test_records(spark):
    df = spark.createDataFrame([("A", date(2023, 1, 2), "m", "f", "d", "t")], "symbol string, prediction_date date, model_version string, feature_version string, decision_version string, threshold_version string")
    import hashlib

    assert records.natural_id(df).first()["prediction_id"] == hashlib.sha256(b"A|2023-01-02|m|f|d|t").hexdigest()[:32]
    bad = spark.createDataFrame([("BUY", 0.5, 0.5, date(2023, 1, 2), date(2023, 1, 3)), ("NO", 0.5, 0.5, date(2023, 1, 2), date(2023, 1, 3)), ("BUY", 1.5, 0.5, date(2023, 1, 2), date(2023, 1, 3)), ("BUY", 0.5, 0.5, date(2023, 1, 2), date(2023, 1, 2))], "signal string, predicted_probability double, calibrated_probability double, prediction_date date, execution_date date")
    assert sorted(r["reason"] for r in records.domain_violations(bad).collect()) == ["EXECUTION_DATE", "PROBABILITY", "SIGNAL"]
    t = spark.createDataFrame([(date(2023, 1, i), 1.0 * i) for i in range(1, 9)], "date date, x double")
    assert records.fingerprint(t, ["x"]).first() == records.fingerprint(t.repartition(5).orderBy(F.desc("x")), ["x"]).first()
    lock = records.fingerprint(t, ["x"]).withColumn("locked_at", F.lit(5))
    later = t.withColumn("ingested_at", F.lit(1)).unionByName(t.limit(2).withColumn("ingested_at", F.lit(9)))
    assert records.verify_lock(later, lock, ["x"]).first()["intact"]
    q = spark.createDataFrame([(0.975,), (0.5,), (1.0,)], "p double").select(normal.quantile("p").alias("z")).collect()
    assert round(q[0]["z"], 4) == 1.96 and q[1]["z"] == 0 and q[2]["z"] is None


def test_lake_round_trips(spark, bars, tmp_path):
    root = f"{tmp_path}/bars"
    tables.write_bars(bars, root)
    tables.write_bars(bars.filter("symbol = 'A'").limit(5), root)
    assert tables.read_bars(spark, root).filter("symbol = 'A'").count() == 5
    assert tables.read_bars(spark, root, ["B"]).count() == 420
    plan = tables.read_bars(spark, root, ["B"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "symbol" in plan.split("PartitionFilters: [")[1][:60]
    tables.write_features(bars, f"{tmp_path}/f", "f1")
    assert tables.read_panel(spark, f"{tmp_path}/f", "f1").count() == 840
    eq = spark.createDataFrame([(date(2023, 1, 2), 1.5, 0.5)], tables.EQUITY)
    tables.write_csv(eq, f"{tmp_path}/eq")
    assert tables.read_equity_csv(spark, f"{tmp_path}/eq").collect() == eq.collect()
    f = spark.createDataFrame([("I", "A", "UP", 0.1, 0.6, date(2023, 1, 3), date(2023, 1, 2), datetime(2023, 1, 2, 9)), ("I", "A", "DOWN", 0.1, 0.6, date(2023, 1, 3), date(2023, 1, 2), datetime(2023, 1, 2, 10))], tables.FORECASTS)
    first = tables.append_forecasts(f.limit(0), f)
    first.write.json(f"{tmp_path}/fc")
    assert [r["direction"] for r in tables.read_forecasts(spark, f"{tmp_path}/fc").collect()] == ["UP"]
    assert tables.append_forecasts(first, f).count() == 0


def make_ticks(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 2, 9, 15)
    return spark.createDataFrame([(i, rng.choice("AB"), start + timedelta(seconds=17 * i), 100 + rng.random()) for i in range(600)], "event_id long, symbol string, ts timestamp, price double")


def test_stream_of_candles_equals_batch(spark, tmp_path):
    ticks = make_ticks(spark)
    sentinel = spark.createDataFrame([(10_000, "A", datetime(2024, 1, 5), 1.0)], ticks.schema)
    ticks.repartition(4).write.parquet(f"{tmp_path}/in")
    sentinel.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    q = candles.candles(stream, "5m", "10 minutes").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = candles.candles(ticks, "5m")
    assert got.count() == want.count() and want.exceptAll(got.select(*want.columns)).count() == 0


def test_stream_upserts(spark, tmp_path):
    ticks = make_ticks(spark)
    ticks.filter("event_id < 400").write.parquet(f"{tmp_path}/in")
    run = lambda checkpoint: candles.keep_upserting(candles.candles(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"), "15m", "1 hour"), f"{tmp_path}/t", f"{tmp_path}/{checkpoint}").awaitTermination(120)
    run("c")
    first = {p.name for p in (tmp_path / "t").glob("query=*/batch=*")}
    ticks.filter("event_id >= 400").write.mode("append").parquet(f"{tmp_path}/in")
    run("c")
    want = candles.candles(ticks, "15m")
    got = candles.read_upserted(spark, f"{tmp_path}/t").select(*want.columns)
    assert first and got.count() == want.count() and want.exceptAll(got).count() == 0
    # A query that begins anew adds its batches to the history instead of replacing it.
    run("other")
    assert len(list((tmp_path / "t").glob("query=*"))) == 2
    got = candles.read_upserted(spark, f"{tmp_path}/t").select(*want.columns)
    assert got.count() == want.count() and want.exceptAll(got).count() == 0


def test_models_out_of_fold(spark):
    rng = np.random.default_rng(5)
    rows = [(date(2019, 1, 1) + timedelta(days=i), s, *(x := rng.normal(size=3)).tolist(), float(x[0] + 0.5 * rng.normal() > 0), float(0.01 * x[0] + 0.005 * rng.normal())) for i in range(420) for s in "AB"]
    df = spark.createDataFrame(rows, "date date, symbol string, f1 double, f2 double, f3 double, y double, r double")
    index = calendar.session_index(df)
    assigned = folds.assign_folds(df, folds.fold_bounds(spark, index.count(), 2, 60, min_train=100), index).cache()
    oof = models.generate_oof(assigned, models.fit_logistic(), ["f1", "f2", "f3"], "y").cache()
    assert oof.count() == 240 and records_unique(oof)
    m = metrics.classification_metrics(oof, "y_true", "y_pred", ["fold"]).collect()
    assert all(r["auc"] > 0.85 for r in m)
    ridge = models.walk_forward(assigned, models.fit_ridge(), ["f1", "f2", "f3"], "r", lambda o: metrics.regression_metrics(o, "y_true", "y_pred", []))
    assert ridge.first()["information_coefficient"] > 0.7
    loss = lambda o: metrics.classification_metrics(o, "y_true", "y_pred", ["fold"]).select("fold", F.col("log_loss").alias("value"))
    nested = models.nested_walk_forward(df, {"noise": models.fit_logistic(1e-6), "good": models.fit_logistic(), "same": models.fit_logistic()}, ["f1"], "y", loss, 1, 60, 300, 2, maximise=False)
    assert {r["selected"] for r in nested.select("selected").distinct().collect()} == {"good"} and nested.count() == 120
    cal = models.calibrate_out_of_fold(oof, folds.date_blocks(oof, 4), min_rows=50)
    assert cal.filter("calibrated < 0 or calibrated > 1").count() == 0 and cal.count() == 180
    model = models.fit_logistic()(df, ["f1", "f2", "f3"], "y")
    table = models.coefficients({"m": model}, ["f1", "f2", "f3"], spark).collect()
    assert table[0]["feature"] == "f1" and table[0]["mean"] > 1
    drop = models.permutation_importance(model, df, ["f1", "f2"], lambda d: metrics.classification_metrics(d, "y", "y_pred", []).first()["auc"], repeats=1)
    assert drop["f1"] > 0.2 > abs(drop["f2"])


def closed_ridge(x, y, alpha):
    m = y.mean()
    w = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - m))
    return lambda z: z @ w + m


def closed_logistic(x, y, c):
    w = models._solve_logistic(x, y, c)
    return lambda z: 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))


def test_linear_models_match_closed_forms_on_given_rows(spark):
    """Out-of-fold scores of the given tables against numpy: medians and scales of the training rows, then normal equations or Newton steps."""
    columns, d = ["return_1d", "return_5d", "volatility_20"], "/root/testdata/sf0.001"
    df = panel_plans.simple_panel(spark, d).select("symbol", "date", *columns, "tradeable_return_1d", "tradeable_direction_1d")
    assigned = checks.assign(tables.settled(df.withColumn("return_5d", F.when(F.dayofmonth("date") != 7, F.col("return_5d")))))
    pdf = assigned.toPandas()
    for fit, label, solve in ((models.fit_ridge(), "tradeable_return_1d", lambda x, y: closed_ridge(x, y, 10.0)), (models.fit_logistic(), "tradeable_direction_1d", lambda x, y: closed_logistic(x, y, 1.0))):
        rows = pdf[pdf[label].notna()]
        got = {(r["date"], r["symbol"], r["fold"]): r["y_pred"] for r in models.generate_oof(assigned, fit, columns, label).collect()}
        assert len(got) == (rows["role"] == "val").sum() > 0
        for fold, own in rows.groupby("fold"):
            train, val = own[own["role"] == "train"], own[own["role"] == "val"]
            middle = train[columns].median()
            filled = train[columns].fillna(middle)
            x, z = (filled - filled.mean()) / filled.std(ddof=0), (val[columns].fillna(middle) - filled.mean()) / filled.std(ddof=0)
            want = solve(x.to_numpy(), train[label].to_numpy())(z.to_numpy())
            have = np.array([got[k] for k in zip(val["date"], val["symbol"], val["fold"], strict=True)])
            assert np.abs(have - want).max() < 1e-5 * max(1e-3, np.abs(want).max()) + 1e-7, (label, fold)


def records_unique(df):
    return folds.repeated_keys(df).count() == 0


def test_boosted_models_and_forecasts(spark, bars):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a), None if rng.random() < 0.1 else float(b), float(a * a + 0.1 * rng.normal() > 1)) for a, b in rng.normal(size=(1500, 2))], "a double, b double, y double")
    out = models.predict(models.fit_boosted_direction(trees=15, rate=0.3, least=20)(df, ["a", "b"], "y"), df)
    assert metrics.classification_metrics(out, "y", "y_pred", []).first()["auc"] > 0.95
    b = bars.select("symbol", "date", *[F.col(f"{c}_split").alias(c) for c in ("open", "high", "low", "close")])
    f = features.session_features(b)
    names = ["return_1", "return_5", "return_20", "session_return", "range", "gap", "volatility", "close_position"]
    got = models.forecast_symbols(f, names, least=300).collect()
    assert len(got) == 2 and all(0 < r["probability_up"] < 1 and r["direction"] in ("UP", "DOWN") for r in got)
    assert {r["refused"] for r in models.forecast_symbols(f, names, least=5000).collect()} == {"TOO_FEW_ROWS"}
