"""More queries over the derived panels: guards, comparisons, verdicts and ensembles, with SQL where it can express them."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from panelspark.functions.windows import by_symbol
from panelspark.operators import actions, calendar, ensemble, features, folds, metrics, models, monitoring, portfolio, records
from panelspark.plans import panel, sql
from panelspark.plans.panel import ORACLE_SQL, QUERIES, register, rounded  # noqa: F401
from panelspark.sources import tables

_CURVE = {"weights": panel._WEIGHTS, "daily": panel._DAILY, "curve": panel._CURVE}

# --- filters and guards ---------------------------------------------------------------------------------------------


@register("b8_valid_prices", sql.query("SELECT symbol, count(*) AS n FROM dirty WHERE close_split > 0 GROUP BY symbol", "wild", dirty=panel._DIRTY))
def b8(spark, d):
    return tables.valid_prices(panel.dirty_bars(spark, d), "close_split").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


DAY = date(1998, 3, 3)


@register("b14_day_slice", sql.query("SELECT symbol, date, round(p, 6) AS p FROM scores WHERE date = DATE '1998-03-03'", "scores"))
def b14(spark, d):
    return rounded(tables.slice_day(panel.scores(spark, d), DAY), ["p"])


@register("b6_locked_rows", sql.query("SELECT count(*) AS n FROM bars WHERE date >= DATE '1998-01-01'", "bars"))
def b6(spark, d):
    return folds.locked_rows(tables.bars_calm(spark, d), date(1998, 1, 1)).agg(F.count(F.lit(1)).alias("n"))


@register("d5_split_positions", sql.query("SELECT symbol, date, 100 * split_ratio AS shares, round(close_split / split_ratio, 6) AS cost_basis FROM bars", "bars"))
def d5(spark, d):
    held = tables.bars_calm(spark, d).select("symbol", "date", "split_ratio", F.lit(100.0).alias("shares"), F.col("close_split").alias("cost_basis"))
    return rounded(actions.adjust_for_split(held), ["cost_basis"], ("symbol", "date", "shares"))


#: For each symbol, the last bars before the cut whose next close lies behind it.
@register("e33_causality", sql.query("SELECT 'planted_next_close' AS feature, count(*) AS n FROM (SELECT date, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS later FROM bars) WHERE date < DATE '1997-01-01' AND later >= DATE '1997-01-01'", "bars"))
def e33(spark, d):
    """All window features, and one that looks ahead on purpose: the only one to be reported."""
    names = [*sql.RETURNS, *sql.TECHNICAL, *sql.VOLATILITY, *sql.VOLUME, *sql.LATER, "planted_next_close"]

    def build(bars):
        return features.window_features(bars).withColumn("planted_next_close", F.lead("adj_close").over(by_symbol()))

    return features.causality_violations(panel.enriched(spark, d), build, names, date(1997, 1, 1))


@register("g2_key_differences", sql.query("SELECT 'b' AS name, count(*) FILTER (day(date) = 4) AS missing, count(*) FILTER (day(date) = 5) AS extra FROM scores", "scores"))
def g2(spark, d):
    s = panel.scores(spark, d)
    return records.key_differences({"a": s.filter(F.dayofmonth("date") != 5), "b": s.filter(F.dayofmonth("date") != 4)})


@register("g4_expected_returns", sql.query("SELECT symbol, date, round(p, 6) AS p, round(e, 6) + 0.0 AS expected_return FROM scores", "scores"))
def g4(spark, d):
    s = panel.scores(spark, d)
    return rounded(records.attach_expected_returns(s.select("date", "symbol", "p"), s.select("date", "symbol", F.col("e").alias("y_pred"))), ["p", "expected_return"])


@register("l6_same_session_executions", sql.query("SELECT symbol, date FROM bars WHERE day(date) = 8", "bars"))
def l6(spark, d):
    day = F.dayofmonth("date")
    fills = tables.bars_calm(spark, d).select("symbol", "date", F.col("date").alias("decision_date"), F.date_add("date", F.when(day == 8, 0).otherwise(1)).alias("execution_date"))
    return portfolio.same_session_executions(fills).select("symbol", "date")


# --- comparisons ----------------------------------------------------------------------------------------------------

_BOTH = "SELECT 'up' AS model, p, y FROM scores UNION ALL SELECT 'down', 1 - p, y FROM scores"
_BY_MODEL = panel._METRIC.replace("symbol", "model").replace("FROM scores", "FROM both_models")


def both_models(spark, d):
    s = panel.scores(spark, d)
    return s.select(F.explode(F.array(F.struct(F.lit("up").alias("model"), F.col("p").alias("y_pred")), F.struct(F.lit("down").alias("model"), (1 - F.col("p")).alias("y_pred")))).alias("m"), F.col("y").alias("y_true")).select("m.*", "y_true")


@register("h9_compare_models", sql.query("SELECT model, n, round(auc, 6) AS auc, round(brier, 6) AS brier FROM m2", "scores", both_models=_BOTH, m=_BY_MODEL, m2=panel._METRIC2))
def h9(spark, d):
    return rounded(metrics.compare_models(both_models(spark, d)), ["auc", "brier"], ("model", "n"))


@register("h7_suspicious_results", sql.query("SELECT model, concat_ws(',', CASE WHEN auc > 0.65 THEN 'AUC_IMPLAUSIBLE' END, CASE WHEN auc > 0.58 AND auc <= 0.65 THEN 'AUC_HIGH' END, CASE WHEN skill_vs_majority > 0.1 THEN 'SKILL_HIGH' END) AS flags FROM m2", "scores", both_models=_BOTH, m=_BY_MODEL, m2=panel._METRIC2))
def h7(spark, d):
    flagged = metrics.flag_suspicious(metrics.classification_metrics(both_models(spark, d), "y_true", "y_pred", ["model"]))
    return flagged.select("model", F.concat_ws(",", "flags").alias("flags"))


@register("h16_calibration_comparison", sql.query("SELECT stage, count(*) AS n, round(avg(s), 6) AS mean_predicted, round(avg((s - y) ** 2), 6) AS brier, round(stddev_pop(s), 6) AS sharpness, round(avg(s) - avg(y), 6) + 0.0 AS bias FROM (SELECT 'raw' AS stage, p AS s, y FROM scores UNION ALL SELECT 'calibrated', 0.25 + p / 2, y FROM scores) GROUP BY stage", "scores"))
def h16(spark, d):
    s = panel.scores(spark, d).select(F.col("y").alias("y_true"), F.col("p").alias("raw"), (0.25 + F.col("p") / 2).alias("calibrated"))
    return rounded(metrics.calibration_comparison(s), ["mean_predicted", "brier", "sharpness", "bias"], ("stage", "n"))


@register("h26_cost_totals", sql.query("SELECT component, round(sum(turnover) * bps / 10000, 6) AS total FROM daily, (VALUES ('commission', 3.0::DOUBLE), ('spread', 5.0::DOUBLE), ('slippage', 5.0::DOUBLE)) c(component, bps) GROUP BY component, bps", "scores", **_CURVE))
def h26(spark, d):
    return rounded(portfolio.cost_totals(portfolio.strategy_returns(panel.weights(spark, d))), ["total"], ("component",))


# --- monitoring -----------------------------------------------------------------------------------------------------

AS_OF = date(1998, 6, 30)
_WINDOWS = "SELECT CAST(days AS INTEGER) AS days, p, y FROM scores, (SELECT unnest([7, 30, 60, 90]) AS days) WHERE date <= DATE '1998-06-30' AND date > DATE '1998-06-30' - CAST(days AS INTEGER)"
_BY_DAYS = panel._METRIC.replace("symbol", "days").replace("FROM scores", "FROM in_window")


@register("m8_degradation", sql.query("SELECT days, round(auc, 6) AS auc, round(0.55 - auc, 6) + 0.0 AS drop, 0.55 - auc > 0 AND 0.55 - auc >= 2 * sqrt(4.0::DOUBLE / n) AS degraded FROM m2 WHERE n >= 100 ORDER BY days DESC LIMIT 1", "scores", in_window=_WINDOWS, m=_BY_DAYS, m2=panel._METRIC2))
def m8(spark, d):
    perf = monitoring.rolling_performance(panel.resolved(spark, d), AS_OF)
    return rounded(monitoring.degradation(perf, 0.55), ["auc", "drop"], ("days", "degraded"))


@register("m9_calibration_windows", sql.query("SELECT days, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS base_rate, count(*) >= 300 AS reportable FROM in_window GROUP BY days", "scores", in_window=_WINDOWS))
def m9(spark, d):
    return rounded(monitoring.monitor_calibration(panel.resolved(spark, d), AS_OF, 0.03), ["mean_predicted", "base_rate"], ("days", "n", "reportable"))


_RUNS = "SELECT event_type, CAST(ts AS DATE) AS day, count(*) FILTER (value > 45) AS dq_errors, count(*) FILTER (value > 30) AS drifted_features, count(*) AS n_features, avg(value) > 10 AS degraded, max(value) > 42 AS calibration_drift, 25 * count(*) AS n_resolved FROM events GROUP BY ALL"


@register(
    "m10_retraining_verdicts",
    f"""SELECT event_type, day, CASE WHEN dq_errors > 0 THEN 'BLOCKED' WHEN sick AND n_resolved >= 500 THEN 'RETRAIN_REQUIRED' WHEN sick THEN 'DEGRADED' WHEN drifted_features >= 0.2::DOUBLE * n_features THEN 'WARNING' ELSE 'HEALTHY' END AS state,
CASE WHEN dq_errors > 0 THEN 'DATA_QUALITY_SUSPECTED' ELSE CASE WHEN sick THEN CASE WHEN drifted_features > 0 THEN 'LIKELY_REGIME_CHANGE' ELSE 'LIKELY_RELATIONSHIP_CHANGE' END WHEN drifted_features > 0 THEN 'DRIFT_ONLY_MODEL_COPING' ELSE 'NONE' END END AS diagnosis,
dq_errors = 0 AND sick AND n_resolved >= 500 AS should_retrain FROM (SELECT *, degraded OR calibration_drift AS sick FROM ({_RUNS}))""",
)
def m10(spark, d):
    over = lambda x: F.count(F.when(F.col("value") > x, 1))
    runs = tables.read_table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day"))
    runs = runs.agg(over(45).alias("dq_errors"), over(30).alias("drifted_features"), F.count(F.lit(1)).alias("n_features"), (F.avg("value") > 10).alias("degraded"), (F.max("value") > 42).alias("calibration_drift"), (25 * F.count(F.lit(1))).alias("n_resolved"))
    return monitoring.retraining_verdict(runs).select("event_type", "day", "state", "diagnosis", "should_retrain")


_PAIRS = "SELECT o_custkey AS k, max(o_totalprice) / 1e6 AS a1, avg(o_totalprice) / 1e6 AS a2, min(o_totalprice) / 1e6 AS e1, 0.02::DOUBLE AS e2, coalesce(stddev_samp(o_totalprice), 0) / 1e8 AS s1, 50 * count(*) AS n1 FROM orders GROUP BY o_custkey"


@register("m11_candidates", f"SELECT k, concat_ws(',', CASE WHEN a1 < a2 THEN 'AUC' END, CASE WHEN e1 > e2 + 0.02 THEN 'ECE' END, CASE WHEN s1 <= 0.001 THEN 'SHARPNESS' END, CASE WHEN n1 < 500 THEN 'OBSERVATIONS' END) AS failed, a1 >= a2 AND e1 <= e2 + 0.02 AND s1 > 0.001 AND n1 >= 500 AS passed FROM ({_PAIRS})")
def m11(spark, d):
    x = "o_totalprice"
    pairs = tables.read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        (F.max(x) / 1e6).alias("candidate_auc"), (F.avg(x) / 1e6).alias("incumbent_auc"), (F.min(x) / 1e6).alias("candidate_ece"), F.lit(0.02).alias("incumbent_ece"),
        (F.coalesce(F.stddev_samp(x), F.lit(0.0)) / 1e8).alias("candidate_sharpness"), (50 * F.count(F.lit(1))).alias("candidate_n"),
    )
    return monitoring.validate_candidates(pairs).select("k", F.concat_ws(",", "failed_checks").alias("failed"), "passed")


@register("m12_emitted_alerts", "WITH RECURSIVE days AS (SELECT DISTINCT event_type AS code, CAST(ts AS DATE) AS day FROM events WHERE value > 30), kept AS (SELECT code, min(day) AS day FROM days GROUP BY code UNION ALL SELECT kept.code, min(days.day) FROM kept JOIN days ON days.code = kept.code AND days.day >= kept.day + 3 GROUP BY kept.code) SELECT code, day FROM kept")
def m12(spark, d):
    return panel.m12(spark, d)


_SUMMARISED = f"SELECT count(*) AS n_features, count(*) FILTER (n_reference >= 100 AND n_current >= 100) AS n_measurable, count(*) FILTER (psi >= 0.25) AS n_significant, count(*) FILTER (psi >= 0.1 AND psi < 0.25) AS n_moderate, count(*) FILTER (ks_p < 0.05) AS n_ks_naive, count(*) FILTER (discovered) AS n_ks_fdr, {sql.rounded(['max_psi', 'mean_psi', 'max_missing_rate'])} FROM (SELECT *, max(psi) OVER () AS max_psi, avg(psi) OVER () AS mean_psi, max(current_missing) OVER () AS max_missing_rate FROM drifted) GROUP BY max_psi, mean_psi, max_missing_rate"


@register("m6_drift_summary", sql.query(_SUMMARISED, "scores", **panel._DRIFT))
def m6(spark, d):
    return rounded(monitoring.summarise_drift(panel.drift(spark, d)), ["max_psi", "mean_psi", "max_missing_rate"], ("n_features", "n_measurable", "n_significant", "n_moderate", "n_ks_naive", "n_ks_fdr"))


# --- records --------------------------------------------------------------------------------------------------------


def faulty_predictions(spark, d):
    day = F.dayofmonth("prediction_date")
    p = panel.predictions(spark, d).withColumn("signal", F.when(day == 3, "WAIT").when(F.col("predicted_probability") >= 0.5, "BUY").otherwise("HOLD"))
    p = p.withColumn("predicted_probability", F.when(day == 6, 1.5).otherwise(F.col("predicted_probability"))).withColumn("execution_date", F.when(day == 9, F.col("prediction_date")).otherwise(F.col("execution_date")))
    return p.withColumn("training_end", F.when(day == 12, F.col("prediction_date")).when(day != 14, F.date_sub("prediction_date", 30)))


@register("n3_domain_violations", sql.query("SELECT symbol, date AS prediction_date, CASE day(date) WHEN 3 THEN 'SIGNAL' WHEN 6 THEN 'PROBABILITY' ELSE 'EXECUTION_DATE' END AS reason FROM scores WHERE day(date) IN (3, 6, 9)", "scores"))
def n3(spark, d):
    return records.domain_violations(faulty_predictions(spark, d)).select("symbol", "prediction_date", "reason")


@register("n4_temporal_violations", sql.query("SELECT symbol, date AS prediction_date FROM scores WHERE day(date) IN (12, 14)", "scores"))
def n4(spark, d):
    return records.temporal_violations(faulty_predictions(spark, d)).select("symbol", "prediction_date")


@register("b9_pending_predictions", sql.query("SELECT symbol, prediction_date FROM preds WHERE status = 'PREDICTED' AND execution_date <= DATE '1998-06-30'", "scores", preds=panel._PREDS))
def b9(spark, d):
    return records.pending(panel.predictions(spark, d), AS_OF).select("symbol", "prediction_date")


_OPEN = "NOT year(prediction_date) < 1998"


@register(
    "h21_resolution_summary",
    sql.query(f"SELECT count(*) AS due, count(*) FILTER (NOT ({_OPEN})) AS resolved, count(*) FILTER ({_OPEN} AND age <= 20) AS pending, count(*) FILTER ({_OPEN} AND age > 20) AS unresolvable, min(execution_date) FILTER ({_OPEN}) AS oldest_pending FROM (SELECT *, DATE '1998-06-30' - CAST(execution_date AS DATE) AS age FROM preds WHERE status = 'PREDICTED' AND execution_date <= DATE '1998-06-30')", "scores", preds=panel._PREDS),
)
def h21(spark, d):
    p = panel.predictions(spark, d)
    return records.resolution_summary(p, p.filter(F.year("prediction_date") < 1998).select("prediction_id"), AS_OF)


@register("b10_resolved_since", sql.query("SELECT symbol, prediction_date, round(realised, 6) + 0.0 AS actual_return FROM preds WHERE year(prediction_date) >= 1998", "scores", preds=panel._PREDS))
def b10(spark, d):
    p = panel.predictions(spark, d)
    real = panel.scores(spark, d).select("symbol", F.col("date").alias("prediction_date"), F.col("realised").alias("actual_return"))
    out = p.join(real, ["symbol", "prediction_date"]).select("prediction_id", "actual_return")
    return rounded(records.resolved_since(records.resolved_view(p, out), date(1998, 1, 1)), ["actual_return"], ("symbol", "prediction_date"))


@register("i10_latest_runs", f"SELECT experiment_id, task, primary_value FROM (SELECT o_custkey AS experiment_id, o_custkey % 7 AS task, round(avg(o_totalprice) / 1e6, 6) AS primary_value, min(o_orderdate) AS c FROM orders GROUP BY o_custkey) ORDER BY c DESC, experiment_id LIMIT 500")  # noqa: F541
def i10(spark, d):
    return records.latest_rows(panel.runs(spark, d), "created_at", 500, "experiment_id").select("experiment_id", "task", "primary_value")


_BOARD = "SELECT o_custkey AS experiment_id, o_custkey % 7 AS task, round(avg(o_totalprice) / 1e6, 6) AS v, min(o_orderdate) AS c FROM orders GROUP BY o_custkey"


@register("n10_distinguishable_runs", f"SELECT experiment_id, task, CAST(rank() OVER (PARTITION BY task ORDER BY v DESC) AS INTEGER) AS rank, max(v) OVER (PARTITION BY task) - v > {2 * records.STDERR * 2**0.5!r} AS distinguishable, CAST(row_number() OVER (PARTITION BY task ORDER BY c, experiment_id) - 1 AS INTEGER) AS n_prior FROM ({_BOARD})")
def n10(spark, d):
    return records.leaderboard(panel.runs(spark, d)).select("experiment_id", "task", "rank", "distinguishable", "n_prior")


# --- models ---------------------------------------------------------------------------------------------------------


def model_panel(spark, d):
    """Rows with their folds and roles, as the model queries of the panel take them."""
    df = panel.simple_panel(spark, d).select("symbol", "date", *panel.MODEL_FEATURES, "tradeable_direction_1d", "tradeable_return_1d")
    return tables.settled(assign(tables.settled(df)))


def assign(df):
    index = calendar.session_index(df)
    return folds.assign_folds(df, folds.fold_bounds(df.sparkSession, index.count()), index)


@register("j5_baselines", sql.query("SELECT symbol, date, CAST(fold AS INTEGER) AS fold, round((SELECT avg(tradeable_direction_1d) FROM roles r WHERE r.role = 'train' AND r.fold = roles.fold), 6) AS mean_pred, CASE WHEN coalesce(return_1d, 0) > 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS momentum_pred FROM roles WHERE role = 'val'", "trimmed", roles=panel.MODEL_ROLES))
def j5(spark, d):
    return rounded(models.baselines(model_panel(spark, d), "tradeable_direction_1d"), ["mean_pred", "momentum_pred"], ("symbol", "date", "fold"))


@register("j3_boosted_out_of_fold")
def j3(spark, d):
    return models.generate_oof(model_panel(spark, d), models.fit_boosted_direction(), panel.MODEL_FEATURES, "tradeable_direction_1d")


@register("j4_boosted_return_out_of_fold")
def j4(spark, d):
    return models.generate_oof(model_panel(spark, d), models.fit_boosted_return(), panel.MODEL_FEATURES, "tradeable_return_1d")


@register("j16_permutation_importance")
def j16(spark, d):
    """How much AUC the last fold's validation rows lose when a feature's values change places."""
    rows = model_panel(spark, d).filter("tradeable_direction_1d is not null")
    last = rows.agg(F.max("fold")).first()[0]
    own = rows.filter(F.col("fold") == last)
    model = models.fit_boosted_direction()(own.filter("role = 'train'"), panel.MODEL_FEATURES, "tradeable_direction_1d")
    auc = lambda df: metrics.classification_metrics(df, "tradeable_direction_1d", "y_pred", []).first()["auc"]
    val = tables.settled(own.filter("role = 'val'").select("symbol", "date", *panel.MODEL_FEATURES, "tradeable_direction_1d"))
    drops = models.permutation_importance(model, val, panel.MODEL_FEATURES, auc)
    return spark.createDataFrame(sorted(drops.items()), "feature string, importance double")


@register("j7_nested_selection")
def j7(spark, d):
    """Ridge strengths chosen within each fold by the error on inner folds."""
    df = tables.settled(panel.simple_panel(spark, d).select("symbol", "date", *panel.MODEL_FEATURES, "tradeable_return_1d"))
    error = lambda o: metrics.absolute_error(o, "y_true", "y_pred", ["fold"]).select("fold", F.col("mae").alias("value"))
    return models.nested_walk_forward(df, {"10": models.fit_ridge(10.0), "1000": models.fit_ridge(1000.0)}, panel.MODEL_FEATURES, "tradeable_return_1d", error, maximise=False)


def bases(spark, d):
    """Two base models' out-of-fold scores, settled: every fit above them reads them again."""
    rows = model_panel(spark, d)
    direction = models.generate_oof(rows, models.fit_logistic(), panel.MODEL_FEATURES, "tradeable_direction_1d")
    ridge = models.generate_oof(rows, models.fit_ridge(), panel.MODEL_FEATURES, "tradeable_return_1d")
    up = ridge.withColumn("y_true", (F.col("y_true") > 0).cast("double")).withColumn("y_pred", 1 / (1 + F.exp(-100 * F.col("y_pred"))))
    return {"logistic": tables.settled(direction), "ridge": tables.settled(up)}


def meta_folds(meta):
    return tables.settled(assign(meta))


@register("j8_stack_coefficients")
def j8(spark, d):
    meta = tables.settled(records.meta_features(bases(spark, d)))
    return ensemble.fit_stack(meta_folds(meta), ensemble.meta_columns(meta))[1]


@register("j12_ensemble_comparison")
def j12(spark, d):
    return ensemble.build_ensemble(bases(spark, d), meta_folds).comparison


@register("j13_production_scores")
def j13(spark, d):
    """The newest row of each symbol, scored by the stack of all labelled rows and its calibrator."""
    meta = tables.settled(records.meta_features(bases(spark, d)))
    columns = ensemble.meta_columns(meta)
    oof, _ = ensemble.fit_stack(meta_folds(meta), columns)
    return ensemble.fit_production(meta, oof, columns).score(tables.latest(meta, ["symbol"], [F.desc("date")]))


@register("j13_fresh_panel_scores")
def j13_fresh(spark, d):
    """Rows that have no label yet, scored by a bundle that was written under its version and loaded again."""
    df = panel.simple_panel(spark, d).select("symbol", "date", *panel.MODEL_FEATURES, "tradeable_direction_1d", "tradeable_return_1d")
    df = tables.settled(df)
    fits = {"boosted": models.fit_boosted_direction(), "logistic": models.fit_logistic()}
    known = df.filter("tradeable_direction_1d is not null")
    bundle = ensemble.fit_production_ensemble(assign(known), meta_folds, fits, models.fit_ridge(), panel.MODEL_FEATURES, "tradeable_direction_1d", "tradeable_return_1d", ("volatility_20",))
    at = bundle.save(f"{tables.work_folder(spark)}/bundles-{uuid.uuid4().hex}", spark)
    return ensemble.ProductionEnsemble.load(at, spark).score(df.filter("tradeable_direction_1d is null").drop("tradeable_direction_1d", "tradeable_return_1d"))
