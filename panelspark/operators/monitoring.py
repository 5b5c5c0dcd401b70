"""Drift, performance and calibration over time, and the verdicts drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.ordered import quantiles, running_before
from panelspark.operators.metrics import calibration_metrics, classification_metrics

WINDOWS = (7, 30, 60, 90)
PSI_WARNING, PSI_ALERT = 0.10, 0.25
MIN_DRIFT, MIN_PERFORMANCE, MIN_CALIBRATION = 100, 100, 300


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value), nulls kept."""
    return df.selectExpr(f"stack({len(columns)}, {', '.join(f"'{c}', cast({c} as double)" for c in columns)}) as (feature, value)")


def split_reference_current(panel: DataFrame, training_end=None, q: float = 0.75) -> DataFrame:
    """panel plus part: reference up to training_end, or else up to the q-percentile of its dates; current after."""
    if training_end is not None:
        return panel.withColumn("part", F.when(F.col("date") <= F.lit(training_end), "reference").otherwise("current"))
    cut = panel.agg(F.floor(F.expr(f"percentile(unix_date(date), {q})")).cast("int").alias("_cut"))
    return panel.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.unix_date("date") <= F.col("_cut"), "reference").otherwise("current")).drop("_cut")


def psi(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, psi) of (feature, part, value) with quantile edges of the reference and one added to each count."""
    rows = long.filter("value is not null")
    edges = quantiles(rows.filter("part = 'reference'"), ["feature"], "value", [i / n_bins for i in range(n_bins + 1)], "_e").withColumn("_e", F.array_distinct("_e"))
    inner = F.slice(F.col("_e"), 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    edges = edges.select("feature", F.when(F.size("_e") >= 3, inner).otherwise(F.array().cast("array<double>")).alias("_e"))
    binned = rows.join(edges, "feature").withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col("value")))).withColumn("_k", F.size("_e") + 1)
    n = lambda p: F.sum((F.col("part") == p).cast("long"))
    counts = binned.groupBy("feature", "_k", "bin").agg(n("reference").alias("r"), n("current").alias("c"))
    full = edges.select("feature", (F.size("_e") + 1).alias("_k"), F.explode(F.sequence(F.lit(0), F.size("_e"))).alias("bin")).join(counts.drop("_k"), ["feature", "bin"], "left").na.fill(0, ["r", "c"])
    w = Window.partitionBy("feature")
    share = lambda c: (F.col(c) + 1) / (F.sum(c).over(w) + F.col("_k"))
    full = full.withColumn("_r", share("r")).withColumn("_c", share("c"))
    return full.groupBy("feature").agg(F.sum((F.col("_c") - F.col("_r")) * F.log(F.col("_c") / F.col("_r"))).alias("psi"))


def ks(long: DataFrame) -> DataFrame:
    """(feature, ks, ks_p): two-sample statistic from distinct values, and its asymptotic p-value."""
    rows = long.filter("value is not null")
    n = lambda p: F.sum((F.col("part") == p).cast("long"))
    one = rows.groupBy("feature", "value").agg(n("reference").alias("r"), n("current").alias("c"))
    one = running_before(one, ["feature"], "value", {"_r": F.col("r"), "_c": F.col("c")})
    gap = F.abs((F.col("_r") + F.col("r")) / F.col("_r_total") - (F.col("_c") + F.col("c")) / F.col("_c_total"))
    out = one.withColumn("_g", gap).groupBy("feature").agg(F.max("_g").alias("ks"), F.sum("r").alias("_n"), F.sum("c").alias("_m"))
    x = F.col("ks") * F.sqrt(F.col("_n") * F.col("_m") / (F.col("_n") + F.col("_m")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return out.select("feature", "ks", F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))).alias("ks_p"))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """df plus discovered: p-values kept at false-discovery rate alpha within a group; null p is not."""
    w = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *[c for c in ("feature",) if c in df.columns])
    m = F.count(p).over(Window.partitionBy(*by))
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_ok", F.when(F.col(p) <= alpha * F.col("_i") / m, F.col("_i")))
    last = F.max("_ok").over(Window.partitionBy(*by))
    return df.withColumn("discovered", F.coalesce(F.col(p).isNotNull() & (F.col("_i") <= last), F.lit(False))).drop("_i", "_ok")


def compute_drift(panel: DataFrame, columns: list[str], n_bins: int = 10) -> DataFrame:
    """One row for each feature of a panel with ``part``; largest psi first. All features are one job. What isn't finite is missing."""
    long = panel.selectExpr("part", f"stack({len(columns)}, {', '.join(f"'{c}', cast({c} as double)" for c in columns)}) as (feature, value)")
    long = long.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")))
    of = lambda p, f: f(F.when(F.col("part") == p, F.col("value")))
    rate = lambda p: F.avg(F.when(F.col("part") == p, F.col("value").isNull().cast("double")))
    base = long.groupBy("feature").agg(of("reference", F.count).alias("n_reference"), of("current", F.count).alias("n_current"), of("reference", F.avg).alias("reference_mean"), of("current", F.avg).alias("current_mean"), rate("reference").alias("reference_missing"), rate("current").alias("current_missing"))
    out = base.join(psi(long, n_bins), "feature", "left").join(ks(long), "feature", "left")
    few = (F.col("n_reference") < MIN_DRIFT) | (F.col("n_current") < MIN_DRIFT)
    out = out.withColumn("insufficient", few).withColumns({c: F.when(~F.col("insufficient"), F.col(c)) for c in ("psi", "ks", "ks_p")})
    severity = F.when(F.col("insufficient"), "INSUFFICIENT").when(F.col("psi") >= PSI_ALERT, "SIGNIFICANT").when(F.col("psi") >= PSI_WARNING, "MODERATE").otherwise("STABLE")
    out = benjamini_hochberg(out.withColumn("severity", severity).withColumn("_g", F.lit(0)), "ks_p", ["_g"]).drop("_g")
    return out.orderBy(F.desc_nulls_last("psi"), "feature")


def drift_persistence(history: DataFrame, checks: int = 3) -> DataFrame:
    """(feature, streak, persistent) of a table (feature, checked_at, breached): breaches in a row up to the newest check."""
    w = Window.partitionBy("feature").orderBy(F.desc("checked_at")).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.sum((~F.col("breached")).cast("int")).over(w)
    out = history.withColumn("_ok", ok).groupBy("feature").agg(F.count(F.when(F.col("_ok") == 0, 1)).alias("streak"))
    return out.withColumn("persistent", F.col("streak") >= checks)


def summarise_drift(drift: DataFrame) -> DataFrame:
    """One row of counts over the features with enough rows to be measured, and how many there are of all."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    own = ~F.col("insufficient")
    return drift.agg(
        F.count(F.lit(1)).alias("n_features"),
        n(own).alias("n_measurable"),
        n(own & (F.col("severity") == "SIGNIFICANT")).alias("n_significant"),
        n(own & (F.col("severity") == "MODERATE")).alias("n_moderate"),
        F.max(F.when(own, F.col("psi"))).alias("max_psi"),
        F.avg(F.when(own, F.col("psi"))).alias("mean_psi"),
        n(own & (F.col("ks_p") < 0.05)).alias("n_ks_naive"),
        n(own & F.col("discovered")).alias("n_ks_fdr"),
        F.max(F.when(own, F.col("current_missing"))).alias("max_missing_rate"),
    )


def trailing_windows(resolved: DataFrame, as_of, windows=WINDOWS, p: str = "calibrated_probability", y: str = "actual_direction", day: str = "prediction_date") -> DataFrame:
    """Rows of each trailing window, with days; one scan for all windows."""
    rows = resolved.filter((F.col(day) <= F.lit(as_of)) & (F.col(day) > F.date_sub(F.lit(as_of), max(windows))) & F.col(p).isNotNull() & F.col(y).isNotNull())
    return rows.withColumn("days", F.explode(F.array(*[F.lit(d) for d in windows]))).filter(F.expr(f"date_add({day}, days)") > F.lit(as_of))


def rolling_performance(resolved: DataFrame, as_of, windows=WINDOWS) -> DataFrame:
    """Classification metrics by window with the smallest AUC change that so many rows can show; a window without rows has n = 0."""
    m = classification_metrics(trailing_windows(resolved, as_of, windows), "actual_direction", "calibrated_probability", ["days"])
    every = resolved.sparkSession.createDataFrame([(d,) for d in windows], "days int")
    m = every.join(m, "days", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return m.withColumn("mde", F.when(F.col("n") > 0, 2 * F.sqrt(4 / F.col("n"))).otherwise(float("inf"))).withColumn("reportable", F.col("n") >= MIN_PERFORMANCE)


def degradation(performance: DataFrame, baseline_auc: float, above_mde: bool = True) -> DataFrame:
    """One row: the longest reportable window and whether its AUC fell from the baseline by what it can show."""
    top = performance.filter("reportable and auc is not null").agg(F.max_by(F.struct("days", "auc", "mde"), "days").alias("w"))
    drop = F.lit(baseline_auc) - F.col("w.auc")
    return top.select(F.col("w.days").alias("days"), F.col("w.auc").alias("auc"), drop.alias("drop"), F.coalesce((drop > 0) & (drop >= (F.col("w.mde") if above_mde else F.lit(0.0))), F.lit(False)).alias("degraded"))


def monitor_calibration(resolved: DataFrame, as_of, baseline_ece: float, windows=WINDOWS) -> DataFrame:
    m = calibration_metrics(trailing_windows(resolved, as_of, windows), "actual_direction", "calibrated_probability", ["days"])
    return m.withColumn("reportable", F.col("n") >= MIN_CALIBRATION).withColumn("drifted", F.col("reportable") & (F.col("ece") > baseline_ece + 0.05))


def calibration_verdict(calibration: DataFrame, baseline_ece: float, tolerance: float = 0.05) -> DataFrame:
    """One row (days, ece, drifted): the reportable window with most rows, and whether its ECE is above the baseline by more than the tolerance.

    Without a reportable window or a finite ECE nothing has drifted.
    """
    w = F.max_by(F.struct("days", "ece"), F.struct("n", -F.col("days"))).alias("w")
    longest = calibration.filter("reportable").agg(w)
    ece = F.col("w.ece")
    return longest.select(F.col("w.days").alias("days"), ece.alias("ece"), F.coalesce((ece > baseline_ece + tolerance) & ~F.isnan(ece) & (ece < float("inf")), F.lit(False)).alias("drifted"))


def retraining_verdict(signals: DataFrame, min_new: int = 500, drift_warning: float = 0.20) -> DataFrame:
    """signals (one row a run: dq_errors, drifted_features, n_features, degraded, calibration_drift, n_resolved) plus state, diagnosis and should_retrain.

    Data-quality errors block everything. Drift alone never retrains: it warns
    where the share of drifting features reaches ``drift_warning``. A problem
    of performance or calibration retrains once there are ``min_new`` rows.
    """
    blocked, sick, drift = F.col("dq_errors") > 0, F.col("degraded") | F.col("calibration_drift"), F.col("drifted_features") > 0
    share = F.coalesce(F.try_divide("drifted_features", "n_features"), F.lit(0.0))
    few = F.col("n_resolved") < min_new
    state = F.when(blocked, "BLOCKED").when(~sick, F.when(drift & (share >= drift_warning), "WARNING").otherwise("HEALTHY")).when(few, "DEGRADED").otherwise("RETRAIN_REQUIRED")
    diagnosis = F.when(blocked, "DATA_QUALITY_SUSPECTED").when(~sick, F.when(drift, "DRIFT_ONLY_MODEL_COPING").otherwise("NONE")).when(drift, "LIKELY_REGIME_CHANGE").otherwise("LIKELY_RELATIONSHIP_CHANGE")
    return signals.withColumn("state", state).withColumn("diagnosis", diagnosis).withColumn("should_retrain", F.col("state") == "RETRAIN_REQUIRED")


def validate_candidates(pairs: DataFrame, max_ece: float = 0.02) -> DataFrame:
    """pairs (candidate_* and incumbent_* of auc, ece, sharpness, n) plus failed_checks and passed."""
    c, i = (lambda k: F.col(f"candidate_{k}")), (lambda k: F.col(f"incumbent_{k}"))
    tests = {"AUC": c("auc") < i("auc"), "ECE": c("ece") > i("ece") + max_ece, "SHARPNESS": c("sharpness") <= 0.001, "OBSERVATIONS": c("n") < 500}
    failed = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(k)) for k, t in tests.items()]))
    return pairs.withColumn("failed_checks", failed).withColumn("passed", F.size("failed_checks") == 0)


def emitted_alerts(alerts: DataFrame, days: int = 3) -> DataFrame:
    """(code, day) of alerts that pass a cooldown of so many days since the code's last emitted one.

    An alert is held back less than ``days`` after the last emitted one. Each
    code's distinct days are folded in order; there is at most one a day.
    """

    def step(kept: Column, d: Column) -> Column:
        return F.when((F.size(kept) == 0) | (F.datediff(d, F.element_at(kept, -1)) >= days), F.concat(kept, F.array(d))).otherwise(kept)

    folded = alerts.groupBy("code").agg(F.array_sort(F.collect_set("day")).alias("d")).select("code", F.aggregate("d", F.array().cast("array<date>"), step).alias("k"))
    return folded.select("code", F.explode("k").alias("day"))


def drift_checks(drift: DataFrame, checked_at: Column) -> DataFrame:
    """(feature, checked_at, breached) of one check, for a history of them."""
    return drift.filter("not insufficient").select("feature", checked_at.alias("checked_at"), (F.col("severity") == "SIGNIFICANT").alias("breached"))


def health_row(drift: DataFrame, persistence: DataFrame, performance: DataFrame, calibration: DataFrame, resolved: DataFrame, baseline_auc: float, baseline_ece: float, dq_errors: int = 0) -> DataFrame:
    """All signals of a run in one row, with the verdict.

    A feature drifts where ``persistence``, of :func:`drift_persistence`, says
    that it has for several checks; one breach is no signal.
    """
    d = summarise_drift(drift).select("n_features", "max_psi", "n_ks_fdr")
    f = persistence.agg(F.count(F.when(F.col("persistent"), 1)).alias("drifted_features"))
    p = degradation(performance, baseline_auc).select("degraded", F.col("drop").alias("auc_drop"))
    c = calibration_verdict(calibration, baseline_ece).select(F.col("drifted").alias("calibration_drift"))
    n = resolved.agg(F.count(F.lit(1)).alias("n_resolved"))
    return retraining_verdict(d.crossJoin(f).crossJoin(p).crossJoin(c).crossJoin(n).withColumn("dq_errors", F.lit(dq_errors)))
