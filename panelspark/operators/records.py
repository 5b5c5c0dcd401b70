"""Prediction, forecast and experiment tables: constraints and joins as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import normal

NATURAL_KEY = ["symbol", "prediction_date", "model_version", "feature_version", "decision_version", "threshold_version"]
SIGNALS = ("BUY", "SELL", "HOLD")
STDERR = 0.024
#: Stages an entry may move to; the first one has no stage before it, and nothing leaves FAILED or ARCHIVED.
TRANSITIONS = [
    (None, "CANDIDATE"),
    ("CANDIDATE", "VALIDATING"),
    ("CANDIDATE", "FAILED"),
    ("VALIDATING", "VALIDATED"),
    ("VALIDATING", "FAILED"),
    ("VALIDATED", "STAGING"),
    ("VALIDATED", "FAILED"),
    ("VALIDATED", "ARCHIVED"),
    ("STAGING", "PRODUCTION"),
    ("STAGING", "FAILED"),
    ("STAGING", "ARCHIVED"),
    ("PRODUCTION", "ARCHIVED"),
]


def natural_id(df: DataFrame, keys: list[str] = NATURAL_KEY) -> DataFrame:
    """df plus prediction_id, the first 32 hex digits of the SHA-256 of its key."""
    return df.withColumn("prediction_id", F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 32))


def classify_saves(new: DataFrame, stored: DataFrame, values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """new plus action: insert, noop where the stored values are equal, else conflict."""
    old = stored.select(F.col("prediction_id"), F.struct(*values).alias("_old"))
    same = F.lit(True)
    for v in values:
        a, b = F.col(v), F.col(f"_old.{v}")
        equal = F.abs(a - b) <= tolerance if dict(new.dtypes)[v] == "double" else a == b
        same = same & F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(equal)
    joined = new.join(old, "prediction_id", "left")
    return joined.withColumn("action", F.when(F.col("_old").isNull(), "insert").when(same, "noop").otherwise("conflict")).drop("_old")


def domain_violations(preds: DataFrame) -> DataFrame:
    """Rows with an unknown signal, a probability outside [0, 1] or an execution not after the prediction, with reason."""
    out = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 1)
    reason = F.when(~F.col("signal").isin(*SIGNALS), "SIGNAL").when(out("predicted_probability") | out("calibrated_probability"), "PROBABILITY").when(F.col("execution_date") <= F.col("prediction_date"), "EXECUTION_DATE")
    return preds.withColumn("reason", reason).filter("reason is not null")


def temporal_violations(preds: DataFrame) -> DataFrame:
    return preds.filter(F.col("training_end").isNull() | (F.col("training_end") >= F.col("prediction_date")))


def pending(preds: DataFrame, as_of) -> DataFrame:
    return preds.filter((F.col("status") == "PREDICTED") & (F.col("execution_date") <= F.lit(as_of)))


def resolve(preds: DataFrame, labels: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """New outcome rows of pending predictions with a label (symbol, date, actual_return); those that have an outcome stay."""
    due = pending(preds, as_of).join(outcomes.select("prediction_id"), "prediction_id", "left_anti")
    both = due.join(labels.select("symbol", F.col("date").alias("prediction_date"), "actual_return").filter("actual_return is not null"), ["symbol", "prediction_date"])
    p = F.coalesce("calibrated_probability", "predicted_probability")
    up = (F.col("actual_return") > 0).cast("int")
    return both.select("prediction_id", "actual_return", up.alias("actual_direction"), F.when(p.isNotNull(), ((p >= 0.5).cast("int") == up).cast("int")).alias("direction_correct"), (F.col("predicted_return") - F.col("actual_return")).alias("return_error"))


def resolved_view(preds: DataFrame, outcomes: DataFrame) -> DataFrame:
    return preds.join(outcomes, "prediction_id")


def resolved_since(view: DataFrame, since) -> DataFrame:
    return view.filter(F.col("prediction_date") >= F.lit(since))


def prediction_health(preds: DataFrame) -> DataFrame:
    """(status, n, share)."""
    out = preds.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def resolution_summary(preds: DataFrame, outcomes: DataFrame, as_of, max_sessions: int = 10) -> DataFrame:
    done = outcomes.select("prediction_id", F.lit(True).alias("_done"))
    df = pending(preds, as_of).join(done, "prediction_id", "left").withColumn("_age", F.datediff(F.lit(as_of), F.col("execution_date")))
    open_ = F.col("_done").isNull()
    return df.agg(F.count(F.lit(1)).alias("due"), F.count("_done").alias("resolved"), F.sum((open_ & (F.col("_age") <= 2 * max_sessions)).cast("long")).alias("pending"), F.sum((open_ & (F.col("_age") > 2 * max_sessions)).cast("long")).alias("unresolvable"), F.min(F.when(open_, F.col("execution_date"))).alias("oldest_pending"))


def signal_counts(decisions: DataFrame) -> DataFrame:
    """(signal, n), rejected rows under REJECTED."""
    return decisions.groupBy(F.when(F.col("reject_reason").isNotNull(), "REJECTED").otherwise(F.col("signal")).alias("signal")).agg(F.count(F.lit(1)).alias("n"))


def latest_rows(df: DataFrame, order: str, n: int = 500, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(order), *([tie] if tie else [])).limit(n)


def eligible(forecasts: DataFrame) -> DataFrame:
    """forecasts plus eligible: made before its session, on older data, with a direction."""
    ok = (F.to_date("created_at") < F.col("forecast_session")) & (F.col("as_of") < F.col("forecast_session")) & F.col("direction").isin("UP", "DOWN")
    return forecasts.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def score_forecasts(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """forecasts plus actual_return, actual and result: CORRECT, WRONG, FLAT, PENDING or INELIGIBLE.

    bars has symbol, date, open, close; a session with more than one bar stays pending.
    """
    one = bars.groupBy("symbol", F.col("date").alias("forecast_session")).agg(F.count(F.lit(1)).alias("_n"), F.first("open").alias("_o"), F.first("close").alias("_c")).filter("_n = 1")
    df = eligible(forecasts).join(one, ["symbol", "forecast_session"], "left").withColumn("actual_return", F.try_divide("_c", "_o") - 1)
    actual = F.when(F.col("actual_return") > 0, "UP").when(F.col("actual_return") < 0, "DOWN").when(F.col("actual_return") == 0, "FLAT")
    df = df.withColumn("actual", actual)
    result = F.when(~F.col("eligible"), "INELIGIBLE").when(F.col("actual").isNull(), "PENDING").when(F.col("actual") == "FLAT", "FLAT").when(F.col("actual") == F.col("direction"), "CORRECT").otherwise("WRONG")
    return df.withColumn("result", result).withColumn("error", F.col("actual_return") - F.col("expected_return")).drop("_n", "_o", "_c")


#: What a forecast is known by once it is resolved.
FORECAST = ("symbol", "forecast_session", "as_of", "created_at", "direction", "probability_up", "expected_return")


def forecast_digest(forecasts: DataFrame) -> Column:
    """SHA-256 of all that a forecast says, nulls told from empty ones."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in FORECAST if c in forecasts.columns]), {"ignoreNullFields": "false"}), 256)


def forecast_outcomes(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, forecast_session, actual_open, actual_close, digest) of eligible forecasts whose session has its one bar, to be stored."""
    one = bars.groupBy("symbol", F.col("date").alias("forecast_session")).agg(F.count(F.lit(1)).alias("_n"), F.first("open").alias("actual_open"), F.first("close").alias("actual_close")).filter("_n = 1").drop("_n")
    own = eligible(forecasts).filter("eligible").withColumn("digest", forecast_digest(forecasts))
    return own.join(one, ["symbol", "forecast_session"]).select("symbol", "forecast_session", "actual_open", "actual_close", "digest")


def forecast_history(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """forecasts plus what became of them, newest session first; percentages are of 100.

    outcomes are stored ones of :func:`forecast_outcomes`. A forecast that says
    something else than when its outcome was stored stops the job.
    """
    df = eligible(forecasts).withColumn("_digest", forecast_digest(forecasts)).join(outcomes, ["symbol", "forecast_session"], "left")
    known = F.col("eligible") & F.col("digest").isNotNull()
    same = F.when(~known | (F.col("digest") == F.col("_digest")), True).otherwise(F.raise_error(F.concat(F.lit("a stored forecast changed after resolution: "), F.col("symbol"))).cast("boolean"))
    actual = F.when(known, F.try_divide("actual_close", "actual_open") - 1)
    direction = F.when(actual > 0, "UP").when(actual < 0, "DOWN").when(actual == 0, "FLAT")
    result = F.when(~F.col("eligible"), "INELIGIBLE").when(direction.isNull(), "PENDING").when(direction == "FLAT", "FLAT").when(direction == F.col("direction"), "CORRECT").otherwise("WRONG")
    shown = {"result": result, "actual_direction": direction, "actual_return_pct": 100 * actual, "error_pp": 100 * (actual - F.col("expected_return")), "probability_up_pct": 100 * F.col("probability_up"), "predicted_return_pct": 100 * F.col("expected_return")}
    shown |= {c: F.when(known, F.col(c)) for c in ("actual_open", "actual_close")}
    return df.filter(F.coalesce(same, F.lit(True))).withColumns(shown).drop("_digest", "digest").orderBy(F.desc("forecast_session"), "symbol")


def forecast_accuracy(history: DataFrame) -> DataFrame:
    n = lambda r: F.sum((F.col("result") == r).cast("long"))
    return history.agg(*[n(r).alias(f"n_{r.lower()}") for r in ("CORRECT", "WRONG", "FLAT", "PENDING", "INELIGIBLE")], F.try_divide(n("CORRECT").cast("double"), n("CORRECT") + n("WRONG")).alias("accuracy"))


def forecast_crosstab(history: DataFrame) -> DataFrame:
    return history.groupBy("forecast_session").pivot("result", ["CORRECT", "WRONG", "FLAT", "PENDING", "INELIGIBLE"]).count().na.fill(0)


def fingerprint(df: DataFrame, numeric: list[str], date_col: str = "date") -> DataFrame:
    """One row: rows, first and last date and a digest that doesn't depend on the order of rows. Nulls count as 0."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,6)")).cast("string") for c in numeric]
    parts = [F.count(F.lit(1)).cast("string"), F.lit(str(len(df.columns))), F.min(date_col).cast("string"), F.max(date_col).cast("string"), *sums]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16).alias("digest"))


def verify_lock(df: DataFrame, lock: DataFrame, numeric: list[str], seen_col: str = "ingested_at", date_col: str = "date") -> DataFrame:
    """Whether the rows seen by the lock's time (locked_at, digest) still have its digest."""
    at = lock.select("locked_at").first()["locked_at"]
    now = fingerprint(df.filter(F.col(seen_col) <= F.lit(at)).drop(seen_col), numeric, date_col)
    return now.crossJoin(lock.select("locked_at", F.col("digest").alias("locked_digest"))).withColumn("intact", F.col("digest") == F.col("locked_digest"))


def leaderboard(runs: DataFrame, stderr: float = STDERR) -> DataFrame:
    """runs (experiment_id, task, primary_value, created_at) ranked, with the value less what the best of n null runs would show.

    distinguishable: the gap to the best is more than two errors of a difference.
    """
    w = Window.partitionBy("task")
    df = runs.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("best", F.max("primary_value").over(w))
    df = df.withColumn("_p", 1 - 1 / (F.col("n") + 1))
    df = df.withColumn("inflation", F.when(F.col("n") > 1, stderr * normal.quantile("_p")).otherwise(0.0)).drop("_p")
    df = df.withColumns({"rank": F.rank().over(w.orderBy(F.desc("primary_value"))), "selection_adjusted": F.col("primary_value") - F.col("inflation"), "distinguishable": F.col("best") - F.col("primary_value") > 2 * stderr * 2**0.5})
    return df.withColumn("n_prior", F.row_number().over(w.orderBy("created_at", "experiment_id")) - 1)


def task_summary(runs: DataFrame) -> DataFrame:
    v = F.col("primary_value")
    return runs.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max(v).alias("best"), F.min(v).alias("worst"), F.stddev_samp(v).alias("sd"))


def duplicate_runs(runs: DataFrame, inputs: list[str]) -> DataFrame:
    """(fingerprint, n, n_results) of inputs that were run more than once."""
    df = runs.withColumn("fingerprint", F.substring(F.sha2(F.to_json(F.struct(*inputs)), 256), 1, 16))
    return df.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("primary_value").alias("n_results")).filter("n > 1")


def illegal_transitions(spark: SparkSession, moves: DataFrame) -> DataFrame:
    """Moves (model_version, from_stage, to_stage, occurred_at) that don't follow from the move before."""
    allowed = spark.createDataFrame(TRANSITIONS, "a string, b string")
    w = Window.partitionBy("model_version").orderBy("occurred_at")
    df = moves.withColumn("before", F.lag("to_stage").over(w))
    return df.join(F.broadcast(allowed), F.col("before").eqNullSafe(F.col("a")) & (F.col("to_stage") == F.col("b")), "left_anti")


def shared_production(moves: DataFrame, task: str = "task") -> DataFrame:
    """Moves to PRODUCTION that leave more than one model of a task there, with n_live: how many are.

    The model that goes out must be archived no later than the new one comes
    in. Models of a task are counted by a running sum over their moves.
    """
    own = Window.partitionBy("model_version").orderBy("occurred_at")
    live = F.col("to_stage") == "PRODUCTION"
    change = live.cast("int") - F.coalesce(F.lag(live.cast("int")).over(own), F.lit(0))
    together = Window.partitionBy(task).orderBy("occurred_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return moves.withColumn("_d", change).withColumn("n_live", F.sum("_d").over(together)).filter(live & (F.col("_d") == 1) & (F.col("n_live") > 1)).drop("_d")


def current_stages(moves: DataFrame) -> DataFrame:
    return moves.groupBy("model_version").agg(F.max_by("to_stage", "occurred_at").alias("stage"), F.count(F.lit(1)).alias("n_moves"))


def key_differences(frames: dict[str, DataFrame], keys: tuple[str, ...] = ("date", "symbol")) -> DataFrame:
    """(name, missing, extra): keys of the first frame that another lacks, and the reverse."""
    names = list(frames)
    first = frames[names[0]].select(*keys).distinct()
    out = None
    for name in names[1:]:
        other = frames[name].select(*keys).distinct()
        a = first.join(other, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("missing"))
        b = other.join(first, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("extra"))
        row = a.crossJoin(b).select(F.lit(name).alias("name"), "missing", "extra")
        out = row if out is None else out.unionByName(row)
    return out


def meta_features(frames: dict[str, DataFrame], context: DataFrame | None = None) -> DataFrame:
    """(date, symbol, y_true, one column for each frame's y_pred), rows that all frames have, plus context columns.

    A frame that has a (date, symbol) twice stops the job: out of fold, each row
    is predicted once.
    """
    out = None
    for name, df in frames.items():
        once = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"{name} has a date and symbol twice")).cast("boolean"))
        own = df.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("y_true", "y_pred") if c in df.columns])
        own = own.filter(once).select("date", "symbol", *(["y_true"] if out is None else []), F.col("y_pred").alias(name))
        out = own if out is None else out.join(own, ["date", "symbol"])
    return out if context is None else out.join(context, ["date", "symbol"], "left")


def attach_expected_returns(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """signals plus expected_return; a signal without a finite one stops the job."""
    joined = signals.join(returns.select("date", "symbol", F.col("y_pred").alias("expected_return")), ["date", "symbol"], "left")
    e = F.col("expected_return")
    return joined.withColumn("expected_return", F.when(e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")), e).otherwise(F.raise_error(F.lit("a signal has no expected return")).cast("double")))
