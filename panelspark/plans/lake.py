"""Queries that write tables to the work folder and read them back, and others without a place among the panels."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from panelspark.operators import features, folds, metrics, monitoring, records
from panelspark.plans import panel, sql
from panelspark.plans.panel import register, rounded
from panelspark.sources import tables


def _place(spark, name: str) -> str:
    return f"{tables.work_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- lake -----------------------------------------------------------------------------------------------------------


@register("a2_bar_lake", sql.query("SELECT symbol, date, round(close_split, 4) AS close_split, volume FROM bars WHERE symbol <> 'AF' OR date < DATE '1996-01-01'", "bars"))
def a2(spark, d):
    """All bars in one folder a symbol, then one symbol's replaced by its first years."""
    root, bars = _place(spark, "bars"), tables.bars_calm(spark, d)
    bars = bars.select(*tables.BAR_COLUMNS)
    tables.write_bars(bars, root)
    tables.write_bars(bars.filter((F.col("symbol") == "AF") & (F.col("date") < F.lit(date(1996, 1, 1)))), root)
    return rounded(tables.read_bars(spark, root), ["close_split"], ("symbol", "date", "volume"), 4)


@register("a1_symbols_of_the_lake", sql.query("SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars WHERE symbol IN ('NO', 'RF') GROUP BY symbol", "bars"))
def a1(spark, d):
    root, bars = _place(spark, "bars"), tables.bars_calm(spark, d)
    tables.write_bars(bars.select(*tables.BAR_COLUMNS), root)
    return tables.read_bars(spark, root, ["NO", "RF"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register("a5_feature_lake", sql.query(f"SELECT symbol, date, {sql.rounded(['return_5d', 'volatility_20'])} FROM early", "early"))
def a5(spark, d):
    """Two versions of the features; the panel of the first is read."""
    root = _place(spark, "features")
    f = features.window_features(panel.enriched(spark, d)).select("symbol", "date", "return_5d", "volatility_20")
    tables.write_features(f, root, "f1")
    tables.write_features(f.withColumn("return_5d", F.lit(0.0)), root, "f2")
    return rounded(tables.read_panel(spark, root, "f1"), ["return_5d", "volatility_20"], ("symbol", "date"))


@register("a9_equity_csv", sql.query("SELECT date, round(equity, 6) AS equity, round(net, 6) + 0.0 AS cash FROM curve", "scores", weights=panel._WEIGHTS, daily=panel._DAILY, curve=panel._CURVE))
def a9(spark, d):
    path = _place(spark, "equity")
    tables.write_csv(panel.curve(spark, d).select("date", "equity", F.col("net").alias("cash")), path)
    return rounded(tables.read_equity_csv(spark, path), ["equity", "cash"], ("date",))


@register("a11_signal_table", sql.query("SELECT symbol, date, round(p, 6) AS p, round(e, 6) + 0.0 AS e FROM scores", "scores"))
def a11(spark, d):
    path = _place(spark, "signals")
    tables.write_signals(panel.scores(spark, d).select("symbol", "date", "p", "e"), path)
    return rounded(tables.read_signals(spark, path), ["p", "e"], ("symbol", "date"))


_FORECASTS = "SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS forecast_session, arg_min(o_orderkey, o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL"


@register(
    "a12_forecast_records",
    f"WITH old AS ({_FORECASTS}), new AS ({_FORECASTS.replace('% 2 = 0', '% 2 = 1')}) SELECT symbol, forecast_session, k AS expected_return FROM old UNION ALL SELECT symbol, forecast_session, k FROM new ANTI JOIN old USING (symbol, forecast_session)",
)
def a12(spark, d):
    """Forecasts as JSON records: what was written first for a symbol and session stays."""
    path = _place(spark, "forecasts")
    o = tables.read_table(spark, d, "orders")
    made = F.timestamp_seconds(F.col("o_orderkey"))
    f = o.select(F.lit("i").alias("index"), F.col("o_orderpriority").alias("symbol"), F.lit("UP").alias("direction"), F.col("o_orderkey").cast("double").alias("expected_return"), F.lit(0.5).alias("probability_up"), F.to_date("o_orderdate").alias("forecast_session"), F.date_sub(F.to_date("o_orderdate"), 1).alias("as_of"), made.alias("created_at"))
    even = F.col("expected_return") % 2 == 0
    tables.append_forecasts(f.limit(0), f.filter(even)).write.json(path)
    tables.append_forecasts(tables.settled(tables.read_forecasts(spark, path)), f.filter(~even)).write.mode("append").json(path)
    return tables.read_forecasts(spark, path).select("symbol", "forecast_session", F.col("expected_return").cast("long").alias("expected_return"))


@register("a13_merged_candles", sql.query("SELECT timestamp, symbol, CASE WHEN hour(timestamp) < 12 THEN close ELSE close + 1 END AS close FROM candles WHERE hour(timestamp) >= 6", "candles"))
def a13(spark, d):
    """The morning's candles fetched first, and the day's later ones, some of them twice, by the newest fetch."""
    from panelspark.streaming.candles import candles

    c, hour = candles(tables.ticks(spark, d), "1h"), F.hour("timestamp")
    old = c.filter(hour.between(6, 17)).withColumn("fetched_at", F.lit(1))
    new = c.filter(hour >= 12).withColumn("close", F.col("close") + 1).withColumn("fetched_at", F.lit(2))
    return tables.upsert_candles(old, new).select("timestamp", "symbol", "close")


# --- metrics and folds ----------------------------------------------------------------------------------------------


@register("h3_pr_auc", sql.query("SELECT symbol, round(sum(pos * tp / total) / sum(pos), 6) AS pr_auc FROM (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS total FROM (SELECT symbol, p, sum(y) AS pos, count(*) AS n FROM scores GROUP BY ALL) WINDOW w AS (PARTITION BY symbol ORDER BY p DESC)) GROUP BY symbol", "scores"))
def h3(spark, d):
    return rounded(metrics.auc_table(panel.scores(spark, d), "y", "p", ["symbol"]), ["pr_auc"], ("symbol",))


@register("h11_uniform_ece", sql.query("SELECT symbol, round(sum(n * abs(o - m)) / sum(n), 6) AS ece_uniform, round(sum(n * m) / sum(n), 6) AS mean_predicted, round(sum(n * o) / sum(n), 6) AS base_rate, round(sum(n * m) / sum(n) - sum(n * o) / sum(n), 6) + 0.0 AS bias FROM (SELECT symbol, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS o FROM scores GROUP BY ALL) GROUP BY symbol", "scores"))
def h11(spark, d):
    return rounded(metrics.calibration_metrics(panel.scores(spark, d), "y", "p", ["symbol"]), ["ece_uniform", "mean_predicted", "base_rate", "bias"], ("symbol",))


@register("i9_repeated_predictions", sql.query("SELECT date, symbol, CAST(2 AS BIGINT) AS n FROM scores WHERE day(date) = 3", "scores"))
def i9(spark, d):
    s = panel.scores(spark, d).select("date", "symbol", "p")
    return folds.repeated_keys(s.unionByName(s.filter(F.dayofmonth("date") == 3)))


@register("i11_false_discovery", "SELECT c_custkey AS feature, c_nationkey AS g, p, i <= coalesce(max(CASE WHEN p <= 0.05 * i / m THEN i END) OVER (PARTITION BY c_nationkey), 0) AS discovered FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS m FROM (SELECT c_custkey, c_nationkey, pow((c_acctbal + 1000) / 12000, 4) AS p FROM customer))")
def i11(spark, d):
    c = tables.read_table(spark, d, "customer").select(F.col("c_custkey").alias("feature"), F.col("c_nationkey").alias("g"), F.pow((F.col("c_acctbal") + 1000) / 12000, F.lit(4.0)).alias("p"))
    return monitoring.benjamini_hochberg(c, "p", ["g"]).select("feature", "g", "p", "discovered")


_DIGEST = "substr(sha256(concat_ws('|', CAST(count(*) AS VARCHAR), '{n}', CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR), CAST(sum(CAST(close_split AS DECIMAL(38, 6))) AS VARCHAR), CAST(sum(CAST(volume AS DECIMAL(38, 6))) AS VARCHAR))), 1, 16)"


@register("h19_lock_check", sql.query(f"SELECT part AS locked_part, count(*) AS n_rows, {_DIGEST.format(n=4)} AS digest, part = 'kept' AS intact FROM (SELECT 'kept' AS part, date, symbol, close_split, volume FROM bars WHERE date <= DATE '1998-01-01' UNION ALL SELECT 'changed', date, symbol, close_split, CASE WHEN day(date) = 3 THEN volume + 1 ELSE volume END FROM bars WHERE date <= DATE '1998-01-01') GROUP BY part", "bars"))
def h19(spark, d):
    """A table locked at a day, then with later rows (intact), and with old rows changed (not)."""
    b = tables.bars_calm(spark, d).select("date", "symbol", F.round("close_split", 4).alias("close_split"), "volume")
    numeric, cut = ["close_split", "volume"], date(1998, 1, 1)
    lock = records.fingerprint(b.filter(F.col("date") <= F.lit(cut)), numeric).withColumn("locked_at", F.lit(cut))
    cases = {"kept": b, "changed": b.withColumn("volume", F.col("volume") + (F.dayofmonth("date") == 3).cast("int"))}
    each = [records.verify_lock(df.withColumn("ingested_at", F.col("date")), lock, numeric).select(F.lit(k).alias("locked_part"), "n_rows", "digest", "intact") for k, df in cases.items()]
    return each[0].unionByName(each[1])
