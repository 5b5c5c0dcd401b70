"""Queries over panels derived from the given tables, and the same in SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import kernels, normal
from panelspark.functions.windows import by_symbol
from panelspark.operators import actions, calendar, decisions, features, folds, labels, metrics, models, monitoring, portfolio, quality, records
from panelspark.plans import sql
from panelspark.sources import tables
from panelspark.streaming import candles as streaming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FIRST, LAST = date(1995, 1, 1), date(2002, 12, 31)


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def rounded_double(x: Column, digits: int = 6) -> Column:
    """A double rounded as the SQL does: x * 10**digits, a double again, to the next whole number, halves away from zero.

    F.round goes by the digits that a double shows: 0.0643815 * 1e6 is less than 64381.5, yet it gives 0.064382.
    """
    unit = 10.0**digits
    return F.when(F.abs(x * unit) < float("inf"), F.round(x * unit) / unit).otherwise(x)


def rounded(df: DataFrame, columns, keep=("symbol", "date"), digits: int = 6) -> DataFrame:
    kind = dict(df.dtypes)
    return df.select(*keep, *[((rounded_double(F.col(c), digits) if kind[c] == "double" else F.round(c, digits)) + 0.0).alias(c) for c in columns])


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return actions.apply_corporate_actions(tables.bars_calm(spark, d))


def recursive(spark: SparkSession, d: str) -> DataFrame:
    """The kernels' columns alone: only what they read goes through them."""
    return kernels.with_momentum(windowed(spark, d).select("symbol", "date", "adj_close", "_tr", "volatility_20"))


def windowed(spark: SparkSession, d: str) -> DataFrame:
    return features.window_features(enriched(spark, d))


def panel(spark: SparkSession, d: str) -> DataFrame:
    return features.build_panel(enriched(spark, d))


def simple_panel(spark: SparkSession, d: str) -> DataFrame:
    """What scores need, without the kernels."""
    df = actions.add_adjusted_open(enriched(spark, d))
    df = df.withColumns({"return_1d": features.simple_return(F.col("adj_close"), 1), "return_5d": features.simple_return(F.col("adj_close"), 5)})
    df = df.withColumn("volatility_20", features.roll(F.stddev_samp, F.col("return_1d"), 20) * F.sqrt(F.lit(252.0)))
    return features.trim_warmup(labels.add_labels(df))


def scores(spark: SparkSession, d: str) -> DataFrame:
    df = labels.drop_unlabelled(simple_panel(spark, d), "tradeable_direction_1d")
    return df.select("symbol", "date", (1 / (1 + F.exp(-20 * F.col("return_5d")))).alias("p"), F.col("tradeable_direction_1d").alias("y"), (F.col("return_1d") / 10).alias("e"), F.col("tradeable_return_1d").alias("realised"), "volatility_20", "return_1d", "return_5d")


# --- bars, actions --------------------------------------------------------------------------------------------------

BAR = ["open_split", "high_split", "low_split", "close_split", "volume", "dividend", "split_ratio"]


@register("a1_daily_bars", sql.query(f"SELECT symbol, date, volume, {sql.rounded([c for c in BAR if c != 'volume'])} FROM bars", "bars"))
def a1(spark, d):
    return rounded(tables.bars_calm(spark, d), [c for c in BAR if c != "volume"], ("symbol", "date", "volume"))


ACTION = ["split_factor", "open_raw", "high_raw", "low_raw", "close_raw", "adj_close"]


@register("d4_corporate_actions", sql.query(f"SELECT symbol, date, {sql.rounded(ACTION)} FROM enriched", "enriched"))
def d4(spark, d):
    return rounded(enriched(spark, d), ACTION)


@register("b1_adjusted_open", sql.query("SELECT symbol, date, round(adj_close / close_split, 6) AS adj_factor, round(open_split * (adj_close / close_split), 6) AS adj_open FROM enriched", "enriched"))
def b1(spark, d):
    return rounded(actions.add_adjusted_open(enriched(spark, d)), ["adj_factor", "adj_open"])


@register("a3_upsert_bars", sql.query("SELECT symbol, date, round(coalesce(n.close_split, o.close_split), 6) AS close_split FROM (SELECT symbol, date, close_split FROM bars WHERE year(date) < 2001) o FULL JOIN (SELECT symbol, date, close_split * 2 AS close_split FROM bars WHERE year(date) >= 2000) n USING (symbol, date)", "bars"))
def a3(spark, d):
    b = tables.bars_calm(spark, d).select("symbol", "date", "close_split")
    new = b.filter(F.year("date") >= 2000).withColumn("close_split", F.col("close_split") * 2)
    return rounded(tables.upsert_bars(b.filter(F.year("date") < 2001), new), ["close_split"])


@register("a4_incremental_window", sql.query("SELECT b.symbol, b.date FROM bars b LEFT JOIN (SELECT symbol, max(date) AS m FROM bars WHERE year(date) < 2001 GROUP BY symbol) s USING (symbol) WHERE m IS NULL OR b.date >= m - 7", "bars"))
def a4(spark, d):
    b = tables.bars_calm(spark, d)
    return tables.incremental_filter(b, b.filter(F.year("date") < 2001)).select("symbol", "date")


@register(
    "a7_normalise_bars",
    """SELECT symbol, date, close_split, volume, dividend, split_ratio FROM (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS close_split, CAST(o_custkey % 100 AS BIGINT) AS volume, 0.0::DOUBLE AS dividend, 1.0::DOUBLE AS split_ratio,
    row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS no FROM orders WHERE o_totalprice IS NOT NULL) WHERE no = 1""",
)
def a7(spark, d):
    o = tables.read_table(spark, d, "orders")
    p = F.col("o_totalprice")
    raw = o.select(F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("symbol"), p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), (F.col("o_custkey") % 100).alias("volume"), F.lit(None).cast("double").alias("dividend"), F.lit(0.0).alias("split_ratio"), F.col("o_orderkey").alias("seq"))
    return tables.normalise_bars(raw).select("symbol", "date", "close_split", "volume", "dividend", "split_ratio")


# --- data quality ---------------------------------------------------------------------------------------------------

_BAR_TESTS = [("ERROR", f"INVALID_PRICE:{c}", f"{c} IS NULL OR {c} <= 0") for c in quality.PRICES] + [("ERROR", "HIGH_BELOW_LOW", "high_split < low_split"), ("ERROR", "HIGH_BELOW_OPEN", "high_split < open_split"), ("ERROR", "HIGH_BELOW_CLOSE", "high_split < close_split"), ("ERROR", "LOW_ABOVE_OPEN", "low_split > open_split"), ("ERROR", "LOW_ABOVE_CLOSE", "low_split > close_split"), ("ERROR", "NEGATIVE_VOLUME", "volume < 0"), ("WARNING", "ZERO_VOLUME", "volume = 0"), ("WARNING", "LARGE_DIVIDEND", "dividend > 0 AND dividend / close_split > 0.25"), ("ERROR", "INVALID_SPLIT", "split_ratio <= 0 OR split_ratio NOT BETWEEN 0.01 AND 100"), ("ERROR", "NEGATIVE_DIVIDEND", "dividend < 0")]
_MOVES = f"SELECT symbol, date, split_ratio <> 1 AS s, abs(close_split / {sql.lag('close_split')} - 1) AS m, coalesce({sql.lead('split_ratio')} <> 1, false) AS n FROM dirty"
_STALE = f"""SELECT symbol, max(k) + 1 AS n FROM (SELECT symbol, run, count(*) AS k FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER ({sql.W} ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT symbol, date, coalesce(abs(close_split - {sql.lag("close_split")}) <= 1e-8 + 1e-5 * abs({sql.lag("close_split")}), false) AS same FROM dirty)) WHERE same GROUP BY symbol, run) GROUP BY symbol HAVING max(k) + 1 > 4"""
_DIRTY = "SELECT symbol, date, open_split, CASE WHEN day(date) = 13 THEN low_split * 0.9 ELSE high_split END AS high_split, low_split, CASE WHEN month(date) = 2 THEN 100.0 WHEN day(date) = 9 THEN -1.0 ELSE close_split END AS close_split, CASE day(date) WHEN 20 THEN 0 WHEN 23 THEN -5 ELSE volume END AS volume, CASE day(date) WHEN 25 THEN 0.3::DOUBLE * close_split WHEN 26 THEN -1.0::DOUBLE ELSE dividend END AS dividend, CASE WHEN day(date) = 24 THEN 0.0::DOUBLE ELSE split_ratio END AS split_ratio FROM wild"
_ISSUES = " UNION ALL ".join(
    [f"SELECT '{s}' AS severity, '{c}' AS code, symbol, min(date) AS issue_date, count(*) AS n FROM dirty WHERE {t} GROUP BY symbol" for s, c, t in _BAR_TESTS]
    + ["SELECT CASE WHEN m > 0.5 THEN 'ERROR' ELSE 'WARNING' END, 'ABNORMAL_JUMP', symbol, date, 1 FROM moves WHERE m > 0.2 AND NOT s AND NOT n", "SELECT CASE WHEN m > 0.2 THEN 'ERROR' ELSE 'INFO' END, CASE WHEN m > 0.2 THEN 'SPLIT_RECONCILIATION' ELSE 'SPLIT_APPLIED' END, symbol, date, 1 FROM moves WHERE s AND m IS NOT NULL", f"SELECT 'WARNING', 'STALE_PRICES', symbol, NULL, n FROM ({_STALE})"]
)


def dirty_bars(spark, d):
    """Wild bars with faults planted by the calendar."""
    day = F.dayofmonth("date")
    b = tables.bars_wild(spark, d)
    close = F.when(F.month("date") == 2, 100.0).when(day == 9, -1.0).otherwise(F.col("close_split"))
    return b.withColumns({
        "high_split": F.when(day == 13, F.col("low_split") * 0.9).otherwise(F.col("high_split")), "close_split": close,
        "volume": F.when(day == 20, 0).when(day == 23, -5).otherwise(F.col("volume")), "dividend": F.when(day == 25, 0.3 * F.col("close_split")).when(day == 26, -1.0).otherwise(F.col("dividend")), "split_ratio": F.when(day == 24, 0.0).otherwise(F.col("split_ratio"))})


@register("c_validate_bars", sql.query(f"SELECT severity, code, symbol, issue_date, CAST(n AS BIGINT) AS n FROM ({_ISSUES})", "wild", dirty=_DIRTY, moves=_MOVES))
def c_validate(spark, d):
    return quality.validate_bars(tables.settled(dirty_bars(spark, d)))


#: Bars of a provider with days repeated, arrivals out of order and a symbol without any.
_ARRIVED = "SELECT symbol, date, 2 * date_diff('day', DATE '1970-01-01', date) + CASE WHEN day(date) = 17 THEN 7 ELSE 0 END AS seq FROM wild UNION ALL SELECT symbol, date, 2 * date_diff('day', DATE '1970-01-01', date) + 1 FROM wild WHERE day(date) = 5"


@register(
    "c_arrivals",
    sql.query(
        """SELECT 'ERROR' AS severity, 'DUPLICATE_DATES' AS code, symbol, NULL::DATE AS issue_date, count(*) AS n FROM (SELECT symbol, date FROM arrived GROUP BY ALL HAVING count(*) > 1) GROUP BY symbol
UNION ALL SELECT 'ERROR', 'NOT_SORTED', symbol, NULL, count(*) FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM arrived) WHERE before > date GROUP BY symbol
UNION ALL SELECT 'ERROR', 'NO_DATA', 'ZZ', NULL, 1""",
        "wild",
        arrived=_ARRIVED,
    ),
)
def c_arrivals(spark, d):
    seq, b = 2 * F.unix_date("date"), tables.bars_wild(spark, d).select("symbol", "date")
    arrived = b.withColumn("seq", seq + F.when(F.dayofmonth("date") == 17, 7).otherwise(0)).unionByName(b.filter(F.dayofmonth("date") == 5).withColumn("seq", seq + 1))
    universe = b.select("symbol").distinct().union(spark.createDataFrame([("ZZ",)], "symbol string"))
    return quality.duplicate_dates(arrived).unionByName(quality.not_sorted(arrived, "seq")).unionByName(quality.no_data(arrived, universe))


@register("c16_severity_rollup", sql.query("SELECT symbol, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos, count(*) FILTER (severity = 'ERROR') = 0 AS ok FROM issues GROUP BY symbol", "wild", dirty=_DIRTY, moves=_MOVES, issues=_ISSUES))
def c16(spark, d):
    return quality.severity_rollup(quality.validate_bars(dirty_bars(spark, d)))


@register("c19_open_issue_counts", sql.query("SELECT severity, count(*) AS n FROM issues WHERE symbol < 'NA' AND severity <> 'INFO' GROUP BY severity", "wild", dirty=_DIRTY, moves=_MOVES, issues=_ISSUES))
def c19(spark, d):
    stored = quality.persistable(quality.validate_bars(dirty_bars(spark, d)), F.when(F.col("symbol") < "NA", F.lit(date(2000, 6, 1))).otherwise(F.lit(date(1999, 6, 1))))
    return quality.open_counts(stored, date(2000, 1, 1))


@register("c17_quarantine", sql.query("SELECT symbol, count(*) AS n FROM bars WHERE symbol NOT IN (SELECT symbol FROM bars GROUP BY symbol HAVING max(close_split / open_split) > 1.0398) GROUP BY symbol", "bars"))
def c17(spark, d):
    b = tables.bars_calm(spark, d)
    bad = b.groupBy("symbol").agg(F.max(F.col("close_split") / F.col("open_split")).alias("m")).filter("m > 1.0398").select(F.lit("ERROR").alias("severity"), "symbol")
    return quality.quarantine(b, bad).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@register("c9_missing_sessions", sql.query("SELECT s.symbol, w.date FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY symbol) s JOIN weekdays w ON w.date BETWEEN a AND b ANTI JOIN bars b2 ON b2.symbol = s.symbol AND b2.date = w.date", "bars", "weekdays"))
def c9(spark, d):
    return calendar.missing_sessions(tables.bars_calm(spark, d), calendar.sessions(spark, FIRST, LAST))


@register("c10_unexpected_sessions", sql.query("SELECT symbol, date FROM bars WHERE date NOT IN (SELECT date FROM weekdays)", "bars", "weekdays"))
def c10(spark, d):
    return calendar.unexpected_sessions(tables.bars_calm(spark, d), calendar.sessions(spark, FIRST, LAST))


@register("g9_next_session", sql.query("SELECT date, (SELECT min(w.date) FROM weekdays w WHERE w.date > x.date AND w.date <= x.date + 10) AS next_session, date IN (SELECT date FROM weekdays) AS is_session FROM (SELECT DISTINCT date FROM bars) x", "bars", "weekdays"))
def g9(spark, d):
    cal = calendar.sessions(spark, FIRST, LAST)
    return calendar.is_session(calendar.next_session(tables.bars_calm(spark, d).select("date").distinct(), cal), cal)


# --- features, labels -----------------------------------------------------------------------------------------------


def _block(name: str, columns: list[str], source: str) -> None:
    @register(name, sql.query(f"SELECT symbol, date, {sql.rounded(columns)} FROM {source}", source))
    def block(spark, d):
        return rounded(windowed(spark, d), columns)


_block("e1_returns", list(sql.RETURNS), "early")
_block("e10_technical", list(sql.TECHNICAL), "early")
_block("e15_volatility", [*sql.VOLATILITY, "vol_ratio_10_60"], "later")
_block("e20_volume", list(sql.VOLUME), "early")
_block("e26_regime", [c for c in sql.LATER if c != "vol_ratio_10_60"], "later")
_kernel = ", ".join(f"round({x}, 6) + 0.0 AS {c}" for c, x in sql.KERNEL.items())


@register("e7_momentum_kernels", sql.query(f"SELECT symbol, date, {_kernel} FROM signals9", "signals9"))
def e7(spark, d):
    return rounded(recursive(spark, d), list(sql.KERNEL))


@register("e24_expanding_percentile", sql.query("SELECT a.symbol, a.date, round((count(*) FILTER (b.volatility_20 <= a.volatility_20) - 1) / (count(*) - 1), 6) AS vol_percentile_expanding FROM v a JOIN v b ON a.symbol = b.symbol AND b.date <= a.date GROUP BY a.symbol, a.date, a.volatility_20 HAVING count(*) >= 252", "early", v="SELECT symbol, date, volatility_20 FROM early WHERE volatility_20 IS NOT NULL"))
def e24(spark, d):
    return rounded(recursive(spark, d).filter("vol_percentile_expanding is not null"), ["vol_percentile_expanding"])


@register("f1_labels", sql.query(f"SELECT symbol, date, tradeable_direction_1d, {sql.rounded(['tradeable_return_1d', 'research_return_1d'])} FROM trimmed", "trimmed"))
def f1(spark, d):
    return rounded(simple_panel(spark, d), ["tradeable_return_1d", "research_return_1d"], ("symbol", "date", "tradeable_direction_1d"))


_RANK = "CASE WHEN count(*) OVER (PARTITION BY date) > 1 AND {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY date) END"


@register("e29_cross_section", sql.query("SELECT symbol, date, " + ", ".join(f"round({_RANK.format(c=c)}, 6) AS xs_rank_{c}" for c in features.RANKED) + " FROM trimmed", "trimmed"))
def e29(spark, d):
    df = features.add_cross_sectional(features.trim_warmup(windowed(spark, d)))
    return rounded(df, [f"xs_rank_{c}" for c in features.RANKED])


_ALL = [*sql.RETURNS, *sql.TECHNICAL, *sql.VOLATILITY, *sql.VOLUME, *sql.LATER]


@register("e31_coverage", sql.query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM later" for c in _ALL), "later"))
def e31(spark, d):
    return rounded(features.coverage_report(windowed(spark, d), _ALL), ["missing_rate"], ("feature",))


@register("e30_latest_panel")
def e30(spark, d):
    """All features and labels of the newest date of each symbol."""
    p = panel(spark, d)
    return tables.latest(p, ["symbol"], [F.desc("date")])


_SESSION = {"return_1": f"c / {sql.lag('c')} - 1", "return_5": f"c / {sql.lag('c', 5)} - 1", "return_20": f"c / {sql.lag('c', 20)} - 1", "session_return": "c / o - 1", "range": "(h - l) / c", "gap": f"o / {sql.lag('c')} - 1", "close_position": "(c - l) / nullif(h - l, 0)", "target": f"{sql.lead('c')} / {sql.lead('o')} - 1"}


@register("e32_session_features", sql.query("SELECT symbol, date, " + ", ".join(f'round({x}, 6) + 0.0 AS "{c}"' for c, x in _SESSION.items()) + f", round({sql.roll('stddev_samp', 'r1', 20)}, 6) AS volatility FROM x", "bars", x=f"SELECT symbol, date, open_split AS o, high_split AS h, low_split AS l, close_split AS c, close_split / {sql.lag('close_split')} - 1 AS r1 FROM bars"))
def e32(spark, d):
    b = tables.bars_calm(spark, d).select("symbol", "date", *[F.col(f"{c}_split").alias(c) for c in ("open", "high", "low", "close")])
    return rounded(features.session_features(b), [*_SESSION, "volatility"])


# --- folds ----------------------------------------------------------------------------------------------------------

_FOLDS = "SELECT k AS fold, n - (5 - k) * 126 AS start, (SELECT count(*) FROM index) AS n0 FROM (SELECT unnest(range(5)) AS k, (SELECT count(*) FROM index) AS n)"
_ROLES = "SELECT b.symbol, b.date, session_idx, fold, CASE WHEN session_idx < start - 2 THEN 'train' WHEN session_idx < start THEN 'purged' WHEN session_idx < start + 126 THEN 'val' ELSE 'embargoed' END AS role FROM bars b JOIN index USING (date) JOIN folds ON session_idx < least(n0, start + 129)"


def assigned(spark, d, df=None):
    b = tables.bars_calm(spark, d) if df is None else df
    index = calendar.session_index(tables.bars_calm(spark, d))
    return folds.assign_folds(b, folds.fold_bounds(spark, index.count()), index)


_side = lambda f, r: f"{f}(date) FILTER (role = '{r}')"


@register("i2_fold_summary", sql.query(f"SELECT CAST(fold AS INTEGER) AS fold, {_side('min', 'train')} AS train_first, {_side('max', 'train')} AS train_last, {_side('min', 'val')} AS val_first, {_side('max', 'val')} AS val_last, " + ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ("train", "val", "purged", "embargoed")) + " FROM roles GROUP BY fold", "bars", "index", folds=_FOLDS, roles=_ROLES))
def i2(spark, d):
    return folds.fold_summary(assigned(spark, d))


@register("i6_unclean_folds", sql.query("SELECT CAST(fold AS INTEGER) AS fold, max(session_idx) FILTER (role = 'train') AS last_train, min(session_idx) FILTER (role = 'val') AS first_val FROM roles GROUP BY fold HAVING first_val - last_train <= 3", "bars", "index", folds=_FOLDS, roles=_ROLES))
def i6(spark, d):
    return folds.unclean_folds(assigned(spark, d).withColumn("session_idx", F.col("session_idx").cast("long")), purge=3)


@register("i7_date_blocks", sql.query("SELECT date, CAST(ntile(4) OVER (ORDER BY date) - 1 AS INTEGER) AS block FROM (SELECT DISTINCT date FROM bars)", "bars"))
def i7(spark, d):
    return folds.date_blocks(tables.bars_calm(spark, d), 4)


@register("b5_split_development", sql.query("SELECT symbol, date FROM bars WHERE date < (SELECT date FROM index WHERE session_idx = (SELECT min(session_idx) FROM index WHERE date >= DATE '2001-01-01') - 2)", "bars", "index"))
def b5(spark, d):
    return folds.split_development(tables.bars_calm(spark, d), date(2001, 1, 1)).select("symbol", "date")


@register("i8_recent_folds", sql.query(f"SELECT symbol, date, CAST(floor(no / 60) AS INTEGER) AS fold_from_end FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS no FROM bars) WHERE no < 300", "bars"))  # noqa: F541
def i8(spark, d):
    return folds.recent_folds(tables.bars_calm(spark, d)).filter("fold_from_end is not null").select("symbol", "date", "fold_from_end")


# --- metrics --------------------------------------------------------------------------------------------------------

CLASS = ["base_rate", "accuracy", "brier", "log_loss", "precision", "recall", "f1", "skill_vs_majority", "brier_skill_score", "auc", "auc_stderr", "auc_z"]
_METRIC = """SELECT symbol, count(*) AS n, avg(y) AS base_rate, avg(CAST((p >= 0.5) = (y > 0.5) AS INT)) AS accuracy, avg((p - y) * (p - y)) AS brier,
  avg(-CASE WHEN y > 0.5 THEN ln(least(greatest(p, 1e-7), 1 - 1e-7)) ELSE ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)) END) AS log_loss,
  sum(CAST(p >= 0.5 AND y > 0.5 AS INT)) AS tp, sum(CAST(p >= 0.5 AS INT)) AS pp, sum(CAST(y > 0.5 AS INT)) AS n1, sum(CAST(y <= 0.5 AS INT)) AS n0,
  sum(CASE WHEN y > 0.5 THEN rk END) AS rs FROM (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0::DOUBLE AS rk FROM scores) GROUP BY symbol"""
_METRIC2 = "SELECT *, (rs - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS auc, tp / pp AS precision, tp / n1 AS recall, 2 * tp / (pp + n1) AS f1, accuracy - greatest(base_rate, 1 - base_rate) AS skill_vs_majority, 1 - brier / (base_rate * (1 - base_rate)) AS brier_skill_score FROM m"
_METRIC3 = "SELECT *, sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n0 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n1 * n0)) AS auc_stderr FROM m2"


@register("h1_classification", sql.query(f"SELECT symbol, n, {sql.rounded(CLASS)} FROM (SELECT *, (auc - 0.5) / auc_stderr AS auc_z FROM m3)", "scores", m=_METRIC, m2=_METRIC2, m3=_METRIC3))
def h1(spark, d):
    return rounded(metrics.classification_metrics(scores(spark, d), "y", "p", ["symbol"]), CLASS, ("symbol", "n"))


REGRESSION = ["mae", "rmse", "r2", "mae_baseline", "pearson_ic", "information_coefficient", "directional_accuracy", "up_rate"]
_rk = lambda c: f"rank() OVER (PARTITION BY symbol ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol, {c}) - 1) / 2.0::DOUBLE"


@register("h5_regression", sql.query(f"SELECT symbol, n, {sql.rounded(REGRESSION)} FROM (SELECT symbol, count(*) AS n, avg(abs(realised - e)) AS mae, sqrt(avg((realised - e) ** 2)) AS rmse, 1 - sum((realised - e) ** 2) / sum((realised - mu) ** 2) AS r2, avg(abs(realised - mu)) AS mae_baseline, corr(realised, e) AS pearson_ic, corr(ra, rb) AS information_coefficient, avg(CAST(sign(realised) = sign(e) AS INT)) FILTER (realised <> 0) AS directional_accuracy, avg(CAST(realised > 0 AS INT)) AS up_rate FROM x GROUP BY symbol)", "scores", x=f"SELECT *, avg(realised) OVER (PARTITION BY symbol) AS mu, {_rk('realised')} AS ra, {_rk('e')} AS rb FROM scores"))
def h5(spark, d):
    return rounded(metrics.regression_metrics(scores(spark, d), "realised", "e", ["symbol"]), REGRESSION, ("symbol", "n"))


_EDGES = "SELECT symbol, list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edge FROM scores GROUP BY symbol"
_BINS = "SELECT s.symbol, len(list_filter(edge[2:-2], lambda x: x <= p)) AS bin, any_value(edge) AS edge, count(*) AS n, avg(p) AS mean_predicted, avg(y) AS observed_frequency FROM scores s JOIN edges USING (symbol) GROUP BY ALL"


@register("h10_reliability", sql.query("SELECT symbol, CAST(bin AS INTEGER) AS bin, n AS count, round(mean_predicted, 6) AS mean_predicted, round(observed_frequency, 6) AS observed_frequency, round(mean_predicted - observed_frequency, 6) + 0.0 AS gap, round(edge[bin + 1], 6) + 0.0 AS lower, round(edge[bin + 2], 6) + 0.0 AS upper FROM bins", "scores", edges=_EDGES, bins=_BINS))
def h10(spark, d):
    return rounded(metrics.reliability_table(scores(spark, d), "y", "p", by=["symbol"]), ["mean_predicted", "observed_frequency", "gap", "lower", "upper"], ("symbol", "bin", "count"))


@register("h14_calibration", sql.query("SELECT symbol, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(observed_frequency - mean_predicted)) / sum(n), 6) AS ece, round(max(abs(observed_frequency - mean_predicted)) FILTER (n >= 20), 6) AS mce, round((SELECT stddev_pop(p) FROM scores s WHERE s.symbol = b.symbol), 6) AS sharpness FROM bins b GROUP BY symbol", "scores", edges=_EDGES, bins=_BINS))
def h14(spark, d):
    return rounded(metrics.calibration_metrics(scores(spark, d), "y", "p", ["symbol"]), ["ece", "mce", "sharpness"], ("symbol", "n"))


@register("h15_brier_parts", sql.query("SELECT symbol, round(sum(n * (observed_frequency - mean_predicted) ** 2) / sum(n), 6) AS reliability, round(sum(n * (observed_frequency - base) ** 2) / sum(n), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty FROM (SELECT *, sum(n * observed_frequency) OVER (PARTITION BY symbol) / sum(n) OVER (PARTITION BY symbol) AS base FROM bins) GROUP BY symbol", "scores", edges=_EDGES, bins=_BINS))
def h15(spark, d):
    return rounded(metrics.decompose_brier(scores(spark, d), "y", "p", by=["symbol"]), ["reliability", "resolution", "uncertainty"], ("symbol",))


@register("h8_fold_aggregate", sql.query("SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM (SELECT 'auc' AS metric, auc AS v FROM m2 UNION ALL SELECT 'brier', brier FROM m2) GROUP BY metric", "scores", m=_METRIC, m2=_METRIC2))
def h8(spark, d):
    m = metrics.classification_metrics(scores(spark, d), "y", "p", ["symbol"])
    return rounded(metrics.aggregate_folds(m, ["auc", "brier"], []), ["mean", "std"], ("metric",))


@register("h18_fingerprint")
def h18(spark, d):
    return records.fingerprint(tables.bars_calm(spark, d), ["open_split", "close_split", "volume"])


# --- decisions ------------------------------------------------------------------------------------------------------

_INPUTS = "SELECT symbol, date AS decision_date, CASE WHEN day(date) = 11 THEN NULL ELSE p END AS p, CASE WHEN day(date) = 12 THEN NULL ELSE e * 20 END AS e, volatility_20 AS v, CASE WHEN (day(date) + ascii(symbol)) % 3 = 0 THEN 10 ELSE 0 END AS shares, CASE WHEN day(date) = 21 THEN 5 ELSE 1 END AS age, day(date) <> 22 AS complete FROM scores"


def decision_inputs(spark, d):
    day = F.dayofmonth("date")
    s = scores(spark, d)
    return s.select("symbol", F.col("date").alias("decision_date"), F.when(day != 11, F.col("p")).alias("calibrated_probability"), F.when(day != 12, F.col("e") * 20).alias("expected_return"), F.col("volatility_20").alias("volatility"), F.when((day + F.ascii("symbol")) % 3 == 0, 10.0).otherwise(0.0).alias("shares"), F.when(day == 21, 5).otherwise(1).alias("data_age_sessions"), (day != 22).alias("features_complete"))


_GATE = "SELECT *, shares > 0 AS held, CASE WHEN age > 3 THEN 'STALE_DATA' WHEN NOT complete THEN 'MISSING_FEATURES' END AS g FROM inputs"
_WANT = "SELECT *, g IS NULL AND coalesce(p >= 0.55 AND e >= 0.0039, false) AS wants, g IS NULL AND coalesce(p < 0.45, false) AND held AS leaves FROM gates"
_OPEN = "SELECT *, at_open + least(q, greatest(2 - at_open, 0)) - s AS open_before FROM (SELECT *, sum(CAST(held AS INT)) OVER (PARTITION BY decision_date) AS at_open, coalesce(sum(CAST(wants AND NOT held AS INT)) OVER w, 0) AS q, coalesce(sum(CAST(leaves AS INT)) OVER w, 0) AS s FROM want WINDOW w AS (PARTITION BY decision_date ORDER BY p DESC NULLS LAST, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_REASON = "SELECT *, coalesce(g, CASE WHEN NOT held AND open_before >= 2 THEN 'POSITION_LIMIT' WHEN p IS NULL THEN 'MISSING_PROBABILITY' WHEN p >= 0.55 AND e IS NULL THEN 'MISSING_PROBABILITY' WHEN p >= 0.55 AND e < 0.0039 THEN 'BELOW_COST_FLOOR' END) AS reject_reason FROM opened"
_DECIDED = "SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'HOLD' WHEN p >= 0.55 THEN 'BUY' WHEN p < 0.45 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN v < 0.2 THEN 'LOW' WHEN v < 0.35 THEN 'MEDIUM' WHEN v < 0.6 THEN 'HIGH' ELSE 'EXTREME' END AS risk_bucket FROM reasons"
_DECIDE = {"inputs": _INPUTS, "gates": _GATE, "want": _WANT, "opened": _OPEN, "reasons": _REASON, "decided": _DECIDED}


@register("k9_decisions", sql.query("SELECT symbol, decision_date, signal, reject_reason, risk_bucket, CASE WHEN signal = 'BUY' THEN 0.1::DOUBLE WHEN signal = 'SELL' THEN 0.0::DOUBLE WHEN NOT held THEN 0.0::DOUBLE END AS target_weight FROM decided", "scores", **_DECIDE))
def k9(spark, d):
    return decisions.decide(decision_inputs(spark, d), cap=2).select("symbol", "decision_date", "signal", "reject_reason", "risk_bucket", "target_weight")


@register("k8_position_sizes", sql.query("SELECT symbol, decision_date, round(least(greatest(0.1::DOUBLE * 0.25 / v, 0), 0.1::DOUBLE), 6) AS target_weight FROM decided WHERE signal = 'BUY'", "scores", **_DECIDE))
def k8(spark, d):
    sized = decisions.size_positions(decisions.decide(decision_inputs(spark, d), cap=2), "volatility_target")
    return rounded(sized.filter("signal = 'BUY'"), ["target_weight"], ("symbol", "decision_date"))


@register("k8_sizes_by_confidence", sql.query("SELECT symbol, decision_date, round(0.1::DOUBLE * (0.5 + 0.5 * least(greatest((p - 0.55) / 0.45, 0), 1)), 6) AS target_weight FROM decided WHERE signal = 'BUY'", "scores", **_DECIDE))
def k8c(spark, d):
    sized = decisions.size_positions(decisions.decide(decision_inputs(spark, d), cap=2), "confidence")
    return rounded(sized.filter("signal = 'BUY'"), ["target_weight"], ("symbol", "decision_date"))


_EVALUATED = """SELECT count(*) AS n_decisions, count(*) FILTER (signal = 'BUY') AS n_buys, count(*) FILTER (signal = 'SELL') AS n_sells, count(*) FILTER (signal = 'HOLD') AS n_holds, count(*) FILTER (reject_reason IS NOT NULL) AS n_rejected,
  coalesce(avg(realised) FILTER (signal = 'BUY'), 0) AS gross, coalesce(avg(CAST(realised > 0 AS INT)) FILTER (signal = 'BUY'), 0) AS hit_rate, stddev_samp(realised - 0.0026::DOUBLE) FILTER (signal = 'BUY') AS sd FROM decided JOIN scores s ON s.symbol = decided.symbol AND s.date = decided.decision_date"""


@register("h17_decision_evaluation", sql.query("SELECT n_decisions, n_buys, n_sells, n_holds, n_rejected, round(gross, 6) + 0.0 AS gross_return_per_trade, round(CASE WHEN n_buys > 0 THEN gross - 0.0026 ELSE 0 END, 6) + 0.0 AS net_return_per_trade, round(CASE WHEN n_buys > 0 THEN (gross - 0.0026) * n_buys ELSE 0 END, 6) + 0.0 AS total_net_return, round(hit_rate, 6) AS hit_rate, round(CASE WHEN n_buys > 1 THEN (gross - 0.0026) / sd * sqrt(252) END, 6) AS net_sharpe_per_trade, CASE WHEN gross > 0 THEN round(0.0026 / gross, 6) ELSE 'Infinity'::DOUBLE END AS cost_drag_ratio, round(n_buys / n_decisions, 6) AS buy_rate, round(n_rejected / n_decisions, 6) AS rejection_rate FROM evaluated", "scores", **_DECIDE, evaluated=_EVALUATED))
def h17(spark, d):
    out = scores(spark, d).select("symbol", "date", F.col("realised").alias("outcome"))
    m = decisions.evaluate_decisions(decisions.decide(decision_inputs(spark, d), cap=2), out)
    rates = ["gross_return_per_trade", "net_return_per_trade", "total_net_return", "hit_rate", "net_sharpe_per_trade", "buy_rate", "rejection_rate"]
    return rounded(m, rates, ("n_decisions", "n_buys", "n_sells", "n_holds", "n_rejected", F.when(F.col("gross_return_per_trade") > 0, F.round("cost_drag_ratio", 6)).otherwise(F.col("cost_drag_ratio")).alias("cost_drag_ratio")))


@register("h22_signal_counts", sql.query("SELECT CASE WHEN reject_reason IS NOT NULL THEN 'REJECTED' ELSE signal END AS signal, count(*) AS n FROM decided GROUP BY ALL", "scores", **_DECIDE))
def h22(spark, d):
    return records.signal_counts(decisions.decide(decision_inputs(spark, d), cap=2))


_SIGNALS = "SELECT symbol, date, p AS calibrated, realised, e * 20 AS expected_return FROM scores"
_GRID = "SELECT s.*, g / 100.0::DOUBLE AS buy, CASE WHEN calibrated >= g / 100.0::DOUBLE AND expected_return >= 0.0039 THEN realised END AS r FROM signals s, range(45, 81) t(g)"


def threshold_signals(spark, d):
    return scores(spark, d).select("symbol", "date", F.col("p").alias("calibrated"), "realised", (F.col("e") * 20).alias("expected_return"))


_THRESHOLDS = "SELECT round(buy, 2) AS buy, count(*) AS n_rows, count(r) AS n_trades, coalesce(avg(r), 0) AS gross, coalesce(avg(r) - 0.0026::DOUBLE, 0) AS net, coalesce(sum(r - 0.0026::DOUBLE), 0) / count(*) AS net_total, coalesce(avg(CAST(r > 0 AS INT)), 0) AS hit_rate FROM grid GROUP BY ALL"


@register("k10_threshold_scores", sql.query(f"SELECT buy, n_trades, {sql.rounded(['gross', 'net', 'hit_rate'])}, round(net_total, 9) + 0.0 AS net_total, round(n_trades / n_rows, 6) AS trade_rate FROM thresholds", "scores", signals=_SIGNALS, grid=_GRID, thresholds=_THRESHOLDS))
def k10(spark, d):
    out = decisions.score_thresholds(threshold_signals(spark, d), decisions.threshold_grid(spark))
    return rounded(out, ["gross", "net", "hit_rate", "trade_rate"], (F.round("buy", 2).alias("buy"), "n_trades", (F.round("net_total", 9) + 0.0).alias("net_total")))


@register("k11_best_threshold", sql.query("SELECT CASE WHEN n_trades > 0 THEN buy ELSE 0.45 END AS buy, round(net_total, 9) + 0.0 AS net_total FROM (SELECT * FROM thresholds ORDER BY net_total DESC, buy LIMIT 1)", "scores", signals=_SIGNALS, grid=_GRID, thresholds=_THRESHOLDS))
def k11(spark, d):
    best = decisions.best_threshold(decisions.score_thresholds(threshold_signals(spark, d), decisions.threshold_grid(spark)))
    return best.select(F.round("buy", 2).alias("buy"), (F.round("net_total", 9) + 0.0).alias("net_total"))


#: Blocks of sessions as near to equal as can be, the first ones longer.
_BLOCKS = "SELECT date, CAST(CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END AS INT) AS block FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () // 4 AS q, count(*) OVER () % 4 AS r FROM (SELECT DISTINCT date FROM signals))"
_PER_BLOCK = "SELECT block, round(buy, 2) AS buy, count(*) AS n_rows, count(r) AS n_trades, coalesce(sum(r - 0.0026::DOUBLE), 0) AS net FROM grid JOIN blocks USING (date) GROUP BY ALL"
_CHOSEN = "SELECT block, CASE WHEN arg_max(n, row(net, -buy)) > 0 THEN arg_max(buy, row(net, -buy)) ELSE min(buy) END AS buy FROM (SELECT b.block, p.buy, sum(p.net) / sum(p.n_rows) AS net, sum(p.n_trades) AS n, sum(p.n_rows) AS n_rows FROM (SELECT DISTINCT block FROM per_block) b JOIN per_block p ON p.block < b.block GROUP BY ALL) WHERE n_rows >= 500 GROUP BY block"


@register("k12_block_thresholds", sql.query("SELECT p.block, p.buy, n_trades, round(net / n_rows, 9) + 0.0 AS net_total FROM chosen JOIN per_block p USING (block, buy)", "scores", signals=_SIGNALS, grid=_GRID, blocks=_BLOCKS, per_block=_PER_BLOCK, chosen=_CHOSEN))
def k12(spark, d):
    s = threshold_signals(spark, d)
    out = decisions.out_of_block_thresholds(s, decisions.threshold_grid(spark), folds.date_blocks(s, 4))
    return out.select("block", F.round("buy", 2).alias("buy"), "n_trades", (F.round("net_total", 9) + 0.0).alias("net_total"))


@register("k2_cost_feasibility", sql.query("SELECT symbol, round(s, 6) AS sigma, round(0.0026::DOUBLE / (s * 1.755), 6) AS breakeven_ic, s * 1.755 * 0.03 > 0.0026 AS feasible FROM (SELECT symbol, stddev_samp(return_1d) AS s FROM scores GROUP BY symbol)", "scores"))
def k2(spark, d):
    return rounded(decisions.cost_feasibility(scores(spark, d)), ["sigma", "breakeven_ic"], ("symbol", "feasible"))


# --- portfolio ------------------------------------------------------------------------------------------------------

_WEIGHTS = f"SELECT symbol, date, r, coalesce(last_value(t IGNORE NULLS) OVER ({sql.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM (SELECT symbol, date, return_1d AS r, CASE WHEN p >= 0.55 THEN 0.1::DOUBLE WHEN p < 0.45 THEN 0.0::DOUBLE END AS t FROM scores)"
_DAILY = f"SELECT date, sum(w * coalesce(r, 0)) AS gross, sum(dw) AS turnover, sum(w) AS exposure FROM (SELECT *, abs(w - coalesce(lag(w) OVER ({sql.W}), 0)) AS dw FROM weights) GROUP BY date"
_CURVE = "SELECT *, gross - turnover * 0.0013::DOUBLE AS net, product(1 + gross - turnover * 0.0013::DOUBLE) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM daily"


def weights(spark, d):
    p = F.col("p")
    s = scores(spark, d).withColumn("target_weight", F.when(p >= 0.55, 0.1).when(p < 0.45, 0.0))
    return portfolio.target_weights(s).withColumn("ret", F.col("return_1d"))


@register("l2_strategy_returns", sql.query(f"SELECT date, {sql.rounded(['gross', 'turnover', 'exposure', 'net', 'equity'])} FROM curve", "scores", weights=_WEIGHTS, daily=_DAILY, curve=_CURVE))
def l2(spark, d):
    return rounded(portfolio.strategy_returns(weights(spark, d)), ["gross", "turnover", "exposure", "net", "equity"], ("date",))


def curve(spark, d):
    return portfolio.strategy_returns(weights(spark, d)).withColumn("name", F.lit("strategy"))


@register("l9_drawdowns", sql.query("SELECT 'strategy' AS name, round(min(dd), 6) AS max_drawdown, CAST(max(k) AS BIGINT) AS longest_underwater FROM (SELECT run, sum(CAST(under AS INT)) AS k, min(equity / peak - 1) AS dd FROM (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, equity < peak AS under FROM (SELECT *, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM curve))) GROUP BY run)", "scores", weights=_WEIGHTS, daily=_DAILY, curve=_CURVE))
def l9(spark, d):
    return rounded(portfolio.drawdowns(curve(spark, d)), ["max_drawdown"], ("name", "longest_underwater"))


# --- models ---------------------------------------------------------------------------------------------------------

MODEL_FEATURES = ["return_1d", "return_5d", "volatility_20"]


def out_of_fold(spark, d, fit, label):
    df = simple_panel(spark, d).select("symbol", "date", *MODEL_FEATURES, F.col(label).alias("label"))
    index = calendar.session_index(df)
    bounds = folds.fold_bounds(spark, index.count())
    return models.generate_oof(tables.settled(folds.assign_folds(df, bounds, index)), fit, MODEL_FEATURES, "label")


@register("j6_logistic_out_of_fold")
def j6(spark, d):
    return out_of_fold(spark, d, models.fit_logistic(), "tradeable_direction_1d")


MODEL_ROLES = "SELECT t.*, fold, CASE WHEN i < start - 2 THEN 'train' WHEN i >= start AND i < start + 126 THEN 'val' END AS role FROM trimmed t JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM trimmed)) x USING (date), (SELECT unnest(range(5)) AS fold) f, LATERAL (SELECT n - (5 - fold) * 126 AS start) s"


def _ridge(alpha: float, label: str) -> dict[str, str]:
    """Medians, means and deviations of a fold's training rows, normal equations of three features solved by determinants, and the scores of validation rows."""
    z, pairs = ("z1", "z2", "z3"), [(i, j) for i in range(3) for j in range(i, 3)]
    cell = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def determinant(column: int | None) -> str:
        at = lambda i, j: f"r{i}" if j == column else cell(i, j)
        return f"({at(0, 0)} * ({at(1, 1)} * {at(2, 2)} - {at(1, 2)} * {at(2, 1)}) - {at(0, 1)} * ({at(1, 0)} * {at(2, 2)} - {at(1, 2)} * {at(2, 0)}) + {at(0, 2)} * ({at(1, 0)} * {at(2, 1)} - {at(1, 1)} * {at(2, 0)}))"

    each = lambda f: ", ".join(f(i, c) for i, c in enumerate(MODEL_FEATURES))
    return {
        "roles": MODEL_ROLES,
        "known": f"SELECT *, {label} AS y FROM roles WHERE {label} IS NOT NULL AND role IN ('train', 'val')",
        "middles": f"SELECT fold, {each(lambda i, c: f'median({c}) AS m{i}')} FROM known WHERE role = 'train' GROUP BY fold",
        "filled": f"SELECT k.fold, role, y, {each(lambda i, c: f'coalesce({c}, m{i}) AS f{i}')} FROM known k JOIN middles USING (fold)",
        "scales": f"SELECT fold, avg(y) AS mean_y, {each(lambda i, c: f'avg(f{i}) AS a{i}, stddev_pop(f{i}) AS d{i}')} FROM filled WHERE role = 'train' GROUP BY fold",
        "scaled": f"SELECT fold, role, y, mean_y, {each(lambda i, c: f'(f{i} - a{i}) / d{i} AS {z[i]}')} FROM filled JOIN scales USING (fold)",
        "sums": f"SELECT fold, {', '.join(f'sum({z[i]} * {z[j]}) + {alpha if i == j else 0.0}::DOUBLE AS s{i}{j}' for i, j in pairs)}, {each(lambda i, c: f'sum({z[i]} * (y - mean_y)) AS r{i}')} FROM scaled WHERE role = 'train' GROUP BY fold",
        "weights": f"SELECT fold, {each(lambda i, c: f'{determinant(i)} / {determinant(None)} AS w{i}')} FROM sums",
        "oof": f"SELECT fold, y AS realised, mean_y + {' + '.join(f'w{i} * {z[i]}' for i in range(3))} AS e FROM scaled JOIN weights USING (fold) WHERE role = 'val'",
        "x": f"SELECT *, avg(realised) OVER (PARTITION BY fold) AS mu, {_rk('realised').replace('symbol', 'fold')} AS ra, {_rk('e').replace('symbol', 'fold')} AS rb FROM oof",
    }


_ERRORS, _FITS = ["mae", "rmse", "r2", "mae_baseline", "directional_accuracy", "up_rate"], ["pearson_ic", "information_coefficient"]


@register("j2_ridge_out_of_fold_metrics", sql.query(f"SELECT CAST(fold AS INTEGER) AS fold, n, {sql.rounded(_ERRORS)}, {sql.rounded(_FITS, 4)} FROM (SELECT fold, count(*) AS n, avg(abs(realised - e)) AS mae, sqrt(avg((realised - e) ** 2)) AS rmse, 1 - sum((realised - e) ** 2) / sum((realised - mu) ** 2) AS r2, avg(abs(realised - mu)) AS mae_baseline, corr(realised, e) AS pearson_ic, corr(ra, rb) AS information_coefficient, avg(CAST(sign(realised) = sign(e) AS INT)) FILTER (realised <> 0) AS directional_accuracy, avg(CAST(realised > 0 AS INT)) AS up_rate FROM x GROUP BY fold)", "trimmed", **_ridge(10.0, "tradeable_return_1d")))
def j2(spark, d):
    m = metrics.regression_metrics(out_of_fold(spark, d, models.fit_ridge(), "tradeable_return_1d"), "y_true", "y_pred", ["fold"])
    return rounded(m, _ERRORS, ("fold", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in _FITS]))


@register("j11_calibrated_out_of_fold")
def j11(spark, d):
    oof = tables.settled(out_of_fold(spark, d, models.fit_logistic(), "tradeable_direction_1d"))
    return models.calibrate_out_of_fold(oof, folds.date_blocks(oof, 4))


@register("j17_next_session_forecasts")
def j17(spark, d):
    b = tables.bars_calm(spark, d).select("symbol", "date", *[F.col(f"{c}_split").alias(c) for c in ("open", "high", "low", "close")])
    names = ["return_1", "return_5", "return_20", "session_return", "range", "gap", "volatility", "close_position"]
    return models.forecast_symbols(features.session_features(b), names)


# --- monitoring -----------------------------------------------------------------------------------------------------

_PART = "SELECT unnest(['return_1d', 'return_5d', 'volatility_20']) AS feature, unnest([return_1d, return_5d, volatility_20]) AS value, CASE WHEN date_diff('day', DATE '1970-01-01', date) <= floor((SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.75) FROM scores)) THEN 'reference' ELSE 'current' END AS part FROM scores"
_PSI_EDGE = "SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM long WHERE part = 'reference' GROUP BY feature"
_PSI_BIN = "SELECT feature, bin, count(*) FILTER (part = 'reference') AS r, count(*) FILTER (part = 'current') AS c FROM (SELECT l.*, len(list_filter(e, lambda x: x <= value)) AS bin FROM long l JOIN edge USING (feature)) GROUP BY ALL"
_PSI_ALL = "SELECT f.feature, b.bin, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM (SELECT DISTINCT feature FROM long) f CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN bins ON bins.feature = f.feature AND bins.bin = b.bin"
_PSI = "SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM (SELECT feature, (r + 1) / (sum(r) OVER (PARTITION BY feature) + 10) AS pr, (c + 1) / (sum(c) OVER (PARTITION BY feature) + 10) AS pc FROM every_bin) GROUP BY feature"
_KS = "SELECT feature, max(abs(a - b)) AS ks FROM (SELECT feature, sum(r) OVER (PARTITION BY feature ORDER BY value) / sum(r) OVER (PARTITION BY feature) AS a, sum(c) OVER (PARTITION BY feature ORDER BY value) / sum(c) OVER (PARTITION BY feature) AS b FROM (SELECT feature, value, count(*) FILTER (part = 'reference') AS r, count(*) FILTER (part = 'current') AS c FROM long GROUP BY ALL)) GROUP BY feature"
DRIFTING = ["return_1d", "return_5d", "volatility_20"]


def drift_of(scored):
    return monitoring.compute_drift(monitoring.split_reference_current(scored), DRIFTING)


def drift(spark, d):
    """All features against the reference part; the scores are settled, as every statistic reads them."""
    return drift_of(tables.settled(scores(spark, d)))


_DRIFT_BASE = "SELECT feature, count(value) FILTER (part = 'reference') AS n_reference, count(value) FILTER (part = 'current') AS n_current, avg(value) FILTER (part = 'reference') AS reference_mean, avg(value) FILTER (part = 'current') AS current_mean, avg(CAST(value IS NULL AS DOUBLE)) FILTER (part = 'reference') AS reference_missing, avg(CAST(value IS NULL AS DOUBLE)) FILTER (part = 'current') AS current_missing FROM long GROUP BY feature"
_KS_P = "SELECT *, CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(list_sum([CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * x * x) FOR k IN range(1, 101)]), 0.0::DOUBLE), 1.0::DOUBLE) END AS ks_p FROM (SELECT *, ks * sqrt(n_reference::DOUBLE * n_current / (n_reference + n_current)) AS x FROM psi JOIN ks USING (feature) JOIN drift_base USING (feature))"
_DRIFT_ALL = "SELECT *, i <= coalesce(max(CASE WHEN ks_p <= 0.05 * i / m THEN i END) OVER (), 0) AS discovered FROM (SELECT *, row_number() OVER (ORDER BY ks_p, feature) AS i, count(*) OVER () AS m FROM ks_ps)"
_DRIFT = {"long": _PART, "edge": _PSI_EDGE, "bins": _PSI_BIN, "every_bin": _PSI_ALL, "psi": _PSI, "ks": _KS, "drift_base": _DRIFT_BASE, "ks_ps": _KS_P, "drifted": _DRIFT_ALL}


@register("m4_drift", sql.query(f"SELECT feature, n_reference, n_current, {sql.rounded(['psi', 'ks', 'ks_p', 'reference_mean', 'current_mean', 'reference_missing', 'current_missing'])}, CASE WHEN psi >= 0.25 THEN 'SIGNIFICANT' WHEN psi >= 0.1 THEN 'MODERATE' ELSE 'STABLE' END AS severity, discovered FROM drifted", "scores", **_DRIFT))
def m4(spark, d):
    return rounded(drift(spark, d), ["psi", "ks", "ks_p", "reference_mean", "current_mean", "reference_missing", "current_missing"], ("feature", "n_reference", "n_current", "severity", "discovered"))


def resolved(spark, d):
    return as_resolved(scores(spark, d))


def as_resolved(scored):
    return scored.select(F.col("date").alias("prediction_date"), "symbol", F.col("p").alias("calibrated_probability"), F.col("y").alias("actual_direction"))


AS_OF = date(2001, 6, 30)


@register("m7_rolling_performance", sql.query("SELECT CAST(days AS INTEGER) AS days, count(y) AS n, round(avg((p - y) * (p - y)), 6) AS brier, CASE WHEN count(y) > 0 THEN round(2 * sqrt(4.0 / count(y)), 6) ELSE 'Infinity'::DOUBLE END AS mde, count(y) >= 100 AS reportable FROM (SELECT unnest([0, 7, 30, 60, 90]) AS days) LEFT JOIN scores ON date <= DATE '2001-06-30' AND date > DATE '2001-06-30' - CAST(days AS INTEGER) GROUP BY days", "scores"))
def m7(spark, d):
    out = monitoring.rolling_performance(resolved(spark, d), AS_OF, (0, *monitoring.WINDOWS))
    return rounded(out, ["brier"], ("days", "n", "reportable", F.when(F.col("n") > 0, F.round("mde", 6)).otherwise(F.col("mde")).alias("mde")))


def drift_history(s):
    """Three checks of drift, each over the sessions up to a later day."""
    ends = [date(1999, 1, 1), date(2000, 1, 1), date(2001, 1, 1)]
    out = None
    for end in ends:
        one = monitoring.drift_checks(drift_of(s.filter(F.col("date") < F.lit(end))), F.lit(end))
        out = one if out is None else out.unionByName(one)
    return out


@register("m13_health_row")
def m13(spark, d):
    s = tables.settled(scores(spark, d))
    r = as_resolved(s)
    return monitoring.health_row(drift_of(s), monitoring.drift_persistence(drift_history(s)), monitoring.rolling_performance(r, AS_OF), monitoring.monitor_calibration(r, AS_OF, 0.03), r, 0.55, 0.03)


@register("m12_alert_cooldown", "WITH RECURSIVE a AS (SELECT DISTINCT event_type AS code, CAST(ts AS DATE) AS day FROM events WHERE value > 30), e AS (SELECT code, min(day) AS day FROM a GROUP BY code UNION ALL SELECT e.code, min(a.day) FROM e JOIN a ON a.code = e.code AND a.day >= e.day + 3 GROUP BY e.code) SELECT code, day FROM e")
def m12(spark, d):
    a = tables.read_table(spark, d, "events").filter("value > 30").select(F.col("event_type").alias("code"), F.to_date("ts").alias("day"))
    return monitoring.emitted_alerts(a)


@register(
    "m5_drift_persistence",
    "SELECT feature, count(*) FILTER (ok = 0) AS streak, count(*) FILTER (ok = 0) >= 3 AS persistent FROM (SELECT event_type AS feature, sum(CASE WHEN breached THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS ok FROM (SELECT event_type, CAST(ts AS DATE) AS day, max(value) > 20 AS breached FROM events GROUP BY ALL)) GROUP BY feature",
)
def m5(spark, d):
    h = tables.read_table(spark, d, "events").groupBy(F.col("event_type").alias("feature"), F.to_date("ts").alias("checked_at")).agg((F.max("value") > 20).alias("breached"))
    return monitoring.drift_persistence(h)


# --- records --------------------------------------------------------------------------------------------------------

_PREDS = "SELECT symbol, date AS prediction_date, p, e, date + 1 AS execution_date, CASE WHEN day(date) = 5 THEN 'RESOLVED' ELSE 'PREDICTED' END AS status, realised FROM scores"


def predictions(spark, d):
    s = scores(spark, d).select("symbol", F.col("date").alias("prediction_date"), F.lit("m1").alias("model_version"), F.lit("f1").alias("feature_version"), F.lit("d1").alias("decision_version"), F.lit("t1").alias("threshold_version"), F.col("p").alias("predicted_probability"), F.col("p").alias("calibrated_probability"), F.col("e").alias("predicted_return"), F.date_add("date", 1).alias("execution_date"), F.when(F.dayofmonth("date") == 5, "RESOLVED").otherwise("PREDICTED").alias("status"))
    return records.natural_id(s)


@register("n5_resolve_outcomes", sql.query("SELECT substr(sha256(symbol || '|' || CAST(prediction_date AS VARCHAR) || '|m1|f1|d1|t1'), 1, 32) AS prediction_id, round(realised, 6) + 0.0 AS actual_return, CAST(realised > 0 AS INTEGER) AS actual_direction, CAST((p >= 0.5) = (realised > 0) AS INTEGER) AS direction_correct, round(e - realised, 6) + 0.0 AS return_error FROM preds WHERE status = 'PREDICTED' AND execution_date <= DATE '2001-06-30' AND year(prediction_date) >= 2000", "scores", preds=_PREDS))
def n5(spark, d):
    p = predictions(spark, d)
    real = scores(spark, d).select("symbol", "date", F.col("realised").alias("actual_return"))
    out = records.resolve(p, real, p.filter(F.year("prediction_date") < 2000).select("prediction_id"), AS_OF)
    return rounded(out, ["actual_return", "return_error"], ("prediction_id", "actual_direction", "direction_correct"))


@register("h20_prediction_health", sql.query("SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM preds GROUP BY status", "scores", preds=_PREDS))
def h20(spark, d):
    return rounded(records.prediction_health(predictions(spark, d)), ["share"], ("status", "n"))


@register("n2_classify_saves", sql.query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN year(prediction_date) >= 2001 THEN 'insert' WHEN day(prediction_date) = 7 THEN 'conflict' ELSE 'noop' END AS action FROM preds) GROUP BY action", "scores", preds=_PREDS))
def n2(spark, d):
    p = predictions(spark, d)
    old = p.filter(F.year("prediction_date") < 2001).withColumn("predicted_return", F.when(F.dayofmonth("prediction_date") == 7, F.col("predicted_return") + 1).otherwise(F.col("predicted_return")))
    return records.classify_saves(p, old, ["predicted_probability", "predicted_return"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_FORECAST = f"SELECT symbol, date, {sql.lead('date')} AS forecast_session, CASE WHEN r5 > 0 THEN 'UP' WHEN day(date) = 3 THEN 'NONE' ELSE 'DOWN' END AS direction FROM (SELECT symbol, date, return_5d AS r5 FROM trimmed)"
_RESULT = "SELECT f.*, CASE WHEN direction = 'NONE' THEN 'INELIGIBLE' WHEN b.close_split IS NULL THEN 'PENDING' WHEN b.close_split = b.open_split THEN 'FLAT' WHEN (b.close_split > b.open_split) = (direction = 'UP') THEN 'CORRECT' ELSE 'WRONG' END AS result FROM forecasts f LEFT JOIN bars b ON b.symbol = f.symbol AND b.date = f.forecast_session WHERE f.forecast_session IS NOT NULL"


def forecasts_of(p, *more):
    f = p.select("symbol", F.col("date").alias("as_of"), F.lead("date").over(by_symbol()).alias("forecast_session"), F.when(F.col("return_5d") > 0, "UP").when(F.dayofmonth("date") == 3, "NONE").otherwise("DOWN").alias("direction"), (F.col("return_5d") / 10).alias("expected_return"), F.col("date").cast("timestamp").alias("created_at"), *more)
    return f.filter("forecast_session is not null")


def scored_forecasts(spark, d):
    f = forecasts_of(simple_panel(spark, d))
    bars = tables.bars_calm(spark, d).select("symbol", "date", F.col("open_split").alias("open"), F.col("close_split").alias("close"))
    return records.score_forecasts(f, bars)


@register("n6_forecast_results", sql.query("SELECT symbol, forecast_session, direction, result FROM results", "trimmed", forecasts=_FORECAST, results=_RESULT))
def n6(spark, d):
    return scored_forecasts(spark, d).select("symbol", "forecast_session", "direction", "result")


_PERCENT = "SELECT symbol, forecast_session, result, CASE WHEN open_split IS NULL OR result = 'INELIGIBLE' THEN NULL ELSE CASE WHEN close_split > open_split THEN 'UP' WHEN close_split < open_split THEN 'DOWN' ELSE 'FLAT' END END AS actual_direction, round(CASE WHEN result <> 'INELIGIBLE' THEN 100 * (close_split / open_split - 1) END, 6) + 0.0 AS actual_return_pct, round(CASE WHEN result <> 'INELIGIBLE' THEN 100 * (close_split / open_split - 1 - r5 / 10) END, 6) + 0.0 AS error_pp, round(10 * r5, 6) + 0.0 AS predicted_return_pct, round(100 / (1 + exp(-20 * r5)), 6) AS probability_up_pct, round(CASE WHEN result <> 'INELIGIBLE' THEN open_split END, 6) AS actual_open, round(CASE WHEN result <> 'INELIGIBLE' THEN close_split END, 6) AS actual_close FROM results JOIN (SELECT symbol, date, return_5d AS r5 FROM trimmed) USING (symbol, date)"


@register("n7_forecast_history", sql.query(_PERCENT, "trimmed", forecasts=_FORECAST, results=_RESULT.replace("SELECT f.*,", "SELECT f.*, b.open_split, b.close_split,")))
def n7(spark, d):
    f = simple_panel(spark, d).withColumn("probability_up", 1 / (1 + F.exp(-20 * F.col("return_5d"))))
    f = forecasts_of(f, "probability_up")
    bars = tables.bars_calm(spark, d).select("symbol", "date", F.col("open_split").alias("open"), F.col("close_split").alias("close"))
    history = records.forecast_history(f, tables.settled(records.forecast_outcomes(f, bars)))
    return rounded(history, ["actual_return_pct", "error_pp", "predicted_return_pct", "probability_up_pct", "actual_open", "actual_close"], ("symbol", "forecast_session", "result", "actual_direction"))


@register("h23_forecast_accuracy", sql.query("SELECT " + ", ".join(f"count(*) FILTER (result = '{r}') AS n_{r.lower()}" for r in ("CORRECT", "WRONG", "FLAT", "PENDING", "INELIGIBLE")) + ", round(count(*) FILTER (result = 'CORRECT') / count(*) FILTER (result IN ('CORRECT', 'WRONG')), 6) AS accuracy FROM results", "trimmed", forecasts=_FORECAST, results=_RESULT))
def h23(spark, d):
    return rounded(records.forecast_accuracy(scored_forecasts(spark, d)), ["accuracy"], tuple(f"n_{r}" for r in ("correct", "wrong", "flat", "pending", "ineligible")))


@register("h24_forecast_crosstab", sql.query("SELECT forecast_session, " + ", ".join(f'count(*) FILTER (result = \'{r}\') AS "{r}"' for r in ("CORRECT", "WRONG", "FLAT", "PENDING", "INELIGIBLE")) + " FROM results GROUP BY forecast_session", "trimmed", forecasts=_FORECAST, results=_RESULT))
def h24(spark, d):
    return records.forecast_crosstab(scored_forecasts(spark, d))


def runs(spark, d):
    """One run for each customer: a task by nation, the value a mean order.

    Prices are added one by one in the order of their keys: a mean of doubles
    that ends on half a unit rounds by the order in which it was summed, and
    partial sums would make that the order of partitions.
    """
    o = tables.read_table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = o.select("o_custkey", "o_orderdate", F.count(F.lit(1)).over(w).alias("_no"), F.sum("o_totalprice").over(w).alias("_sum"), F.count("o_totalprice").over(w).alias("_n"))
    mean = F.try_divide(F.max_by("_sum", "_no"), F.max("_n"))
    return o.groupBy("o_custkey").agg(rounded_double(mean / 1e6).alias("primary_value"), F.min("o_orderdate").alias("created_at")).select(F.col("o_custkey").alias("experiment_id"), (F.col("o_custkey") % 7).alias("task"), "primary_value", "created_at")


_RUNS = "SELECT o_custkey AS experiment_id, o_custkey % 7 AS task, round(avg(o_totalprice) / 1e6, 6) AS primary_value, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey"
_RANKED = f"SELECT *, count(*) OVER t AS n, max(primary_value) OVER t AS best, rank() OVER (PARTITION BY task ORDER BY primary_value DESC) AS rank, row_number() OVER (PARTITION BY task ORDER BY created_at, experiment_id) - 1 AS n_prior FROM ({_RUNS}) WINDOW t AS (PARTITION BY task)"


@register("n9_leaderboard", f"SELECT experiment_id, task, n, CAST(rank AS BIGINT) AS rank, CAST(n_prior AS BIGINT) AS n_prior, round(inflation, 9) + 0.0 AS inflation, round(primary_value - inflation, 9) + 0.0 AS selection_adjusted, best - primary_value > 2 * {records.STDERR}::DOUBLE * sqrt(2::DOUBLE) AS distinguishable FROM (SELECT *, CASE WHEN n > 1 THEN {records.STDERR}::DOUBLE * z ELSE 0 END AS inflation FROM (SELECT *, {normal.quantile_sql('p')} AS z FROM (SELECT *, 1 - 1 / (n + 1)::DOUBLE AS p FROM ({_RANKED}))))")
def n9(spark, d):
    out = records.leaderboard(runs(spark, d))
    return rounded(out, ["inflation", "selection_adjusted"], ("experiment_id", "task", "n", F.col("rank").cast("long").alias("rank"), F.col("n_prior").cast("long").alias("n_prior"), "distinguishable"), 9)




@register("n9_task_summary", f"SELECT task, count(*) AS n, round(max(primary_value), 5) AS best, round(min(primary_value), 5) AS worst, round(stddev_samp(primary_value), 5) AS sd FROM ({_RUNS}) GROUP BY task")
def n9s(spark, d):
    return rounded(records.task_summary(runs(spark, d)), ["best", "worst", "sd"], ("task", "n"), 5)


@register("n12_duplicate_runs", "SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1) GROUP BY n")
def n12(spark, d):
    o = tables.read_table(spark, d, "orders").withColumn("primary_value", F.col("o_totalprice"))
    return records.duplicate_runs(o, ["o_custkey", "o_orderpriority"]).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


_STAGES = ("CANDIDATE", "VALIDATING", "VALIDATED", "STAGING", "PRODUCTION", "ARCHIVED", "FAILED")
#: Every third customer's entries follow the stages in order; those of the others follow their order keys.
_MOVES_N = f"SELECT o_custkey AS m, o_custkey % 11 AS task, o_orderkey AS ord, ({list(_STAGES)})[CASE WHEN o_custkey % 3 = 0 THEN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 7 ELSE o_orderkey % 7 END + 1] AS s FROM orders"
_LEGAL = ", ".join(f"({'NULL' if a is None else repr(a)}, '{b}')" for a, b in records.TRANSITIONS)


def moves(spark, d):
    o = tables.read_table(spark, d, "orders")
    no = F.when(F.col("o_custkey") % 3 == 0, (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) % 7).otherwise(F.col("o_orderkey") % 7)
    stage = F.element_at(F.array(*[F.lit(x) for x in _STAGES]), (no + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("model_version"), (F.col("o_custkey") % 11).alias("task"), stage.alias("to_stage"), F.col("o_orderkey").alias("occurred_at"))


@register("n13_illegal_transitions", f"SELECT m AS model_version, ord AS occurred_at, s AS to_stage, b AS before FROM (SELECT *, lag(s) OVER (PARTITION BY m ORDER BY ord) AS b FROM ({_MOVES_N})) t WHERE NOT EXISTS (SELECT 1 FROM (VALUES {_LEGAL}) l(x, y) WHERE x IS NOT DISTINCT FROM t.b AND y = t.s)")
def n13(spark, d):
    return records.illegal_transitions(spark, moves(spark, d)).select("model_version", "occurred_at", "to_stage", "before")


@register("n13_shared_production", f"SELECT m AS model_version, task, ord AS occurred_at, n_live FROM (SELECT *, CAST(sum(dd) OVER (PARTITION BY task ORDER BY ord) AS BIGINT) AS n_live FROM (SELECT *, CAST(s = 'PRODUCTION' AS INT) - coalesce(CAST(lag(s) OVER (PARTITION BY m ORDER BY ord) = 'PRODUCTION' AS INT), 0) AS dd FROM ({_MOVES_N}))) WHERE s = 'PRODUCTION' AND dd = 1 AND n_live > 1")
def n13p(spark, d):
    return records.shared_production(moves(spark, d)).select("model_version", "task", "occurred_at", "n_live")


@register("n13_current_stages", f"SELECT m AS model_version, arg_max(s, ord) AS stage, count(*) AS n_moves FROM ({_MOVES_N}) GROUP BY m")
def n13c(spark, d):
    return records.current_stages(moves(spark, d))


@register("g1_meta_features", sql.query("SELECT a.date, a.symbol, round(a.p, 6) AS model_a, round(1 - a.p, 6) AS model_b, y AS y_true, round(volatility_20, 6) AS volatility_20 FROM scores a WHERE day(date) <> 4", "scores"))
def g1(spark, d):
    s = scores(spark, d)
    a = s.select("date", "symbol", F.col("y").alias("y_true"), F.col("p").alias("y_pred"))
    b = a.filter(F.dayofmonth("date") != 4).withColumn("y_pred", 1 - F.col("y_pred"))
    out = records.meta_features({"model_a": a, "model_b": b}, s.select("date", "symbol", "volatility_20"))
    return rounded(out, ["model_a", "model_b", "volatility_20"], ("date", "symbol", "y_true"))


# --- candles --------------------------------------------------------------------------------------------------------


@register("p1_hourly_candles", sql.query("SELECT timestamp, symbol, '1h' AS interval, open, high, low, close, volume FROM candles", "candles"))
def p1(spark, d):
    return streaming.candles(tables.ticks(spark, d), "1h")


@register("p3_upserted_candles", sql.query("SELECT timestamp, symbol, '1h' AS interval, open, high, low, close, volume FROM candles", "candles"))
def p3(spark, d):
    """The ticks as a stream, their candles upserted batch by batch, then read back."""
    stream = spark.readStream.schema(tables.read_table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ticks = stream.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    own = f"{tables.work_folder(spark)}/candles-{uuid.uuid4().hex}"
    streaming.keep_upserting(streaming.candles(ticks, "1h", "1 day"), f"{own}/table", f"{own}/checkpoint").awaitTermination()
    return _upserted(spark, f"{own}/table")


def _upserted(spark, table):
    return streaming.read_upserted(spark, table).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol", "interval", "open", "high", "low", "close", "volume")


@register("p3_compacted_candles", sql.query("SELECT timestamp, symbol, '1h' AS interval, open, high, low, close, volume FROM candles", "candles"))
def p3_compacted(spark, d):
    """Batches of candles, each as of a later tick, merged into snapshots of days as they come, then read back."""
    ticks = tables.ticks(spark, d)
    table = f"{tables.work_folder(spark)}/candles-{uuid.uuid4().hex}"
    for number, (part, of) in enumerate(((0, 2), (1, 2))):
        # The second batch has all ticks: its candles replace those that half of the ticks gave.
        own = ticks if number else ticks.filter(F.col("event_id") % of == part)
        batch = streaming.candles(own, "1h").withColumn("fetched_at", F.lit(f"2024-06-0{number + 1}").cast("timestamp")).withColumn("day", F.to_date("timestamp"))
        batch.write.mode("overwrite").partitionBy("day").parquet(f"{table}/query=q/batch={number}")
        streaming.compact(spark, table)
    return _upserted(spark, table)


@register("b7_completed_candles", sql.query("SELECT timestamp, symbol, close, volume FROM candles WHERE least(open, high, low, close) > 0 AND isodow(timestamp) < 6 AND hour(timestamp) BETWEEN 10 AND 15 AND timestamp < TIMESTAMP '2024-01-20 00:00:00'", "candles"))
def b7(spark, d):
    return streaming.completed(streaming.candles(tables.ticks(spark, d), "1h"), 60, "2024-01-20 00:00:00").select("timestamp", "symbol", "close", "volume")


@register("h25_candle_summary", sql.query("SELECT symbol, CAST(timestamp AS DATE) AS date, arg_max(close, timestamp) AS last_close, min(close) AS low_close, max(close) AS high_close FROM candles GROUP BY ALL", "candles"))
def h25(spark, d):
    return streaming.candle_summary(streaming.candles(tables.ticks(spark, d), "1h"))
