"""Bars, ticks and other panels: derived from trade tables, read from and written to a lake.

A lake holds one folder for each symbol, so a filter on symbols reads only
those. Writing replaces the symbols written (dynamic partition overwrite).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS_RAW = "date date, symbol string, open_split double, high_split double, low_split double, close_split double, volume bigint, dividend double, split_ratio double"
FORECASTS = "index string, symbol string, direction string, expected_return double, probability_up double, forecast_session date, as_of date, created_at timestamp"
EQUITY = "date date, equity double, cash double"
BAR_COLUMNS = [f.split()[0] for f in BARS_RAW.split(", ")]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calm_price(day: Column, amount: Column) -> Column:
    """A price near a slow trend, to four digits."""
    days = F.datediff(day, F.lit("1995-01-01").cast("date"))
    x = 500 * (1 + 0.0002 * days) * (1 + ((amount % 1000) / 1000 - 0.5) * 0.04)
    return F.floor(x * 10000 + 0.5) / 10000


def bars_from_trades(trades: DataFrame, symbol: Column, day: Column, price: Column, size: Column, key: list[str]) -> DataFrame:
    """Raw daily bars of trades. Splits and dividends follow the calendar: 2 for 1 on 1 July, 1 % on 15 March and September."""
    order = F.struct(*key)
    bars = trades.select(symbol.alias("symbol"), day.alias("date"), price.alias("_p"), size.alias("_n"), order.alias("_k"))
    bars = bars.groupBy("symbol", "date").agg(
        F.min_by("_p", "_k").alias("open_split"),
        F.max("_p").alias("high_split"),
        F.min("_p").alias("low_split"),
        F.max_by("_p", "_k").alias("close_split"),
        F.sum("_n").cast("long").alias("volume"),
    )
    before = F.lag("close_split").over(Window.partitionBy("symbol").orderBy("date"))
    pays = F.month("date").isin(3, 9) & (F.dayofmonth("date") == 15)
    splits = (F.month("date") == 7) & (F.dayofmonth("date") == 1)
    return bars.withColumn("dividend", F.when(pays, F.coalesce(before * 0.01, F.lit(0.0))).otherwise(0.0)).withColumn("split_ratio", F.when(splits, 2.0).otherwise(1.0))


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def bars_calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return bars_from_trades(read_table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), day, calm_price(day, F.col("l_extendedprice")), F.col("l_quantity"), LINE_KEY)


def bars_wild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_trades(read_table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), F.to_date("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), LINE_KEY)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))


# --- lake -----------------------------------------------------------------------------------------------------------


def read_bars(spark: SparkSession, root: str, symbols: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(BARS_RAW).parquet(root)
    return df if symbols is None else df.filter(F.col("symbol").isin(symbols))


def write_bars(df: DataFrame, root: str) -> None:
    df.write.partitionBy("symbol").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def write_features(df: DataFrame, root: str, version: str) -> None:
    out = df.withColumn("feature_version", F.lit(version))
    out.write.partitionBy("feature_version", "symbol").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def read_panel(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(root).filter(F.col("feature_version") == version).drop("feature_version")


def latest(df: DataFrame, keys: list[str], newest: list) -> DataFrame:
    """One row for each key, the first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")


def upsert_bars(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Both tables with one row for each key; a key in both has the new row."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return latest(both, list(keys), [F.desc("_batch")]).drop("_batch")


def upsert_candles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candles by start; the newest fetch wins, history stays."""
    return latest(old.unionByName(new), ["symbol", "interval", "timestamp"], [F.desc("fetched_at")])


def incremental_filter(new: DataFrame, stored: DataFrame, overlap_days: int = 7) -> DataFrame:
    """Rows of new from ``overlap_days`` before the symbol's last stored date on; all rows of new symbols."""
    marks = stored.groupBy("symbol").agg(F.max("date").alias("_last"))
    joined = new.join(marks, "symbol", "left")
    return joined.filter(F.col("_last").isNull() | (F.col("date") >= F.date_sub("_last", overlap_days))).drop("_last")


def normalise_bars(raw: DataFrame, symbol_col: str = "symbol", seq_col: str = "seq") -> DataFrame:
    """Provider rows as raw bars: days without time, null volume and dividend 0, split 0 or null 1, no rows without close, one row a day (the last)."""
    df = raw.select(
        F.to_date("date").alias("date"),
        F.col(symbol_col).alias("symbol"),
        *[F.col(c).cast("double").alias(f"{c}_split") for c in ("open", "high", "low", "close")],
        F.coalesce(F.col("volume").cast("long"), F.lit(0)).alias("volume"),
        F.coalesce(F.col("dividend").cast("double"), F.lit(0.0)).alias("dividend"),
        F.when(F.coalesce("split_ratio", F.lit(0.0)) == 0, 1.0).otherwise(F.col("split_ratio")).alias("split_ratio"),
        F.col(seq_col).alias("_seq"),
    )
    return latest(df.filter(F.col("close_split").isNotNull() & ~F.isnan("close_split")), ["symbol", "date"], [F.desc("_seq")]).drop("_seq")


def read_equity_csv(spark: SparkSession, path: str, schema: str = EQUITY) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_signals(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORECASTS).json(path)


def append_forecasts(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "forecast_session")) -> DataFrame:
    """Rows of new to append: those whose key is not there yet, the first made of each key."""
    return latest(new.join(existing, list(keys), "left_anti"), list(keys), [F.asc("created_at")])


def valid_prices(df: DataFrame, column: str) -> DataFrame:
    """Rows whose price is a finite number above 0."""
    x = F.col(column)
    return df.filter(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf")))


def slice_day(panel: DataFrame, as_of) -> DataFrame:
    return panel.filter(F.col("date") == F.lit(as_of))


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a session whose only process is the driver, else the warehouse, which executors share."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    master = spark.sparkContext.master
    alone = master.startswith("local") and not master.startswith("local-cluster")
    told = "file://" + tempfile.mkdtemp(prefix="spark-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    spark.conf.set("spark.checkpoint.dir", told)
    return told


def settled(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint in the :func:`work_folder`."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_folder(spark))
    return df.checkpoint()
