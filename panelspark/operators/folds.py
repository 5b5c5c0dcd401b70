"""Purged walk-forward folds over session numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.calendar import session_index

FOLDS = "fold int, train_start int, train_end int, purge_end int, val_start int, val_end int, embargo_end int"


def fold_bounds(spark: SparkSession, n_sessions: int, n_folds: int = 5, test: int = 126, purge: int = 2, embargo: int = 3, min_train: int = 252, rolling: int | None = None, horizon: int = 1) -> DataFrame:
    """One row a fold: half-open ranges of session numbers. Validation blocks stand end to end and finish at the last session."""
    if purge < horizon + 1:
        raise ValueError("the purge must cover the label: horizon + 1 sessions at least")
    rows = []
    for k in range(n_folds):
        start = n_sessions - (n_folds - k) * test
        end = start - purge
        if start < 0 or end < min_train:
            continue
        rows.append((len(rows), max(0, end - rolling) if rolling else 0, end, start, start, start + test, min(n_sessions, start + test + embargo)))
    if not rows:
        raise ValueError("too few sessions for one fold")
    return spark.createDataFrame(rows, FOLDS)


def assign_folds(panel: DataFrame, folds: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Rows of the panel for each fold they take part in, with fold and role train, purged, val or embargoed.

    folds has a handful of rows and is broadcast; sessions are joined by date.
    """
    index = session_index(panel) if index is None else index
    i = F.col("session_idx")
    role = F.when((i >= F.col("train_start")) & (i < F.col("train_end")), "train").when((i >= F.col("train_end")) & (i < F.col("purge_end")), "purged").when((i >= F.col("val_start")) & (i < F.col("val_end")), "val").when((i >= F.col("val_end")) & (i < F.col("embargo_end")), "embargoed")
    near = (i >= F.col("train_start")) & (i < F.col("embargo_end"))
    return panel.join(index, "date").join(F.broadcast(folds), near).withColumn("role", role).drop("train_start", "train_end", "purge_end", "val_start", "val_end", "embargo_end")


def fold_summary(assigned: DataFrame) -> DataFrame:
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    day = lambda f, r: f(F.when(F.col("role") == r, F.col("date")))
    return assigned.groupBy("fold").agg(day(F.min, "train").alias("train_first"), day(F.max, "train").alias("train_last"), day(F.min, "val").alias("val_first"), day(F.max, "val").alias("val_last"), *[n(r).alias(f"n_{r}") for r in ("train", "val", "purged", "embargoed")])


def unclean_folds(assigned: DataFrame, purge: int = 2) -> DataFrame:
    """Folds with an empty side, an overlap or a gap shorter than the purge; empty where all is well."""
    i = lambda f, r: f(F.when(F.col("role") == r, F.col("session_idx")))
    per = assigned.groupBy("fold").agg(i(F.max, "train").alias("last_train"), i(F.min, "val").alias("first_val"))
    return per.filter(F.col("last_train").isNull() | F.col("first_val").isNull() | (F.col("first_val") - F.col("last_train") <= purge))


def date_blocks(df: DataFrame, k: int) -> DataFrame:
    """(date, block): distinct dates in k contiguous blocks of near-equal length, the first ones longer."""
    return df.select("date").distinct().withColumn("block", F.ntile(k).over(Window.orderBy("date")) - 1)


def split_development(panel: DataFrame, boundary, lag: int = 2) -> DataFrame:
    """Rows dated before the session that lies ``lag`` before the first session on or after the boundary."""
    index = session_index(panel)
    at = index.agg(F.coalesce(F.min(F.when(F.col("date") >= F.lit(boundary), F.col("session_idx"))), F.count(F.lit(1))).alias("pos"))
    cut = index.join(F.broadcast(at), F.col("session_idx") == F.greatest(F.col("pos") - lag, F.lit(0))).select(F.col("date").alias("_cut"))
    return panel.join(F.broadcast(cut), F.col("date") < F.col("_cut")).drop("_cut")


def locked_rows(df: DataFrame, boundary) -> DataFrame:
    return df.filter(F.col("date") >= F.lit(boundary))


def assert_no_locked_rows(df: DataFrame, boundary) -> None:
    if locked_rows(df, boundary).take(1):
        raise ValueError("rows on or after the boundary")


def repeated_keys(df: DataFrame, keys: tuple[str, ...] = ("date", "symbol")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def recent_folds(df: DataFrame, n_folds: int = 5, size: int = 60) -> DataFrame:
    """df plus fold_from_end for the last n_folds * size rows of each symbol, 0 the newest; others null."""
    no = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))) - 1
    return df.withColumn("fold_from_end", F.when(no < n_folds * size, F.floor(no / size).cast("int")))
