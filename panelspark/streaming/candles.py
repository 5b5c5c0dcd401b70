"""Candles of ticks; the same aggregation runs on batches and on streams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.tables import latest

INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour"}
OPEN, CLOSE = 9 * 60 + 15, 15 * 60 + 30


def candles(ticks: DataFrame, interval: str = "5m", watermark: str | None = None) -> DataFrame:
    """(timestamp, symbol, interval, open, high, low, close, volume) of ticks (ts, symbol, price, event_id).

    On a stream pass a watermark: in append mode a candle leaves only once it
    is complete, and ticks that come later are dropped.
    """
    df = ticks.withWatermark("ts", watermark) if watermark else ticks
    at = F.struct("ts", "event_id")
    out = df.groupBy("symbol", F.window("ts", INTERVALS[interval]).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select(F.col("w.start").alias("timestamp"), "symbol", F.lit(interval).alias("interval"), "open", "high", "low", "close", "volume")


def completed(df: DataFrame, minutes: int, now) -> DataFrame:
    """Candles with sound prices inside the session of a weekday that have ended by now; volume 0 or less becomes null.

    Timestamps are read in the session's time zone.
    """
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    sound = (F.least(o, h, lo, c) > 0) & ~(F.isnan(o) | F.isnan(h) | F.isnan(lo) | F.isnan(c)) & (h < float("inf")) & (h >= F.greatest(o, c, lo)) & (lo <= F.least(o, c, h))
    minute = F.hour("timestamp") * 60 + F.minute("timestamp")
    end = F.least(F.expr(f"timestamp + interval {minutes} minutes"), F.expr(f"date_trunc('DAY', timestamp) + interval {CLOSE} minutes"))
    inside = (minute >= OPEN) & (minute < CLOSE) & ~F.dayofweek("timestamp").isin(1, 7)
    return df.filter(sound & inside & (end <= F.lit(now).cast("timestamp"))).withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")))


def candle_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", F.to_date("timestamp").alias("date")).agg(F.max_by("close", "timestamp").alias("last_close"), F.min("close").alias("low_close"), F.max("close").alias("high_close"))


def keep_upserting(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Starts a query that adds each batch of candles to the table at path; :func:`read_upserted` reads it.

    A batch writes its own folder, named by the checkpoint's query and the
    batch's number, and reads nothing: so a batch that is replayed replaces
    what it wrote before and nothing else, the disk follows the rows that
    arrive, and a query with a new checkpoint adds to what others wrote.
    """

    def add(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id").alias("id")).first()["id"]
        out = batch.withColumn("fetched_at", F.current_timestamp()).withColumn("day", F.to_date("timestamp"))
        out.write.mode("overwrite").partitionBy("day").parquet(f"{path}/query={query}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str, days: Column | None = None) -> DataFrame:
    """Candles at path, the newest fetch of each; ``days`` is a condition on the column day, which prunes folders.

    After :func:`compact` this reads the newest snapshot and the batches that
    came later, as they were when the reader began.
    """
    told = _manifest(spark, path)
    parts = [_snapshot(spark, path, told, list(told["days"]))] if told["days"] else []
    parts += [_batches(spark, path, fresh)] if (fresh := _fresh(spark, path, told)) else []
    if not parts:
        return _newest(spark.read.parquet(path)).drop("query", "batch", "day")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _newest(rows if days is None else rows.filter(days)).drop("query", "batch", "day")


def _newest(rows: DataFrame) -> DataFrame:
    return latest(rows, ["symbol", "interval", "timestamp"], [F.desc("fetched_at"), F.desc("batch"), F.desc("query")])


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or [])


def _manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: its version, the folder of each day, and the last batch of each query that the snapshot holds."""
    found = _glob(spark, f"{path}/_snapshots/manifest-*.json")
    return json.loads(spark.read.text(found[-1], wholetext=True).first()[0]) if found else {"version": 0, "days": {}, "up_to": {}}


def _fresh(spark: SparkSession, path: str, told: dict) -> list[str]:
    """Folders of whole batches (they end with a success file) that the snapshot doesn't hold."""
    done = [p.rsplit("/", 1)[0] for p in _glob(spark, f"{path}/query=*/batch=*/_SUCCESS")]
    place = lambda p: (p.split("query=")[1].split("/")[0], int(p.rsplit("batch=", 1)[1]))
    return [p for p in done if (q := place(p))[1] > told["up_to"].get(q[0], -1)]


def _batches(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*folders)


def _snapshot(spark: SparkSession, path: str, told: dict, days: list[str]) -> DataFrame:
    data = f"{path}/_snapshots/data"
    return spark.read.option("basePath", data).parquet(*[f"{data}/version={told['days'][d]}/day={d}" for d in days]).drop("version")


def compact(spark: SparkSession, path: str) -> int:
    """Merges batches that came since the last snapshot into it, and gives the snapshot's version.

    Only days that these batches touch are read and written again; the folders
    of other days stay as they are. The manifest is put in place last, in one
    step: before that readers see the snapshot before and all batches, so a
    run that is broken off loses nothing and may be repeated. One run at a time.
    """
    told = _manifest(spark, path)
    fresh = _fresh(spark, path, told)
    if not fresh:
        return told["version"]
    touched = sorted({p.rsplit("day=", 1)[1] for f in fresh for p in _glob(spark, f"{f}/day=*")})
    rows = _batches(spark, path, fresh)
    known = [d for d in touched if d in told["days"]]
    rows = rows.unionByName(_snapshot(spark, path, told, known)) if known else rows
    version = told["version"] + 1
    _newest(rows).write.mode("overwrite").partitionBy("day").parquet(f"{path}/_snapshots/data/version={version}")
    up_to = dict(told["up_to"])
    for f in fresh:
        query, batch = f.split("query=")[1].split("/")[0], int(f.rsplit("batch=", 1)[1])
        up_to[query] = max(batch, up_to.get(query, -1))
    _put(spark, f"{path}/_snapshots/manifest-{version:09d}.json", json.dumps({"version": version, "days": told["days"] | dict.fromkeys(touched, version), "up_to": up_to}))
    return version


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all; one that is there already is an error."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    final, draft = path_of(path), path_of(f"{path}.draft")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{path} is there already: another run has compacted")
