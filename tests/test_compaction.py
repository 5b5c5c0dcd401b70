from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.streaming import candles

SCHEMA = "event_id long, symbol string, ts timestamp, price double"


def test_compaction_reads_and_writes_touched_days_only_and_survives_a_crash(spark, tmp_path, monkeypatch):
    start = datetime(2024, 1, 1, 9, 15)
    rows = [(i, "AB"[i % 2], start + timedelta(minutes=11 * i), 100.0 + i % 17) for i in range(700)]  # some five days
    ticks = spark.createDataFrame(rows, SCHEMA)
    table = f"{tmp_path}/t"
    run = lambda: candles.keep_upserting(candles.candles(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"), "15m", "1 hour"), table, f"{tmp_path}/c").awaitTermination(120)

    def agrees(upto):
        want = candles.candles(ticks.filter(F.col("event_id") < upto), "15m")
        got = candles.read_upserted(spark, table).select(*want.columns)
        return got.count() == want.count() and want.exceptAll(got).count() == 0

    ticks.filter("event_id < 400").write.parquet(f"{tmp_path}/in")
    run()
    assert candles.compact(spark, table) == 1 and candles.compact(spark, table) == 1 and agrees(400)
    ticks.filter("event_id >= 400 and event_id < 500").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert agrees(500)
    # Broken off after the data are written and before the manifest is.
    monkeypatch.setattr(candles, "_put", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        candles.compact(spark, table)
    assert agrees(500) and candles._manifest(spark, table)["version"] == 1
    monkeypatch.undo()
    assert candles.compact(spark, table) == 2 and agrees(500)
    told = candles._manifest(spark, table)
    assert set(told["days"].values()) == {1, 2} and told["days"]["2024-01-01"] == 1 and not candles._fresh(spark, table, told)
    # A reader of one day opens that day's folder only; batches that come later are seen beside the snapshot.
    day = candles.read_upserted(spark, table, F.col("day") == "2024-01-02")
    assert {f.rsplit("day=", 1)[1].split("/")[0] for f in day.inputFiles()} >= {"2024-01-02"} and "2024-01-01" not in {str(r[0]) for r in day.select(F.to_date("timestamp")).distinct().collect()}
    ticks.filter("event_id >= 500").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert agrees(700)
    with pytest.raises(RuntimeError):
        candles._put(spark, f"{table}/_snapshots/manifest-000000002.json", "{}")
