import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import blocks
from panelspark.functions.kernels import ewm, expanding_percentile


def ticks(n, seed=0, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=n)).round(1)
    x[rng.random(n) < gaps] = np.nan
    return x


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_blocks_equal_the_whole(spark, ranges):
    groups = {"a": ticks(900), "b": ticks(5, 1), "c": np.array([np.nan, np.nan]), "d": ticks(300, 2, 0.9)}
    rows = [(g, i, None if np.isnan(v) else float(v), "kept") for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i long, x double, other string").repartition(5)
    for alpha, least in ((0.5, 1), (2 / 27, 26)):
        got = blocks.exponential_mean(df, ["g"], "i", "x", alpha, least, ranges=ranges).toPandas()
        assert len(got) == len(rows) and set(got["other"]) == {"kept"}
        for g, x in groups.items():
            own = got[got["g"] == g].sort_values("i")["ewm"].to_numpy(dtype=float)
            want = np.where(np.cumsum(~np.isnan(x)) >= least, ewm(x, alpha, least), np.nan)
            assert np.allclose(own, want, rtol=1e-12, atol=1e-12, equal_nan=True)
    got = blocks.percentile_so_far(df, ["g"], "i", "x", 20, ranges=ranges).toPandas()
    assert len(got) == len(rows)
    for g, x in groups.items():
        own = got[got["g"] == g].sort_values("i")["percentile"].to_numpy(dtype=float)
        assert np.allclose(own, expanding_percentile(x, 20), rtol=0, atol=1e-12, equal_nan=True)


def test_one_symbols_two_million_ticks_over_many_tasks(spark):
    n = 2_000_000
    df = spark.range(n, numPartitions=16).select(F.lit("one").alias("g"), F.col("id").alias("i"), F.sin(F.col("id") * 0.37).alias("x"))
    got = blocks.exponential_mean(df, ["g"], "i", "x", 0.01, 10)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    want = pd.Series(np.sin(np.arange(n) * 0.37)).ewm(alpha=0.01, adjust=False).mean()
    some = got.filter("i % 1000 = 17").toPandas().sort_values("i")
    assert np.abs(some["ewm"].to_numpy() - want.to_numpy()[some["i"]]).max() < 1e-12 and got.filter("ewm is null").count() == 9


def test_empty(spark):
    df = spark.createDataFrame([], "g string, i long, x double")
    assert blocks.exponential_mean(df, ["g"], "i", "x", 0.5).collect() == [] and blocks.percentile_so_far(df, ["g"], "i", "x").collect() == []
