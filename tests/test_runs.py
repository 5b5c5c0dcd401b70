"""Leaderboards over runs whose mean lies on half a unit, from rows in any order."""

from __future__ import annotations

import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from panelspark.plans import panel

#: Three customers of the given orders: forwards and backwards their sums differ in the last bit, and their mean ends on .5.
PRICES = {
    813: [31094.1, 336408.42, 156542.42, 275805.06],
    14742: [195729.32, 340358.29, 319256.99, 388455.17, 488673.94, 125894.18, 382109.39, 328998.72],
    7020: [371816.64, 299442.8, 2246.87, 132049.05, 79573.2, 435484.93, 54529.85, 486473.17, 257579.51, 200908.98],
}


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    """The same orders by key, backwards, and dealt over files."""
    rows = [(100 * k + i, k, x, datetime(1995, 1, 1 + i)) for k, xs in PRICES.items() for i, x in enumerate(xs)]
    # Runs of the same task one unit below and above, so that ranks hang on the unit.
    for k, xs in PRICES.items():
        near = round(sum(xs) / len(xs))
        rows += [(100 * (k + 7 * j), k + 7 * j, float(near + j - 2), datetime(1996, 1, j)) for j in (1, 2, 3)]
    df = spark.createDataFrame(sorted(rows), "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp")
    root = tmp_path_factory.mktemp("runs")
    for name, part in (("forwards", df.coalesce(1)), ("backwards", df.coalesce(1).sortWithinPartitions(F.desc("o_orderkey"))), ("dealt", df.repartition(5, F.col("o_orderkey") % 5))):
        part.write.parquet(f"{root}/{name}/orders.parquet")
    return root


def same_as_sql(spark, places, query):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    at = f"{places}/forwards/orders.parquet"
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet({[f'{at}/{f}' for f in os.listdir(at) if f.endswith('.parquet')]})")
    for name in ("forwards", "backwards", "dealt"):
        df = e.queries()[query](spark, f"{places}/{name}")
        want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()[query]})").fetchall())
        assert sorted(map(tuple, df.collect())) == want, name
        assert len(want) == 12


def test_distinguishable_runs_follow_the_keys_not_the_partitions(spark, places):
    same_as_sql(spark, places, "n10_distinguishable_runs")


def test_runs_count_missing_prices_as_the_sql_does(spark, tmp_path):
    at = f"{tmp_path}/orders.parquet"
    rows = [(1, 5, None, datetime(1995, 1, 1)), (2, 5, 3e6, datetime(1995, 1, 2)), (3, 5, None, datetime(1995, 1, 3)), (4, 6, None, datetime(1995, 1, 4)), (5, None, 2e6, datetime(1995, 1, 5)), (5, None, 1e6, datetime(1995, 1, 5))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(at)
    got = {r["experiment_id"]: r["primary_value"] for r in panel.runs(spark, str(tmp_path)).collect()}
    assert got == {5: 3.0, 6: None, None: 1.5}


def test_leaderboard_follows_the_keys_not_the_partitions(spark, places):
    same_as_sql(spark, places, "n9_leaderboard")


#: Means that end on half a unit; divided by 1e6 and multiplied by it again, they are less.
SIDES = {1: [64381.5], 2: [122742.28, 469588.46, 180710.76], 3: [3993.5], 4: [-64381.5]}


@pytest.mark.parametrize("query", ["n9_leaderboard", "n10_distinguishable_runs", "n9_task_summary", "i10_latest_runs"])
def test_runs_round_as_the_sql_does(spark, tmp_path, query):
    """A run and its neighbours by a unit are of one task, so ranks show which way it went."""
    rows = [(100 * k + i, k, x, datetime(1995, 1, 1 + i)) for k, xs in SIDES.items() for i, x in enumerate(xs)]
    rows += [(100 * k + 70 * j, k + 7 * j, float(int(sum(xs) / len(xs)) + j - 1), datetime(1996, 1, j)) for k, xs in SIDES.items() for j in (1, 2)]
    at = f"{tmp_path}/orders.parquet"
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(at)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{at}/*.parquet')")
    df = e.queries()[query](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()[query]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert len(want) == (4 if query == "n9_task_summary" else 12)


def test_rounding_follows_the_sql(spark, tmp_path):
    values = [0.0643815, -0.0643815, 0.2577405, 0.0039935, 1.5e-6, 2.5e-6, 1e11 + 0.1, 1e303, 0.0, None, float("nan"), float("inf"), float("-inf")]
    at = f"{tmp_path}/values.parquet"
    df = spark.createDataFrame([(i, x, 10**16 + 1) for i, x in enumerate(values)], "i int, x double, n long").coalesce(1)
    df.write.parquet(at)
    got = panel.rounded(df, ["x", "n"], ("i",)).orderBy("i").collect()
    want = duckdb.connect().execute(f"SELECT i, round(x, 6) + 0.0 FROM read_parquet('{at}/*.parquet') ORDER BY i").fetchall()
    assert [repr((r["i"], r["x"])) for r in got] == [repr(w) for w in want]
    assert {r["n"] for r in got} == {1e16}
