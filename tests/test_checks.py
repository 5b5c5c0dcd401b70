"""Causality, ensembles and small guards on hand-made rows."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.functions.windows import by_symbol
from panelspark.operators import ensemble, features, portfolio
from panelspark.sources import tables

START = date(2020, 1, 1)


def bars(spark, n: int = 60):
    rows = [(START + timedelta(days=i), s, 10.0 + i % 7 + k, 12.0 + i % 7 + k, 9.0 + i % 7 + k, 11.0 + i % 7 + k, 100 + i, 11.0 + i % 7 + k) for k, s in enumerate("AB") for i in range(n)]
    return spark.createDataFrame(rows, "date date, symbol string, open_split double, high_split double, low_split double, close_split double, volume bigint, adj_close double")


def test_later_bars_move_only_what_looks_ahead(spark):
    def build(df):
        w = by_symbol()
        return df.select("symbol", "date", (F.col("adj_close") / F.lag("adj_close", 1).over(w) - 1).alias("back"), F.lead("adj_close", 1).over(w).alias("ahead"))

    found = features.causality_violations(bars(spark), build, ["back", "ahead"], START + timedelta(days=40)).collect()
    assert [(r["feature"], r["n"]) for r in found] == [("ahead", 2)]


def test_real_features_are_causal(spark):
    names = ["return_5d", "volatility_20", "relative_volume_20", "drawdown_from_peak"]
    assert features.causality_violations(bars(spark), features.window_features, names, START + timedelta(days=50)).count() == 0


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), 0.0, -1.0])
def test_prices_must_be_finite_and_positive(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "price double")
    assert [r["price"] for r in tables.valid_prices(df, "price").collect()] == [1.0]


def test_costs_by_component(spark):
    daily = spark.createDataFrame([(1.0, 2.0, 3.0), (0.5, 0.5, 0.5)], "commission double, spread double, slippage double")
    assert {r["component"]: r["total"] for r in portfolio.cost_totals(daily).collect()} == {"commission": 1.5, "spread": 2.5, "slippage": 3.5}


def test_version_depends_on_the_specification_only():
    a = ensemble.model_version("stack", {"c": 1.0, "columns": ["x"]}, START)
    assert a == ensemble.model_version("stack", {"columns": ["x"], "c": 1.0}, START)
    assert a != ensemble.model_version("stack", {"columns": ["x"], "c": 2.0}, START)
    assert a.startswith("stack-") and a.endswith("-2020-01-01") and len(a.split("-")[1]) == 12


def test_stack_follows_the_informative_base(spark):
    rows = []
    for i in range(120):
        y = float(i * 7 % 11 < 5)
        noise = (i * 37 % 101) / 101
        rows.append((START + timedelta(days=i), "A", 0, "train" if i < 80 else "val", y, 0.3 + 0.4 * y + 0.3 * (noise - 0.5), noise))
    meta = spark.createDataFrame(rows, "date date, symbol string, fold int, role string, y_true double, good double, noise double")
    stacked, weights = ensemble.fit_stack(meta, ["good", "noise"])
    assert stacked.count() == 40
    top = weights.first()
    assert top["feature"] == "good" and top["mean"] > 0 and top["std"] == 0.0
    base = meta.filter("role = 'val'").select("y_true", F.col("noise").alias("y_pred"))
    table = {r["model"]: r for r in ensemble.compare_with_bases(stacked, {"noise": base}).collect()}
    assert table["stack"]["beats_best_base"] is True and table["noise"]["beats_best_base"] is None


def test_a_stack_needs_labels(spark):
    empty = spark.createDataFrame([], "date date, symbol string, fold int, role string, y_true double, good double")
    with pytest.raises(ValueError):
        ensemble.fit_stack(empty, ["good"])
