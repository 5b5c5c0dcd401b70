"""Ridge out of fold by sums for all folds, and the jobs that a nested selection takes."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import calendar, folds, metrics, models
from panelspark.sources import tables

COLUMNS = ["f1", "f2", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for i in range(420):
        for s in "AB":
            a, b = rng.normal(size=2)
            out.append((date(2019, 1, 1) + timedelta(days=i), s, float(a), None if rng.random() < 0.2 else float(1000 + b), 3.0, None if i % 50 == 7 else float(0.01 * a + 0.005 * rng.normal())))
    return tables.settled(spark.createDataFrame(out, "date date, symbol string, f1 double, f2 double, flat double, r double"))


@pytest.fixture(scope="module")
def assigned(spark, rows):
    index = calendar.session_index(rows)
    return tables.settled(folds.assign_folds(rows, folds.fold_bounds(spark, index.count(), 2, 60, min_train=100), index))


@pytest.mark.parametrize("one_sort", [1 << 17, 0])
def test_ridge_of_all_folds_equals_single_fits(assigned, monkeypatch, one_sort):
    monkeypatch.setattr(models, "ONE_SORT", one_sort)
    got = {(r["date"], r["symbol"], r["fold"]): r["y_pred"] for r in models.generate_oof(assigned, models.fit_ridge(5.0), COLUMNS, "r").collect()}
    known = assigned.filter("r is not null")
    assert len(got) == known.filter("role = 'val'").count() > 200
    for fold in (0, 1):
        own = known.filter(F.col("fold") == fold)
        model = models.fit_ridge(5.0)(own.filter("role = 'train'"), COLUMNS, "r")
        want = models.predict(model, own.filter("role = 'val'")).collect()
        assert max(abs(r["y_pred"] - got[r["date"], r["symbol"], fold]) for r in want) < 1e-12
        # And both equal the closed form on the rows themselves.
        pdf = own.toPandas()
        train, val = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "val"]
        x, z = (p[COLUMNS].fillna(train[COLUMNS].median()).to_numpy() for p in (train, val))
        m, s = x.mean(axis=0), x.std(axis=0)
        s[s == 0] = 1
        a, y = (x - m) / s, train["r"].to_numpy()
        w = np.linalg.solve(a.T @ a + 5.0 * np.eye(3), a.T @ (y - y.mean()))
        have = np.array([got[d, k, fold] for d, k in zip(val["date"], val["symbol"], strict=True)])
        assert np.abs((z - m) / s @ w + y.mean() - have).max() < 1e-12


def test_a_fold_without_training_rows_is_refused(assigned):
    with pytest.raises(ValueError, match=r"\[1\]"):
        models.generate_oof(assigned.filter("fold = 0 or role = 'val'"), models.fit_ridge(), COLUMNS, "r")


def test_absolute_error_is_that_of_the_regression_metrics(assigned):
    df = assigned.select("fold", F.col("r").alias("y"), F.col("f1").alias("p"))
    want = {(r["fold"], r["n"]): r["mae"] for r in metrics.regression_metrics(df, "y", "p", ["fold"]).collect()}
    got = {(r["fold"], r["n"]): r["mae"] for r in metrics.absolute_error(df, "y", "p", ["fold"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_nested_selection_takes_few_jobs_and_chooses_as_fold_by_fold(spark, rows):
    error = lambda o: metrics.regression_metrics(o, "y_true", "y_pred", ["fold"]).select("fold", F.col("mae").alias("value"))
    light = lambda o: metrics.absolute_error(o, "y_true", "y_pred", ["fold"]).select("fold", F.col("mae").alias("value"))
    grid = {"1": models.fit_ridge(1.0), "1e6": models.fit_ridge(1e6)}
    last = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = last()
    got = models.nested_walk_forward(rows, grid, COLUMNS, "r", light, 2, 60, 200, 2, maximise=False)
    assert last() - before < 100
    # Fold by fold: the inner folds of each outer one, scored on their own.
    known = rows.filter("r is not null")
    index = calendar.session_index(known)
    outer = tables.settled(folds.assign_folds(known, folds.fold_bounds(spark, index.count(), 2, 60, min_train=200), index))
    for fold in (0, 1):
        train = outer.filter((F.col("fold") == fold) & (F.col("role") == "train")).select(*known.columns)
        own = calendar.session_index(train)
        inner = tables.settled(folds.assign_folds(train, folds.fold_bounds(spark, own.count(), 2, 30, min_train=126), own))
        means = {n: error(models.generate_oof(inner, f, COLUMNS, "r")).agg(F.avg("value")).first()[0] for n, f in grid.items()}
        assert {r["selected"] for r in got.filter(F.col("fold") == fold).select("selected").distinct().collect()} == {min(means, key=means.get)} == {"1"}
    assert got.count() == outer.filter("role = 'val'").count()
