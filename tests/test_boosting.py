"""Histogram boosting against a plain version that tries every cut of every node."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting
from panelspark.operators.boosting import MISSING, Settings


def plain(x, y, cuts, base, s):
    """Predictions and (feature, cut, missing left, rows) of each split, node by node and cut by cut."""
    score, splits = np.full(len(y), base), []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y, p * (1 - p)) if s.direction else (score - y, np.ones(len(y)))
        worth = lambda own, g=g, h=h: g[own].sum() ** 2 / (h[own].sum() + s.l2)

        def best(own, worth=worth):
            found = None
            for j in range(x.shape[1]):
                lost = np.isnan(x[own, j])
                for side in (False, True)[: 1 + bool(lost.any())]:
                    for c in [*cuts[j], *[np.inf] * int(lost.any() and not side)]:  # the last parts missing values from all others
                        left = np.where(lost, side, x[own, j] <= c)
                        a, b = own[left], own[~left]
                        if min(len(a), len(b)) < s.least:
                            continue
                        gain = worth(a) + worth(b) - worth(own)
                        if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                            found = (gain, j, c, side if lost.any() else len(a) > len(b), a, b)
            return found

        open_, done = [(best(np.arange(len(y))), np.arange(len(y)), 0)], []
        while len(open_) + len(done) < s.leaves:
            some = [(n[0][0], k) for k, n in enumerate(open_) if n[0] is not None and n[2] < s.depth]
            if not some:
                break
            found, own, depth = open_.pop(max(some, key=lambda t: (t[0], -t[1]))[1])
            splits.append((found[1], found[2], found[3], len(own)))
            open_ += [(best(part), part, depth + 1) for part in found[4:]]
        new = score.copy()
        for _, own, _ in open_ + done:
            new[own] += -s.rate * g[own].sum() / (h[own].sum() + s.l2)
        score = new
    return (1 / (1 + np.exp(-score)) if s.direction else score), splits


def rows(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    x[rng.random((n, 3)) < 0.15] = np.nan
    z = np.nan_to_num(x[:, 0]) - 2.0 * np.isnan(x[:, 1]) + np.nan_to_num(x[:, 2]) ** 2
    y = (z + rng.normal(size=n) > 0.3).astype(float)
    data = [(*[None if np.isnan(v) else float(v) for v in r], float(c), float(t)) for r, c, t in zip(x, y, z, strict=True)]
    return x, y, z, spark.createDataFrame(data, "a double, b double, c double, y double, z double").repartition(5)


def shape(model):
    cut = lambda f, b: model.cuts[f][b] if b < len(model.cuts[f]) else np.inf
    return [(t.feature[k], cut(t.feature[k], t.bin[k]), t.missing_left[k]) for t in model.trees for k in range(len(t.feature)) if t.feature[k] >= 0]


@pytest.mark.parametrize("s", [Settings(6, 3, 15, 0.3, 20), Settings(4, 6, 5, 0.3, 10), Settings(4, 3, 15, 0.3, 20, 5.0, False)])
def test_splits_and_values_equal_a_plain_version(spark, s):
    x, y, z, df = rows(spark)
    label, target = ("y", y) if s.direction else ("z", z)
    model = boosting.fit(df, ["a", "b", "c"], label, s)
    want, splits = plain(x, target, model.cuts, model.base, s)
    assert np.abs(model.scores(x) - want).max() < 1e-9
    # Where two cuts part a node's rows alike, either may be named; the rows of every split and its feature are the same.
    codes = boosting.encode(x, model.cuts)
    sizes = []
    for t in model.trees:
        n = np.bincount(t.leaves(codes), minlength=len(t.feature))
        for k in range(len(t.feature) - 1, -1, -1):
            if t.feature[k] >= 0:
                n[k] = n[t.left[k]] + n[t.right[k]]
                sizes.append((t.feature[k], int(n[k])))
    assert sorted(sizes) == sorted((r[0], r[3]) for r in splits)
    assert any(r[2] for r in splits) and any(not r[2] for r in splits)


def test_blocks_over_many_tasks_give_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "RENEW", 2)
    x, _, _, df = rows(spark)
    s = Settings(5, 3, 15, 0.3, 20)
    one, many = boosting.fit(df, ["a", "b", "c"], "y", s), boosting.fit(df, ["a", "b", "c"], "y", s, one_task=0)
    assert shape(one) == shape(many) and np.abs(one.scores(x) - many.scores(x)).max() < 1e-12


def test_predictions_in_spark_and_after_loading(spark, tmp_path):
    x, _, _, df = rows(spark)
    model = boosting.fit(df, ["a", "b", "c"], "y", Settings(5, 3, 15, 0.3, 20))
    model.save(f"{tmp_path}/m", spark)
    again = boosting.Boosted.load(f"{tmp_path}/m", spark)
    assert again == model
    odd = df.withColumn("a", F.when(F.col("a").isNull(), float("inf")).otherwise(F.col("a")))
    for frame in (df, odd):
        got = again.transform(frame).toPandas()
        assert np.abs(got["prediction"] - model.scores(got[["a", "b", "c"]].replace(np.inf, np.nan).to_numpy(dtype=float))).max() < 1e-15


def test_edges(spark):
    empty = boosting.fit(spark.createDataFrame([], "a double, y double"), ["a"], "y", Settings(3))
    assert empty.trees == [] and empty.scores(np.array([[1.0]]))[0] == 0.5
    same = boosting.fit(spark.createDataFrame([(None, 1.0)] * 10, "a double, y double"), ["a"], "y", Settings(3, least=1))
    assert shape(same) == [] and same.scores(np.array([[1.0]]))[0] > 0.99
    assert boosting.encode(np.array([[np.nan], [1.0], [2.0], [3.0]]), [[1.0, 2.0]]).ravel().tolist() == [MISSING, 0, 1, 2]


def test_a_saved_bundle_scores_a_panel_without_labels(spark, tmp_path):
    from datetime import date, timedelta

    from panelspark.operators import ensemble, models
    from panelspark.plans import checks

    rng = np.random.default_rng(8)
    data = [(date(2019, 1, 1) + timedelta(days=i), s, *(x := rng.normal(size=2)).tolist(), float(i % 7), float(x[0] + 0.5 * rng.normal() > 0), float(0.01 * x[0])) for i in range(500) for s in "AB"]
    df = spark.createDataFrame(data, "date date, symbol string, f1 double, f2 double, day double, y double, r double")
    def assign(rows):
        from panelspark.operators import calendar, folds

        index = calendar.session_index(rows)
        return folds.assign_folds(rows, folds.fold_bounds(spark, index.count(), 3, 60, min_train=60), index)

    fits = {"boosted": models.fit_boosted_direction(10, rate=0.3, least=20), "logistic": models.fit_logistic()}
    bundle = ensemble.fit_production_ensemble(assign(df), assign, fits, models.fit_ridge(), ["f1", "f2"], "y", "r", ("day",))
    at = bundle.save(str(tmp_path), spark)
    assert at.endswith(bundle.version) and "2020-05-14" in bundle.version
    fresh = df.limit(50).drop("y", "r")
    rows_of = lambda b: sorted(tuple(r) for r in b.score(fresh).collect())
    first = rows_of(bundle)
    assert first == rows_of(ensemble.ProductionEnsemble.load(at, spark)) and len(first) == 50
    got = bundle.score(fresh)
    assert got.columns == ["date", "symbol", "boosted", "logistic", "raw", "calibrated", "expected_return", "model_version"]
    # The expected return is that of the ridge of all rows, the raw score that of the stack over base scores and context.
    up = {(r["date"], r["symbol"]): r["f1"] for r in fresh.collect()}
    both = [(up[r["date"], r["symbol"]], r["expected_return"], r["raw"]) for r in got.collect()]
    assert np.corrcoef([b[0] for b in both], [b[1] for b in both])[0, 1] > 0.99 and np.corrcoef([b[0] for b in both], [b[2] for b in both])[0, 1] > 0.8
    with pytest.raises(ValueError, match="day"):
        bundle.score(fresh.drop("day"))
    with pytest.raises(Exception):
        ensemble.ProductionEnsemble.load(f"{tmp_path}/none", spark)
    assert checks.QUERIES["j13_fresh_panel_scores"]
