"""Models fitted by Spark ML, out of fold and on all development rows.

Features are imputed by the training median and scaled by the population
deviation before linear models, whose penalties are given as for a sum of
losses, not a mean.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.ordered import ONE_SORT, quantiles
from panelspark.operators import boosting
from panelspark.operators.calendar import session_index
from panelspark.operators.folds import assign_folds, fold_bounds
from panelspark.sources.tables import settled

Fit = Callable[[DataFrame, list[str], str], PipelineModel]
#: Folds that are fitted at a time.
AT_ONCE = 4


def _medians_by(train: DataFrame, keys: list[str], columns: list[str], sizes: dict) -> dict:
    """Exact medians of each of a handful of groups, 0 where a column has no value; in groups of up to ``ONE_SORT`` rows one aggregation holds them."""
    x = {f"q{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    if max(sizes.values(), default=0) <= ONE_SORT:
        rows = train.groupBy(*keys).agg(*[F.median(v).alias(q) for q, v in x.items()]).collect()
    else:
        long = train.select(*keys, F.explode(F.array(*[F.struct(F.lit(q).alias("feature"), v.alias("value")) for q, v in x.items()])).alias("_f")).select(*keys, "_f.*")
        rows = quantiles(long, [*keys, "feature"], "value", [0.5], "q").groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == q, F.col("q")[0])).alias(q) for q in x]).collect()
    found = {(r[keys[0]] if keys else None): r for r in rows}
    return {g: {c: 0.0 if g not in found or found[g][f"q{i}"] is None else found[g][f"q{i}"] for i, c in enumerate(columns)} for g in sizes}


def _scaled(train: DataFrame, columns: list[str], label: str) -> tuple[list, int, float]:
    """Stages that impute and scale, the number of rows, the label's population deviation."""
    size = train.agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop(label).alias("_sd")).first()
    medians = _medians_by(train, [], columns, {None: size["_n"]})[None]
    filled = [F.coalesce(F.col(c), F.lit(medians[c])) for c in columns]
    row = train.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
    parts = [f"(coalesce({c}, {float(medians[c])!r}D) - {float(row[f'm{i}'])!r}D) / {float(row[f's{i}'] or 1.0) or 1.0!r}D AS _x{i}" for i, c in enumerate(columns)]
    scale = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    return [scale, VectorAssembler(inputCols=[f"_x{i}" for i in range(len(columns))], outputCol="_features")], size["_n"], size["_sd"] or 1.0


def fit_logistic(c: float = 1.0) -> Fit:
    def fit(train: DataFrame, columns: list[str], label: str) -> PipelineModel:
        stages, n, _ = _scaled(train, columns, label)
        return Pipeline(stages=[*stages, LogisticRegression(featuresCol="_features", labelCol=label, regParam=1 / (c * n), standardization=False, maxIter=200, tol=1e-8)]).fit(train)

    return fit


@dataclass(frozen=True)
class Ridge:
    """Ridge by normal equations: one pass over the rows, where a descent takes one for each step."""

    alpha: float = 10.0

    def __call__(self, train: DataFrame, columns: list[str], label: str) -> PipelineModel:
        stages, n, sd = _scaled(train, columns, label)
        return Pipeline(stages=[*stages, LinearRegression(featuresCol="_features", labelCol=label, solver="normal", regParam=self.alpha * sd / n, standardization=False)]).fit(train)

    def out_of_fold(self, rows: DataFrame, columns: list[str], label: str) -> DataFrame:
        """:func:`generate_oof` of labelled rows, the same sums for all folds in one job; one row a fold reaches the driver."""
        train, k = rows.filter("role = 'train'"), len(columns)
        sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.when(F.col("role") == "train", 1)).alias("n")).collect()}
        if bare := sorted(f for f, n in sizes.items() if not n):
            raise ValueError(f"no training rows in folds {bare}")
        kind = rows.schema["fold"].dataType.simpleString()
        table = lambda told, names: F.broadcast(rows.sparkSession.createDataFrame([(f, *map(float, v)) for f, v in told.items()], ", ".join([f"fold {kind}", *[f"{c} double" for c in names]])))
        middle = table({f: m.values() for f, m in _medians_by(train, ["fold"], columns, sizes).items()}, [f"_q{i}" for i in range(k)])
        filled = [F.coalesce(F.col(c).cast("double"), F.col(f"_q{i}")) for i, c in enumerate(columns)]
        train = train.join(middle, "fold").select("fold", F.col(label).cast("double").alias("_y"), *[x.alias(f"_x{i}") for i, x in enumerate(filled)])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = [F.avg("_y").alias("_y"), *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(k)], *[F.covar_pop(f"_x{i}", f"_x{j}").alias(f"_c{i}_{j}") for i, j in pairs], *[F.covar_pop(f"_x{i}", "_y").alias(f"_d{i}") for i in range(k)]]
        weights = {}
        for r in train.groupBy("fold").agg(*sums).collect():
            n, cov = sizes[r["fold"]], np.zeros((k, k))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"_c{i}_{j}"]
            s = np.sqrt(np.maximum(np.diag(cov), 0.0))
            s[s == 0] = 1.0
            w = np.linalg.lstsq(n * cov / np.outer(s, s) + self.alpha * np.eye(k), n * np.array([r[f"_d{i}"] for i in range(k)]) / s, rcond=None)[0] / s
            weights[r["fold"]] = (r["_y"], *w, *[r[f"_m{i}"] for i in range(k)])
        model = table(weights, ["_b", *[f"_w{i}" for i in range(k)], *[f"_m{i}" for i in range(k)]])
        score = reduce(lambda a, b: a + b, [F.col(f"_w{i}") * (x - F.col(f"_m{i}")) for i, x in enumerate(filled)], F.col("_b"))
        return rows.filter("role = 'val'").join(middle, "fold").join(model, "fold").select("date", "symbol", "fold", F.col(label).alias("y_true"), score.alias("y_pred"))


def fit_ridge(alpha: float = 10.0) -> Fit:
    return Ridge(alpha)


def fit_boosted_direction(trees: int = 200, depth: int = 3, rate: float = 0.03, least: int = 200, l2: float = 1.0, leaves: int = 15) -> Fit:
    """Boosted trees for the chance that the label is 1; see :mod:`panelspark.operators.boosting`."""
    return lambda train, columns, label: boosting.fit(train, columns, label, boosting.Settings(trees, depth, leaves, rate, least, l2, True))


def fit_boosted_return(trees: int = 200, depth: int = 3, rate: float = 0.03, least: int = 200, l2: float = 1.0, leaves: int = 15) -> Fit:
    return lambda train, columns, label: boosting.fit(train, columns, label, boosting.Settings(trees, depth, leaves, rate, least, l2, False))


def predict(model: PipelineModel, df: DataFrame, name: str = "y_pred") -> DataFrame:
    out = model.transform(df)
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*df.columns, score.alias(name))


def baselines(assigned: DataFrame, label: str) -> DataFrame:
    """Validation rows with the fold's training mean and the momentum guess (0.6 up, 0.4 down) as predictions."""
    means = assigned.filter("role = 'train'").groupBy("fold").agg(F.avg(label).alias("mean_pred"))
    guess = F.when(F.coalesce("return_1d", F.lit(0.0)) > 0, 0.6).otherwise(0.4)
    return assigned.filter("role = 'val'").join(F.broadcast(means), "fold").withColumn("momentum_pred", guess)


def generate_oof(assigned: DataFrame, fit: Fit, columns: list[str], label: str) -> DataFrame:
    """(date, symbol, fold, y_true, y_pred) of every fold's validation rows, each by a model fitted on its training rows."""
    rows = assigned.filter(F.col(label).isNotNull())
    if isinstance(fit, Ridge):
        return fit.out_of_fold(rows, columns, label)

    def one(fold: int) -> DataFrame:
        own = rows.filter(F.col("fold") == fold)
        model = fit(own.filter("role = 'train'"), columns, label)
        return predict(model, own.filter("role = 'val'")).select("date", "symbol", "fold", F.col(label).alias("y_true"), "y_pred")

    found = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]  # a handful
    # Folds are independent jobs, a few of them at a time.
    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(one, found))
    return reduce(DataFrame.unionByName, parts) if parts else None


def walk_forward(assigned: DataFrame, fit: Fit, columns: list[str], label: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """score() of the out-of-fold predictions; fit and score take and give DataFrames."""
    return score(generate_oof(assigned, fit, columns, label))


def nested_walk_forward(df: DataFrame, grid: dict[str, Fit], columns: list[str], label: str, score: Callable[[DataFrame], DataFrame], n_folds: int = 5, test: int = 126, min_train: int = 252, inner_folds: int = 3, maximise: bool = True) -> DataFrame:
    """(date, symbol, fold, y_true, y_pred, selected): out of fold, with the fit of grid that was best within the fold's training rows.

    score gives (fold, value) of out-of-fold rows. Within an outer fold, every
    fit is scored on purged inner folds of its training rows, half as long as
    the outer ones, by the mean over them; the first of equals is taken. Outer
    and inner folds are a handful, and so is the grid. The inner folds of all
    outer ones are settled together, numbered fold * inner_folds + inner fold,
    and a fit of the grid is scored on all of them in one job.
    """
    if not grid:
        raise ValueError("the grid is empty")
    spark = df.sparkSession

    def assigned(rows: DataFrame, n: int, size: int, least: int) -> DataFrame:
        index = session_index(rows)
        return assign_folds(rows, fold_bounds(spark, index.count(), n_folds=n, test=size, min_train=least), index)

    outer = settled(assigned(df.select("date", "symbol", *columns, label).filter(F.col(label).isNotNull()), n_folds, test, min_train))
    found = [r["fold"] for r in outer.select("fold").distinct().orderBy("fold").collect()]  # a handful
    inner = []
    for k in found:
        train = outer.filter((F.col("fold") == k) & (F.col("role") == "train")).select("date", "symbol", *columns, label)
        own = assigned(train, inner_folds, max(21, test // 2), max(126, min_train // 2))
        inner.append(own.withColumn("fold", F.col("fold") + F.lit(k * inner_folds)))
    inner = settled(reduce(DataFrame.unionByName, inner))
    # One row a fit and outer fold.
    per = {name: score(generate_oof(inner, fit, columns, label)).groupBy(F.floor(F.col("fold") / inner_folds).alias("k")).agg(F.avg("value").alias("m")).collect() for name, fit in grid.items()}
    means = {name: {r["k"]: r["m"] for r in rows} for name, rows in per.items()}
    best = {k: (max if maximise else min)(grid, key=lambda name: means[name][k]) for k in found}
    parts = []
    for name in dict.fromkeys(best.values()):
        own = outer.filter(F.col("fold").isin([k for k in found if best[k] == name]))
        parts.append(generate_oof(own, grid[name], columns, label).withColumn("selected", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Calibrator:
    """Adds calibrated scores within [0, 1]; without a model, the scores as they are."""

    p: str
    model: PipelineModel | None

    def __call__(self, df: DataFrame, name: str = "calibrated") -> DataFrame:
        out = df.withColumn(name, F.col(self.p)) if self.model is None else predict(self.model, df, name)
        return out.withColumn(name, F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0)))


def fit_calibrator(scores: DataFrame, p: str = "y_pred", y: str = "y_true", method: str = "auto") -> Calibrator:
    """Isotonic from 1000 rows on, else a sigmoid; scores as they are with one class."""
    row = scores.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m")).first()
    if not row["n"] or row["m"] in (0.0, 1.0):
        return Calibrator(p, None)
    kind = ("isotonic" if row["n"] >= 1000 else "sigmoid") if method == "auto" else method
    stages = [VectorAssembler(inputCols=[p], outputCol="_p")]
    stages.append(IsotonicRegression(featuresCol="_p", labelCol=y) if kind == "isotonic" else LogisticRegression(featuresCol="_p", labelCol=y, regParam=1 / row["n"], standardization=False))
    return Calibrator(p, Pipeline(stages=stages).fit(scores))


def save_model(model, path: str, spark: SparkSession) -> str:
    """Writes a fitted model and gives its kind, which :func:`load_model` needs."""
    if isinstance(model, boosting.Boosted):
        model.save(path, spark)
        return "boosted"
    model.write().overwrite().save(path)
    return "pipeline"


def load_model(kind: str, path: str, spark: SparkSession):
    return boosting.Boosted.load(path, spark) if kind == "boosted" else PipelineModel.load(path)


def calibrate_out_of_fold(oof: DataFrame, blocks: DataFrame, min_rows: int = 500) -> DataFrame:
    """oof plus calibrated, each date block by a calibrator fitted on the blocks before; the first block is dropped."""
    rows = oof.join(blocks, "date")
    sizes = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}  # a handful
    out = None
    for b in sorted(sizes)[1:]:
        if sum(n for k, n in sizes.items() if k < b) < min_rows:
            continue
        part = fit_calibrator(rows.filter(F.col("block") < b))(rows.filter(F.col("block") == b))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("too few rows before every block")
    return out


def coefficients(models: dict[str, PipelineModel], columns: list[str], spark) -> DataFrame:
    """(feature, mean, std) of linear models' coefficients, largest mean first in size."""
    rows = [(name, c, float(v)) for name, m in models.items() for c, v in zip(columns, m.stages[-1].coefficients, strict=True)]
    df = spark.createDataFrame(rows, "model string, feature string, value double")
    return df.groupBy("feature").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std")).orderBy(F.desc(F.abs("mean")), "feature")


def permutation_importance(model: PipelineModel, df: DataFrame, columns: list[str], metric: Callable[[DataFrame], float], repeats: int = 5, seed: int = 7) -> dict[str, float]:
    """The mean drop of metric when a column's values change places.

    Places change within hashed groups of rows, so that no task sorts them all.
    """
    base = metric(predict(model, df))
    groups = 64
    numbered = df.withColumn("_g", F.pmod(F.xxhash64(*df.columns), F.lit(groups))).withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy(*df.columns)))
    out = {}
    for c in columns:
        drops = []
        for k in range(repeats):
            other = numbered.select("_g", F.row_number().over(Window.partitionBy("_g").orderBy(F.xxhash64("_i", F.lit(seed + k)))).alias("_i"), F.col(c).alias("_v"))
            mixed = numbered.join(other, ["_g", "_i"]).withColumn(c, F.col("_v")).select(*df.columns)
            drops.append(base - metric(predict(model, mixed)))
        out[c] = float(np.mean(drops))
    return out


FORECAST = "symbol string, as_of date, rows long, validation_sessions long, accuracy double, majority double, auc double, mae double, mae_baseline double, probability_up double, expected_return double, direction string, refused string"


def _solve_logistic(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    """L2 logistic regression by Newton steps; the last weight is the intercept, without penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1 / c), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _auc(y: np.ndarray, p: np.ndarray) -> float | None:
    """ROC-AUC with ties counted half; None where one class is missing."""
    ranks, pos = pd.Series(p).rank().to_numpy(), int(y.sum())
    neg = len(y) - pos
    return float((ranks[y].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else None


def forecast_symbols(features: DataFrame, columns: list[str], least: int = 500, folds: int = 5, size: int = 60, gap: int = 1, c: float = 0.1, alpha: float = 100.0) -> DataFrame:
    """One row for each symbol: a forecast from its newest row, with its accuracy over the last folds against training-only baselines.

    ``refused`` says why a symbol has none: too few complete rows, a newest row
    that lacks a feature (an older one is no substitute), or a fold that trains
    on one direction only. auc is null where the folds saw one direction.
    """
    names = [k.split()[0] for k in FORECAST.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        known, last = pdf.dropna(subset=[*columns, "target"]), pdf.tail(1)
        told = dict.fromkeys(names) | {"symbol": last["symbol"].iloc[0], "as_of": last["date"].iloc[0], "rows": len(known)}
        refuse = lambda why: pd.DataFrame([told | {"refused": why}]).astype(object)
        if len(known) < least:
            return refuse("TOO_FEW_ROWS")
        if last[columns].isna().any(axis=None):
            return refuse("INCOMPLETE_LATEST_ROW")
        x, r = known[columns].to_numpy(dtype=float), known["target"].to_numpy(dtype=float)
        y = (r > 0).astype(float)

        def both(train: np.ndarray, test: np.ndarray, yt: np.ndarray, rt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            m, s = train.mean(axis=0), train.std(axis=0)
            s[s == 0] = 1
            a, b = (train - m) / s, (test - m) / s
            w = _solve_logistic(a, yt, c)
            v = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ (rt - rt.mean()))
            return 1 / (1 + np.exp(-(b @ w[:-1] + w[-1]))), b @ v + rt.mean()

        seen, chances, major, err, base = [], [], [], [], []
        for k in range(folds):
            end = len(known) - (folds - 1 - k) * size
            cut, start = end - size - gap, end - size
            if cut < 1 or not 0 < y[:cut].sum() < cut:
                return refuse("ONE_DIRECTION_IN_A_FOLD")
            p, e = both(x[:cut], x[start:end], y[:cut], r[:cut])
            seen += list(y[start:end] > 0)
            chances += list(p)
            major += list((y[:cut].mean() >= 0.5) == (y[start:end] > 0))
            err += list(np.abs(e - r[start:end]))
            base += list(np.abs(r[:cut].mean() - r[start:end]))
        p, e = both(x, last[columns].to_numpy(dtype=float), y, r)
        actual, chances = np.array(seen), np.array(chances)
        told |= {"validation_sessions": len(actual), "accuracy": float(np.mean((chances >= 0.5) == actual)), "majority": float(np.mean(major)), "auc": _auc(actual, chances), "mae": float(np.mean(err)), "mae_baseline": float(np.mean(base)), "probability_up": float(p[0]), "expected_return": float(e[0]), "direction": "UP" if p[0] >= 0.5 else "DOWN"}
        return pd.DataFrame([told]).astype(object)

    return features.select("symbol", "date", *columns, "target").groupBy("symbol").applyInPandas(one, FORECAST)
