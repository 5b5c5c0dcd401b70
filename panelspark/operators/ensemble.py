"""Stacked ensembles: base scores joined, a linear model over them, calibration, and scoring of new rows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import metrics, models, records
from panelspark.operators.folds import date_blocks
from panelspark.sources.tables import settled

KEYS = ("date", "symbol")


def meta_columns(meta: DataFrame) -> list[str]:
    return [c for c in meta.columns if c not in (*KEYS, "y_true", "fold", "block")]


def model_version(name: str, spec: dict, training_end=None) -> str:
    """name-digest, then the last training day if given; the digest is that of spec."""
    digest = hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:12]
    return "-".join([name, digest, *([str(training_end)] if training_end else [])])


def fit_stack(assigned: DataFrame, columns: list[str], c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of a logistic model over base scores, and its coefficients over folds.

    assigned holds meta features with fold and role; rows without a label take
    no part. Medians and scales are those of a fold's training rows.
    """
    rows = assigned.filter("y_true is not null").withColumn("_y", (F.col("y_true") > 0.5).cast("double"))
    fit, parts, fitted = models.fit_logistic(c), [], {}
    for fold in [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]:  # a handful
        own = rows.filter(F.col("fold") == fold)
        fitted[str(fold)] = fit(own.filter("role = 'train'"), columns, "_y")
        parts.append(models.predict(fitted[str(fold)], own.filter("role = 'val'")).select(*KEYS, "fold", "y_true", "y_pred"))
    if not parts:
        raise ValueError("no labelled rows to stack")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, models.coefficients(fitted, columns, assigned.sparkSession)


def compare_with_bases(stacked: DataFrame, bases: dict[str, DataFrame]) -> DataFrame:
    """Metrics of the stack and of each base on its own rows, best AUC first, with beats_best_base on the stack's row."""
    long = stacked.select(F.lit("stack").alias("model"), "y_true", "y_pred")
    for name, df in bases.items():
        long = long.unionByName(df.select(F.lit(name).alias("model"), "y_true", "y_pred"))
    table = metrics.compare_models(long)
    best = table.filter("model <> 'stack'").agg(F.max("auc").alias("_best"))
    return table.crossJoin(F.broadcast(best)).withColumn("beats_best_base", F.when(F.col("model") == "stack", F.col("auc") > F.col("_best"))).drop("_best")


@dataclass
class Production:
    """A stack and its calibrator fitted on all labelled rows, with the version that scored rows carry."""

    model: PipelineModel
    calibrate: object
    version: str

    def score(self, meta: DataFrame, expected: DataFrame | None = None) -> DataFrame:
        """(keys, raw, calibrated, model_version), with expected_return where its table (keys, y_pred) is given."""
        raw = models.predict(self.model, meta, "raw").select(*KEYS, "raw")
        out = self.calibrate(raw, "calibrated").select(*KEYS, "raw", "calibrated", F.lit(self.version).alias("model_version"))
        return out if expected is None else records.attach_expected_returns(out, expected)


def fit_production(meta: DataFrame, oof: DataFrame, columns: list[str], c: float = 1.0, name: str = "stack") -> Production:
    """The stack on every labelled row of meta; the calibrator on out-of-fold scores, which no row of theirs has taught."""
    rows = meta.filter("y_true is not null").withColumn("_y", (F.col("y_true") > 0.5).cast("double"))
    end = rows.agg(F.max("date")).first()[0]
    model = models.fit_logistic(c)(rows, columns, "_y")
    calibrate = models.fit_calibrator(oof.select(F.col("y_pred").alias("raw"), "y_true"), p="raw")
    return Production(model, calibrate, model_version(name, {"c": c, "columns": columns}, end))


@dataclass
class ProductionEnsemble:
    """All that scores a panel without labels: base models of all development rows, stack, calibrator and return model."""

    version: str
    columns: list[str]
    context: list[str]
    direction: dict[str, object]
    stack: PipelineModel
    calibrator: models.Calibrator
    returns: object

    def score(self, panel: DataFrame) -> DataFrame:
        """(date, symbol, a column for each base, raw, calibrated, expected_return, model_version) of every row of panel.

        panel has the keys, the features and the context columns; labels are
        not needed. A missing column is refused before anything runs.
        """
        if lacking := [c for c in dict.fromkeys((*KEYS, *self.columns, *self.context)) if c not in panel.columns]:
            raise ValueError(f"the panel lacks {', '.join(lacking)}")
        df = panel.select(*dict.fromkeys((*KEYS, *self.columns, *self.context)))
        for name, model in self.direction.items():
            df = models.predict(model, df, name)
        df = models.predict(self.returns, df, "expected_return")
        df = self.calibrator(models.predict(self.stack, df, "raw"), "calibrated")
        return df.select(*KEYS, *self.direction, "raw", "calibrated", "expected_return", F.lit(self.version).alias("model_version"))

    def save(self, path: str, spark: SparkSession) -> str:
        """Writes the bundle to a folder of its version under path and gives that folder. The manifest comes last: without it nothing is loaded."""
        at = f"{path}/{self.version}"
        parts = {f"direction-{i}": m for i, m in enumerate(self.direction.values())} | {"stack": self.stack, "returns": self.returns} | ({"calibrator": self.calibrator.model} if self.calibrator.model else {})
        told = {"version": self.version, "columns": self.columns, "context": self.context, "direction": list(self.direction), "p": self.calibrator.p, "kinds": {k: models.save_model(m, f"{at}/{k}", spark) for k, m in parts.items()}}
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
        return at

    @staticmethod
    def load(at: str, spark: SparkSession) -> ProductionEnsemble:
        """The bundle of a folder that :meth:`save` gave; a folder without a manifest is an error."""
        told = json.loads(spark.read.text(f"{at}/manifest", wholetext=True).first()[0])
        part = lambda k: models.load_model(told["kinds"][k], f"{at}/{k}", spark)
        calibrator = models.Calibrator(told["p"], part("calibrator") if "calibrator" in told["kinds"] else None)
        return ProductionEnsemble(told["version"], told["columns"], told["context"], {n: part(f"direction-{i}") for i, n in enumerate(told["direction"])}, part("stack"), calibrator, part("returns"))


def fit_production_ensemble(assigned: DataFrame, assign, fits: dict[str, models.Fit], return_fit: models.Fit, columns: list[str], label: str, target: str, context: tuple[str, ...] = (), c: float = 1.0, name: str = "ensemble") -> ProductionEnsemble:
    """From development rows with folds to a bundle.

    The stack learns from out-of-fold base scores and the calibrator from
    out-of-fold scores of the stack (assign gives the joined rows folds); base
    and return models are then fitted again on every labelled row, once each.
    """
    rows = settled(assigned.filter(F.col(label).isNotNull()))
    extra = rows.select(*KEYS, *context).dropDuplicates(KEYS) if context else None
    meta = settled(records.meta_features({n: models.generate_oof(rows, fit, columns, label) for n, fit in fits.items()}, extra))
    own = meta_columns(meta)
    oof, _ = fit_stack(assign(meta), own, c)
    labelled = meta.withColumn("_y", (F.col("y_true") > 0.5).cast("double"))
    stack = models.fit_logistic(c)(labelled, own, "_y")
    calibrator = models.fit_calibrator(settled(oof.select(F.col("y_pred").alias("raw"), (F.col("y_true") > 0.5).cast("double").alias("y_true"))), p="raw")
    every = settled(rows.select(*KEYS, *dict.fromkeys((*columns, label, target))).dropDuplicates(KEYS))
    end = every.agg(F.max("date")).first()[0]
    version = model_version(name, {"bases": list(fits), "columns": columns, "context": list(context), "c": c}, end)
    return ProductionEnsemble(version, list(columns), list(context), {n: fit(every, columns, label) for n, fit in fits.items()}, stack, calibrator, return_fit(every.filter(F.col(target).isNotNull()), columns, target))


@dataclass
class Ensemble:
    meta: DataFrame
    stacked: DataFrame
    coefficients: DataFrame
    calibrated: DataFrame
    comparison: DataFrame
    calibration: DataFrame
    brier: DataFrame


def build_ensemble(bases: dict[str, DataFrame], assign, context: DataFrame | None = None, blocks: int = 4, c: float = 1.0, min_rows: int = 500) -> Ensemble:
    """From base out-of-fold frames to a calibrated stack and its tables.

    assign gives the joined rows their folds. The key sets may differ; rows
    that all bases have take part (records.key_differences counts the rest).
    The joined rows and the stack's scores are settled, as every fit reads them.
    """
    meta = settled(records.meta_features(bases, context))
    stacked, weights = fit_stack(assign(meta), meta_columns(meta), c)
    stacked = settled(stacked)
    calibrated = models.calibrate_out_of_fold(stacked, date_blocks(stacked, blocks), min_rows)
    both = calibrated.select("y_true", F.col("y_pred").alias("raw"), "calibrated")
    return Ensemble(meta, stacked, weights, calibrated, compare_with_bases(stacked, bases), metrics.calibration_comparison(both), metrics.decompose_brier(both, "y_true", "calibrated"))
