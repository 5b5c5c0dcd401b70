"""Metrics of scores against outcomes. ``by`` names the groups; all groups are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.ordered import by_or_all, quantiles, running_before
from panelspark.sources.tables import settled

CLIP = 1e-7


def _drop(df: DataFrame) -> DataFrame:
    return df.drop("_all")


def _mean(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def auc_table(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """(by, auc, pr_auc): from one row for each group and distinct score, so ties cost nothing; scores are summed by ranges."""
    df, by = by_or_all(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), by)
    one = df.groupBy(*by, F.col(p).alias("_p")).agg(F.sum((F.col(y) > 0.5).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    neg = F.col("_n") - F.col("_pos")
    one = running_before(one, by, "_p", {"_below": neg, "_pos_below": F.col("_pos")})
    tp, every = F.col("_pos_below_total") - F.col("_pos_below"), F.col("_pos_below_total") + F.col("_below_total") - F.col("_pos_below") - F.col("_below")
    pos, negs = F.sum("_pos"), F.sum(neg)
    both = (pos > 0) & (negs > 0)
    auc = F.sum(F.col("_pos") * (F.col("_below") + neg / 2)) / (pos * negs)
    pr = F.sum(F.col("_pos") * tp / every) / pos
    return one.groupBy(*by).agg(F.when(both, auc).alias("auc"), F.when(both, pr).alias("pr_auc"), pos.alias("_pos"), negs.alias("_neg"))


def classification_metrics(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    rows, keys = by_or_all(rows, by)
    t, s = F.col(y) > 0.5, F.col(p)
    hit = s >= 0.5
    q = F.least(F.greatest(s, F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -F.when(t, F.log(q)).otherwise(F.log(1 - q))
    n = lambda c: F.sum(c.cast("long"))
    m = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _mean(t).alias("base_rate"), _mean(t == hit).alias("accuracy"), n(t & hit).alias("_tp"), n(hit).alias("_pp"), n(t).alias("_p1"), F.avg((s - t.cast("double")) ** 2).alias("brier"), F.avg(loss).alias("log_loss"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = m.withColumn("precision", ratio(F.col("_tp"), F.col("_pp"))).withColumn("recall", ratio(F.col("_tp"), F.col("_p1")))
    m = m.withColumn("f1", ratio(2 * F.col("_tp"), F.col("_pp") + F.col("_p1"))).drop("_tp", "_pp", "_p1")
    b = F.col("base_rate")
    m = m.withColumns({"majority_accuracy": F.greatest(b, 1 - b), "always_up": b, "brier_baseline": b * (1 - b)})
    m = m.withColumns({"skill_vs_majority": F.col("accuracy") - F.col("majority_accuracy"), "brier_skill_score": 1 - F.try_divide("brier", "brier_baseline")})
    out = m.join(auc_table(rows, y, p, keys), keys)
    a, n1, n0 = F.col("auc"), F.col("_pos"), F.col("_neg")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    se = F.sqrt((a * (1 - a) + (n1 - 1) * (q1 - a * a) + (n0 - 1) * (q2 - a * a)) / (n1 * n0))
    return _drop(out.withColumn("auc_stderr", se).withColumn("auc_z", F.try_divide(a - 0.5, se)).drop("_pos", "_neg"))


def _corr(a: Column, b: Column) -> Column:
    ok = (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
    return F.when(ok, F.corr(a, b)).otherwise(0.0)


def with_average_rank(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows plus the rank of value from 1 within the keys, ties averaged; value has no nulls. Ranks are counted by ranges, so no task sorts a group."""
    one = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    one = running_before(one, keys, "_v", {"_before": F.col("_k")})
    one = one.select(*keys, F.col("_v").alias(value), (F.col("_before") + (F.col("_k") + 1) / 2).alias(name))
    return rows.join(one, [*keys, value])


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """Errors and correlations by group, of the rows that have both; groups of one row have none."""
    rows = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    rows, keys = by_or_all(rows, by)
    rows = settled(rows.select(*keys, F.col(y).cast("double").alias("_a"), F.col(yhat).cast("double").alias("_b")))
    means = rows.groupBy(*keys).agg(F.avg("_a").alias("_mean"))
    rows = rows.join(F.broadcast(means) if keys == ["_all"] else means, keys)
    rows = with_average_rank(with_average_rank(rows, keys, "_a", "_ra"), keys, "_b", "_rb")
    a, b = F.col("_a"), F.col("_b")
    sse, sst = F.sum((a - b) ** 2), F.sum((a - F.col("_mean")) ** 2)
    moved = a != 0
    return _drop(
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(a - b)).alias("mae"),
            F.sqrt(F.avg((a - b) ** 2)).alias("rmse"),
            F.when(sst > 0, 1 - sse / sst).alias("r2"),
            F.avg(F.abs(a - F.col("_mean"))).alias("mae_baseline"),
            _corr(a, b).alias("pearson_ic"),
            _corr(F.col("_ra"), F.col("_rb")).alias("information_coefficient"),
            F.avg(F.when(moved, (F.signum(a) == F.signum(b)).cast("double"))).alias("directional_accuracy"),
            _mean(a > 0).alias("up_rate"),
        )
        .filter("n >= 2")
    )


def absolute_error(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """(by, n, mae) as in :func:`regression_metrics`, in one aggregation, without what needs ranks."""
    rows = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(y).cast("double") - F.col(yhat).cast("double"))).alias("mae")).filter("n >= 2")


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    rows, keys = by_or_all(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), by)
    rows = settled(rows.select(*keys, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")))
    rows = with_average_rank(with_average_rank(rows, keys, "_a", "_ra"), keys, "_b", "_rb")
    return _drop(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _corr(F.col("_ra"), F.col("_rb")).alias("spearman")))


def flag_suspicious(metrics: DataFrame) -> DataFrame:
    """metrics plus flags: results too good to believe. Missing metrics raise none."""
    have = lambda c: F.col(c) if c in metrics.columns else F.lit(None).cast("double")
    tests = {"AUC_IMPLAUSIBLE": have("auc") > 0.65, "AUC_HIGH": (have("auc") > 0.58) & (have("auc") <= 0.65), "SKILL_HIGH": have("skill_vs_majority") > 0.10, "IC_HIGH": F.abs(have("information_coefficient")) > 0.20, "R2_HIGH": have("r2") > 0.10}
    return metrics.withColumn("flags", F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])))


def aggregate_folds(metrics: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, metric, mean, std) over rows; the sample deviation of one row is 0."""
    stacked = metrics.selectExpr(*by, f"stack({len(columns)}, {', '.join(f"'{c}', cast({c} as double)" for c in columns)}) as (metric, value)")
    return stacked.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.when(F.count("value") > 0, 0.0)).alias("std"))


def compare_models(oof: DataFrame, by: str = "model") -> DataFrame:
    """Classification metrics of each model, best AUC first."""
    return classification_metrics(oof, "y_true", "y_pred", [by]).orderBy(F.desc_nulls_last("auc"), by)


def reliability_table(df: DataFrame, y: str, p: str, n_bins: int = 10, strategy: str = "quantile", by: list[str] | None = None) -> DataFrame:
    """(by, bin, lower, upper, count, mean_predicted, observed_frequency, gap), gap as predicted less observed.

    Quantile edges are the distinct linear percentiles; where all scores are
    one, a billionth on both sides of it.
    """
    rows, keys = by_or_all(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), by or [])
    s = F.col(p)
    if strategy == "uniform":
        binned = rows.withColumn("bin", F.least(F.floor(s * n_bins), F.lit(n_bins - 1)).cast("int"))
        binned = binned.withColumns({"lower": F.col("bin") / n_bins, "upper": (F.col("bin") + 1) / n_bins})
    else:
        edges = quantiles(rows, keys, p, [i / n_bins for i in range(n_bins + 1)], "_q").withColumn("_q", F.array_distinct("_q"))
        edges = edges.select(*keys, F.when(F.size("_q") > 1, F.col("_q")).otherwise(F.array(F.col("_q")[0] - 1e-9, F.col("_q")[0] + 1e-9)).alias("_q"))
        inner = F.slice("_q", F.lit(2), F.size("_q") - 2)
        binned = rows.join(F.broadcast(edges) if keys == ["_all"] else edges, keys).withColumn("bin", F.size(F.filter(inner, lambda e: e <= s)))
        binned = binned.withColumns({"lower": F.get("_q", F.col("bin")), "upper": F.get("_q", F.col("bin") + 1)})
    out = binned.groupBy(*keys, "bin", "lower", "upper").agg(F.count(F.lit(1)).alias("count"), F.avg(s).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_frequency"))
    return _drop(out.withColumn("gap", F.col("mean_predicted") - F.col("observed_frequency")))


def calibration_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """ECE (two binnings), MCE (bins of 20 or more), sharpness and Brier figures."""
    by = by or []
    rows, keys = by_or_all(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), by)

    def errors(strategy: str, name: str) -> DataFrame:
        t = reliability_table(rows, y, p, n_bins, strategy, keys)
        out = [(F.sum(F.abs("gap") * F.col("count")) / F.sum("count")).alias(name)]
        out += [F.max(F.when(F.col("count") >= 20, F.abs("gap"))).alias("mce")] if strategy == "quantile" else []
        return t.groupBy(*keys).agg(*out)

    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(p).alias("sharpness"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("base_rate"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))
    out = base.join(errors("quantile", "ece"), keys).join(errors("uniform", "ece_uniform"), keys)
    return _drop(out.withColumns({"bias": F.col("mean_predicted") - F.col("base_rate"), "brier_baseline": F.col("base_rate") * (1 - F.col("base_rate"))}))


def decompose_brier(df: DataFrame, y: str, p: str, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, reliability, resolution, uncertainty, reconstructed) over quantile bins."""
    t, keys = by_or_all(reliability_table(df, y, p, n_bins, "quantile", by or []), by or [])
    w = Window.partitionBy(*keys)
    t = t.withColumn("_n", F.sum("count").over(w)).withColumn("_base", F.sum(F.col("count") * F.col("observed_frequency")).over(w) / F.col("_n"))
    share = F.col("count") / F.col("_n")
    out = t.groupBy(*keys).agg(F.sum(share * F.col("gap") ** 2).alias("reliability"), F.sum(share * (F.col("observed_frequency") - F.col("_base")) ** 2).alias("resolution"), F.max(F.col("_base") * (1 - F.col("_base"))).alias("uncertainty"))
    return _drop(out.withColumn("reconstructed", F.col("reliability") - F.col("resolution") + F.col("uncertainty")))


def calibration_comparison(df: DataFrame, y: str = "y_true", raw: str = "raw", calibrated: str = "calibrated") -> DataFrame:
    long = df.selectExpr(y, f"stack(2, 'raw', {raw}, 'calibrated', {calibrated}) as (stage, score)")
    return calibration_metrics(long, y, "score", ["stage"])
