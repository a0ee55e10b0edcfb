"""Metrics of prediction tables, per group of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.operators.ordering import grouped_quantiles, prefix_sums
from tarnish.operators.prep import predicted_class

# Weights of the .632 rule and the no-information error rates.
IN_BAG_WEIGHT = 0.368
OOB_WEIGHT = 0.632
NO_INFORMATION = {"auc": 0.5, "brier": 0.098}
HIGHER_IS_BETTER = {"auc", "auprc", "accuracy", "f1_macro", "r2", "c_index"}


def _none_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def ranking_metrics(pred: DataFrame, groups: Sequence[str], **size) -> DataFrame:
    """AUC and average precision per group, null where only one class is present.

    Equal scores are collapsed first; both metrics are sums over distinct scores of what
    lies below (AUC) or at and above (precision).
    """
    tied = pred.filter(F.col("score").isNotNull()).groupBy(*groups, "score").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("y").cast("long")).alias("pos")
    )
    placed = prefix_sums(tied, list(groups), "score", ["rows", "pos"], **size)
    pos = F.col("pos").cast("double")
    neg_here = F.col("rows") - F.col("pos")
    neg_below = F.col("before_rows") - F.col("before_pos")
    pos_from = F.col("total_pos") - F.col("before_pos")
    rows_from = F.col("total_rows") - F.col("before_rows")
    sums = placed.groupBy(*groups).agg(
        F.sum("pos").alias("__p"),
        F.sum(neg_here).alias("__n"),
        F.sum(pos * (neg_below + neg_here / 2)).alias("__u"),
        F.sum(pos * pos_from / rows_from).alias("__ap"),
    )
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    return sums.select(
        *groups,
        F.when(both, F.col("__u") / (F.col("__p").cast("double") * F.col("__n"))).alias("auc"),
        F.when(both, F.col("__ap") / F.col("__p")).alias("auprc"),
    )


def threshold_metrics(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Accuracy, macro F1 over the classes present, and Brier score."""
    said = predicted_class(F.col("score"))
    counts = pred.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.sum(((F.col("y") == 1) & (said == 1)).cast("double")).alias("__tp"),
        F.sum(((F.col("y") == 0) & (said == 1)).cast("double")).alias("__fp"),
        F.sum(((F.col("y") == 1) & (said == 0)).cast("double")).alias("__fn"),
        F.sum(((F.col("y") == 0) & (said == 0)).cast("double")).alias("__tn"),
        F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(f"__{k}") for k in ("tp", "fp", "fn", "tn"))
    has1, has0 = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    f1 = F.when(has1, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    f0 = F.when(has0, 2 * tn / (2 * tn + fp + fn)).otherwise(F.lit(0.0))
    return counts.select(
        *groups,
        ((tp + tn) / F.col("__rows")).alias("accuracy"),
        ((f1 + f0) / (has1.cast("int") + has0.cast("int"))).alias("f1_macro"),
        "brier",
    )


def classification_metrics(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    return threshold_metrics(pred, groups).join(ranking_metrics(pred, groups), list(groups), "left")


def regression_metrics(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    """RMSE, MAE, R2 (null for a single row), and moments of target and prediction."""
    err = F.col("score") - F.col("y")
    sums = pred.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.avg(err * err).alias("__mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop("y").alias("y_var"),
        F.avg("y").alias("y_mean"),
        F.avg("score").alias("yhat_mean"),
        F.var_pop("score").alias("yhat_var"),
        F.avg(err).alias("bias"),
    )
    flat = F.when(F.col("__mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("y_var") == 0, flat).otherwise(1 - F.col("__mse") / _none_if_zero(F.col("y_var")))
    return sums.select(
        *groups, F.sqrt("__mse").alias("rmse"), "mae", F.when(F.col("__rows") > 1, r2).alias("r2"),
        "yhat_mean", "yhat_var", "y_mean", "y_var", "bias",
    )


def prediction_diagnostics(pred: DataFrame, groups: Sequence[str], prior: str = "prior") -> DataFrame:
    """Mean, variance, mean binary entropy and mean distance from the prior of the scores."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), F.col("score")))
    entropy = -p * F.ln(p) - (1 - p) * F.ln(1 - p)
    return pred.groupBy(*groups).agg(
        F.avg("score").alias("p_mean"),
        F.var_pop("score").alias("p_var"),
        F.avg(entropy).alias("p_entropy"),
        F.avg(F.abs(F.col("score") - F.col(prior))).alias("p_abs_dist_prior"),
    )


def with_prior(pred: DataFrame, groups: Sequence[str], split: str = "split") -> DataFrame:
    """Add the in-bag event rate of the group as ``prior``."""
    rate = pred.filter(F.col(split) == "in_bag").groupBy(*groups).agg(F.avg("y").alias("prior"))
    return pred.join(rate, list(groups), "left")


def survival_diagnostics(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Moments of the risk score, event rate and median time."""
    base = pred.groupBy(*groups).agg(
        F.avg("risk").alias("risk_mean"),
        F.var_pop("risk").alias("risk_var"),
        F.avg(F.col("event").cast("double")).alias("event_rate"),
    )
    return base.join(grouped_quantiles(pred, list(groups), "time", {"median_time": 0.5}), list(groups))


def mean_over_seeds(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Average of repeated fits; missing values are skipped, all missing stays missing."""
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def both_splits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long rows (keys, split, value) to one row with ``inbag`` and ``oob``."""
    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == "in_bag", F.col("value"))).alias("inbag"),
        F.max(F.when(F.col("split") == "oob", F.col("value"))).alias("oob"),
    )


def point632(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """.632 combination of in-bag and out-of-bag values; null if a side is missing.

    Equal to combining errors (1 - value) for the metrics where larger is better,
    because the two weights add up to one.
    """
    combined = IN_BAG_WEIGHT * F.col("inbag") + OOB_WEIGHT * F.col("oob")
    return both_splits(rows, keys).withColumn("v632", combined)


def point632plus(rows: DataFrame, keys: Sequence[str], metric: str = "metric", gamma: dict | None = None) -> DataFrame:
    """.632+ with its adaptive weight on the error scale, next to plain .632."""
    gamma = NO_INFORMATION if gamma is None else gamma
    both = point632(rows, keys)
    up = F.col(metric).isin([m for m in gamma if m in HIGHER_IS_BETTER])
    none = F.lit(None).cast("double")
    for m, g in gamma.items():
        none = F.when(F.col(metric) == m, F.lit(g)).otherwise(none)
    ei = F.when(up, 1 - F.col("inbag")).otherwise(F.col("inbag"))
    eo = F.when(up, 1 - F.col("oob")).otherwise(F.col("oob"))
    room = none - ei
    ratio = F.when(room <= 0, F.lit(0.0)).otherwise((eo - ei) / _none_if_zero(room))
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
    w = OOB_WEIGHT / (1 - IN_BAG_WEIGHT * r)
    err = (1 - F.col("w")) * ei + F.col("w") * eo
    weighed = both.withColumn("w", F.when(F.col("v632").isNotNull(), w))
    return weighed.withColumn("vplus", F.when(up, 1 - err).otherwise(err))


def estimator_contrast(
    parts: DataFrame, first: str, second: str, columns: Sequence[str] = ("v632", "vplus")
) -> DataFrame:
    """Median over replicates of (loss under first - loss under second), per estimator.

    ``parts`` has cond, model, metric, replicate and the estimator columns; the clean
    baseline is on both sides of the difference, but a replicate must have it.
    """
    keys = ["metric", "model", "replicate"]
    picks = [
        F.max(F.when(F.col("cond") == cond, F.col(c))).alias(f"{c}_{i}")
        for i, cond in enumerate(("clean", first, second))
        for c in columns
    ]
    wide = parts.filter(F.col("cond").isin("clean", first, second)).groupBy(*keys).agg(*picks)
    sign = F.when(F.col("metric").isin(sorted(HIGHER_IS_BETTER)), F.lit(1.0)).otherwise(F.lit(-1.0))
    diffs = wide.select(
        *keys,
        *[(sign * ((F.col(f"{c}_0") - F.col(f"{c}_1")) - (F.col(f"{c}_0") - F.col(f"{c}_2")))).alias(c) for c in columns],
    )
    out = None
    for c in columns:
        part = grouped_quantiles(diffs.filter(F.col(c).isNotNull()), ["metric", "model"], c, {c: 0.5})
        out = part if out is None else out.join(part, ["metric", "model"], "full")
    return out


def stage_comparison(parts: DataFrame) -> DataFrame:
    """Does training-side degradation (S1) still cost less than test-side (S2) once the
    estimator changes from .632 to out-of-bag?

    ``parts`` has stage ('clean', 'S1', 'S2'), dimension, model, metric, replicate, v632
    and oob. Per model and metric: mean over dimensions of the median loss per stage,
    the S2 - S1 gap under both estimators, and whether its sign flips.
    """
    clean = parts.filter(F.col("stage") == "clean").select(
        "model", "metric", "replicate", F.col("v632").alias("c632"), F.col("oob").alias("coob")
    )
    sign = F.when(F.col("metric").isin(sorted(HIGHER_IS_BETTER)), F.lit(1.0)).otherwise(F.lit(-1.0))
    loss = (
        parts.filter(F.col("stage") != "clean")
        .join(clean, ["model", "metric", "replicate"])
        .select(
            "stage", "dimension", "model", "metric",
            (sign * (F.col("c632") - F.col("v632"))).alias("l632"), (sign * (F.col("coob") - F.col("oob"))).alias("loob"),
        )
    )
    cells = F.array(
        F.struct(F.lit("632").alias("est"), F.col("l632").alias("loss")), F.struct(F.lit("oob").alias("est"), F.col("loob").alias("loss"))
    )
    groups = ["stage", "dimension", "model", "metric", "est"]
    long = loss.select("stage", "dimension", "model", "metric", F.explode(cells).alias("e")).select(*groups[:-1], "e.*")
    medians = grouped_quantiles(long, groups, "loss", {"loss": 0.5})
    picks = [
        F.avg(F.when((F.col("stage") == s) & (F.col("est") == e), F.col("loss"))).alias(f"{s.lower()}_{e}")
        for s in ("S1", "S2")
        for e in ("632", "oob")
    ]
    wide = medians.groupBy("metric", "model").agg(*picks)
    gap632, gapoob = F.col("s2_632") - F.col("s1_632"), F.col("s2_oob") - F.col("s1_oob")
    return wide.select("*", gap632.alias("gap_632"), gapoob.alias("gap_oob"), ((gap632 > 0) != (gapoob > 0)).alias("flips"))
