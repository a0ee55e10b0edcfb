"""From result rows to paired losses and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.operators.ordering import grouped_quantiles
from tarnish.session import staged

# Metric -> whether larger is better; corruption levels in tenths.
METRIC_DIRECTIONS = {
    "auc": "higher", "brier": "lower", "rmse": "lower", "r2": "higher",
    "c_index": "higher", "ibs": "lower",
}
LEVELS = [1, 2, 3]


def metric_registry(spark, directions: Mapping[str, str] = METRIC_DIRECTIONS) -> DataFrame:
    rows = [(m, d) for m, d in directions.items()]
    return spark.createDataFrame(rows, "metric string, direction string")


def of_interest(results: DataFrame, models: Sequence[str] | None = None, n_fixed: int | None = None) -> DataFrame:
    """Rows of one cohort size and of the models under study."""
    if n_fixed is not None:
        results = results.filter(F.col("N") == n_fixed)
    if models is not None:
        results = results.filter(F.col("model").isin(list(models)))
    return results


def first_per_key(results: DataFrame, keys: Sequence[str], ingest_order: str) -> DataFrame:
    """Keep the first ingested row of each key (a combinable minimum, no sort per key)."""
    rest = [c for c in results.columns if c not in keys]
    first = results.groupBy(*keys).agg(F.min_by(F.struct(*rest), ingest_order).alias("__row"))
    return first.select(*keys, "__row.*").select(*results.columns)


def signed(direction: str, base: Column, value: Column) -> Column:
    """Loss that is positive when the metric got worse."""
    return base - value if direction == "higher" else value - base


def with_baseline(results: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Each corrupted row next to every clean row of its replicate (inner join, duplicates fan out)."""
    results = staged(results)
    on = [*keys, "dimension", "model", "replicate"]
    clean = results.filter(F.col("level") == 0)
    clean = clean.select(*[F.col(k).alias(f"__{k}") for k in on], F.struct(*metrics).alias("base"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on])
    return results.filter(F.col("level") != 0).join(clean, same).drop(*[f"__{k}" for k in on])


def first_pairs(results: DataFrame, keys: Sequence[str], ingest_order: str) -> DataFrame:
    """The first row of each replicate and level, so that a repeated run does not pair twice."""
    return first_per_key(results, [*keys, "dimension", "model", "level", "replicate"], ingest_order)


def paired_loss(
    results: DataFrame,
    directions: Mapping[str, str],
    keys: Sequence[str] = (),
    levels: Sequence[int] = LEVELS,
    digits: int | None = None,
) -> DataFrame:
    """Long loss table: keys, metric, dimension, model, level, replicate, loss.

    ``results`` has one column per metric, ``level`` in tenths and 0 for clean rows.
    ``digits`` rounds the loss, so that ranks do not hang on the last bit of a mean.
    """
    kept = results.filter(F.col("level").isin([0, *levels]))
    paired = with_baseline(kept, list(directions), keys)
    losses = []
    for metric, direction in directions.items():
        loss = signed(direction, F.col(f"base.{metric}"), F.col(metric))
        if digits is not None:
            loss = F.round(loss, digits)
            loss = F.when(loss == 0, F.lit(0.0)).otherwise(loss)
        losses.append(F.struct(F.lit(metric).alias("metric"), loss.alias("loss")))
    return paired.select(
        *keys, "dimension", "model", "level", "replicate", F.explode(F.array(*losses)).alias("m")
    ).select(*keys, "m.metric", "dimension", "model", "level", "replicate", "m.loss")


def level_label(level: str = "level") -> Column:
    return (F.col(level) / 10).cast("decimal(3,1)")


def loss_coverage(loss: DataFrame, n_dims: int, n_models: int, n_levels: int, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Observed against expected number of loss rows."""
    return loss.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observed"),
        (F.count_distinct("replicate") * (n_dims * n_models * n_levels)).alias("n_expected"),
    ).withColumn("complete", F.col("n_observed") == F.col("n_expected"))


def metric_band(
    results: DataFrame,
    metrics: Sequence[str],
    keys: Sequence[str],
    clip: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of each metric per key, optionally clipped for display."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    long = results.select(*keys, F.explode(F.array(*cells)).alias("m")).select(*keys, "m.metric", "m.value")
    groups = [*keys, "metric"]
    mean = long.groupBy(*groups).agg(F.avg("value").alias("mean"))
    band = grouped_quantiles(long, groups, "value", {"low": 0.025, "high": 0.975})
    out = mean.join(band, groups)
    for metric, (lo, hi) in (clip or {}).items():
        for c in ("mean", "low", "high"):
            inside = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))
            out = out.withColumn(c, F.when(F.col("metric") == metric, inside).otherwise(F.col(c)))
    return out


def effect_size(loss: DataFrame, keys: Sequence[str], level: int = 3) -> DataFrame:
    """Median change and percentile interval, pooled over the models of a key."""
    at = loss.filter(F.col("level") == level)
    counts = at.groupBy(*keys).agg(F.count("loss").alias("n_pairs"))
    probs = {"median": 0.5, "low": 0.025, "high": 0.975}
    return counts.join(grouped_quantiles(at, list(keys), "loss", probs), list(keys))


def relative_change(
    results: DataFrame, directions: Mapping[str, str], level: int = 3, keys: Sequence[str] = ("model", "dimension")
) -> DataFrame:
    """Mean change against clean data and the loss in percent of the clean mean."""
    aggs = []
    for m in directions:
        aggs.append(F.avg(F.when(F.col("level") == 0, F.col(m))).alias(f"clean_{m}"))
        aggs.append(F.avg(F.when(F.col("level") == level, F.col(m))).alias(f"worst_{m}"))
    wide = results.filter(F.col("level").isin([0, level])).groupBy(*keys).agg(*aggs)
    cells = []
    for m, d in directions.items():
        change = F.col(f"worst_{m}") - F.col(f"clean_{m}")
        sign = -1.0 if d == "higher" else 1.0
        cells.append(
            F.struct(
                F.lit(m).alias("metric"),
                change.alias("mean_change"),
                (F.lit(sign) * change / F.abs(F.nullif(F.col(f"clean_{m}"), F.lit(0.0))) * 100).alias("loss_pct"),
            )
        )
    return wide.select(*keys, F.explode(F.array(*cells)).alias("m")).select(*keys, "m.*")


def raw_loss(results: DataFrame, directions: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Loss on the metric's own scale; where only differences matter the baseline cancels."""
    cells = [
        F.struct(F.lit(m).alias("metric"), (-F.col(m) if d == "higher" else F.col(m)).alias("loss"))
        for m, d in directions.items()
    ]
    return results.select(
        *keys, "dimension", "model", "level", "replicate", F.explode(F.array(*cells)).alias("m")
    ).select(*keys, "m.metric", "dimension", "model", "level", "replicate", "m.loss")
