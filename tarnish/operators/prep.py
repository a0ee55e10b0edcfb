"""Schema repair, encoding and scaling of (degraded) cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.operators.ordering import column_quantiles, grouped_quantiles

MISSING = "missing"


def ensure_columns(df: DataFrame, types: Mapping[str, str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Add expected columns that are absent, as nulls (or as their default)."""
    defaults = defaults or {}
    new = {c: F.lit(defaults.get(c)).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def number_or_null(c: str) -> Column:
    """Numeric value of a cell; anything that does not parse, and NaN, becomes null."""
    return F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None).cast("double"))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number_or_null(c) for c in columns if c in df.columns})


def coerce_event(df: DataFrame, event: str) -> DataFrame:
    """Event indicator as boolean; what is missing or does not parse counts as no event."""
    number = number_or_null(event) if dict(df.dtypes)[event] != "boolean" else F.col(event).cast("double")
    return df.withColumn(event, F.coalesce(number, F.lit(0.0)) != 0)


def sentinel_encode(df: DataFrame, sentinels: Mapping[str, float]) -> DataFrame:
    return df.na.fill({c: v for c, v in sentinels.items() if c in df.columns})


def fill_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns})


def fitted_categories(clean: DataFrame, column: str) -> DataFrame:
    """``v``: the distinct categories of the clean table. Each becomes a column of ``one_hot``, so
    whoever calls that decides how many there may be."""
    return clean.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct()


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """0/1 columns per fitted category; an unknown category gives zeros throughout."""
    hot = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in categories}
    return df.withColumns(hot)


def drop_protected(df: DataFrame, protected: Sequence[str]) -> DataFrame:
    return df.drop(*protected)


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Last resort before a model: null becomes 0, single precision."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in columns})


def log_target(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"log_{column}", F.log1p(F.col(column)))


def valid_targets(df: DataFrame, target: str, positive: bool = False) -> DataFrame:
    """Drop rows without a usable target (null, or not above zero for a duration)."""
    return df.filter((F.col(target) > 0) if positive else F.col(target).isNotNull())


def _safe_sd(sd: Column) -> Column:
    return F.when(sd.isNull() | F.isnan(sd) | (sd == 0), F.lit(1.0)).otherwise(sd)


def standardise(df: DataFrame, clean: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale by mean and population deviation of the clean table, fitted once."""
    fitted = clean.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).collect()[0]
    scaled = {}
    for c in columns:
        mean, sd = fitted[f"m_{c}"], fitted[f"s_{c}"]
        scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(sd if sd else 1.0)
    return df.withColumns(scaled)


def standardise_in_bag(df: DataFrame, columns: Sequence[str], replicate: str = "replicate", draws: str = "draws") -> DataFrame:
    """Scale by constants refitted on each replicate's in-bag rows, drawn rows counting
    as often as they were drawn."""
    w = F.col(draws).cast("double")
    sums = []
    for c in columns:
        there = F.when(F.col(c).isNotNull(), w)
        sums += [
            F.sum(there).alias(f"__n_{c}"),
            F.sum(there * F.col(c)).alias(f"__s_{c}"),
            F.sum(there * F.col(c) * F.col(c)).alias(f"__q_{c}"),
        ]
    fitted = df.filter(F.col(draws) > 0).groupBy(replicate).agg(*sums)
    keep = [replicate]
    for c in columns:
        mean = F.col(f"__s_{c}") / F.col(f"__n_{c}")
        variance = F.greatest(F.col(f"__q_{c}") / F.col(f"__n_{c}") - mean * mean, F.lit(0.0))
        # cancellation leaves dust where all values are equal
        sd = F.when(variance <= mean * mean * 1e-14, F.lit(0.0)).otherwise(F.sqrt(variance))
        fitted = fitted.withColumn(f"__m_{c}", mean).withColumn(f"__d_{c}", _safe_sd(sd))
        keep += [f"__m_{c}", f"__d_{c}"]
    joined = df.join(fitted.select(*keep), replicate, "left")
    return joined.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__d_{c}") for c in columns}).select(*df.columns)


def median_indicator(
    df: DataFrame, columns: Sequence[str], replicate: str = "replicate", draws: str = "draws"
) -> DataFrame:
    """In-bag median imputation with 0/1 missingness indicators per replicate.

    A column without any in-bag value is filled with 0. ``<c>_missing`` is null for a
    replicate in which the column is complete on both sides (the indicator is not kept).
    """
    bag = df.filter(F.col(draws) > 0).select(
        replicate, F.explode(F.sequence(F.lit(1), F.col(draws).cast("int"))).alias("__copy"), *columns
    )
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    long = bag.select(replicate, F.explode(F.array(*cells)).alias("c")).select(replicate, "c.column", "c.value")
    medians = grouped_quantiles(long, [replicate, "column"], "value", {"median": 0.5})
    fills = medians.groupBy(replicate).agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"__f_{c}") for c in columns]
    )
    holes = df.groupBy(replicate).agg(*[F.max(F.col(c).isNull().cast("int")).alias(f"__h_{c}") for c in columns])
    joined = df.join(fills, replicate, "left").join(holes, replicate)
    new: dict[str, Column] = {}
    for c in columns:
        new[f"{c}_missing"] = F.when(F.col(f"__h_{c}") == 1, F.col(c).isNull().cast("int"))
    joined = joined.withColumns(new)
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__f_{c}"), F.lit(0.0)) for c in columns})
    return joined.drop(*[f"__{k}_{c}" for c in columns for k in ("f", "h")])


def winsorised_scale(clean: DataFrame, columns: Sequence[str], tails: tuple[float, float] = (0.001, 0.999)) -> dict[str, float]:
    """Sample deviation of each column after clipping to its outer percentiles."""
    edges = column_quantiles(clean, list(columns), list(tails))
    clipped = [
        F.stddev_samp(F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c))))).alias(c)
        for c, (lo, hi) in edges.items()
        if lo is not None
    ]
    row = clean.agg(*clipped).collect()[0]
    return row.asDict()


def unit_interval(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def predicted_class(score: Column) -> Column:
    """1 above one half; a score of exactly one half is 0."""
    return (score > 0.5).cast("int")


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
