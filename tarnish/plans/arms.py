"""Comparison and substitution of arms (pipelines run on the same replicates)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SWAP_TIE = 0.002


def replace_rows(published: DataFrame, other: DataFrame, models: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """Drop the published rows of some models and levels and put the other arm's in.

    Columns the other arm lacks come out null.
    """
    mine = F.col("model").isin(list(models)) & F.col("level").isin(list(levels))
    kept = published.filter(~mine)
    return kept.unionByName(other.filter(mine), allowMissingColumns=True).select(*published.columns)


def wide_arms(
    results: DataFrame, arms: tuple[str, str], metrics: Sequence[str], keys: Sequence[str] = ("dimension", "model", "replicate")
) -> DataFrame:
    """One row per key with each metric under both arms and the difference second - first.

    Keys that only one arm has are dropped. Both arms are read in one aggregation.
    """
    first, second = arms
    picks = []
    for m in metrics:
        picks.append(F.max(F.when(F.col("arm") == first, F.col(m))).alias(f"{m}_first"))
        picks.append(F.max(F.when(F.col("arm") == second, F.col(m))).alias(f"{m}_second"))
    both = results.filter(F.col("arm").isin(first, second)).groupBy(*keys).agg(
        F.count_distinct("arm").alias("__arms"), *picks
    )
    gaps = [(F.col(f"{m}_second") - F.col(f"{m}_first")).alias(f"d_{m}") for m in metrics]
    return both.filter(F.col("__arms") == 2).select(
        *keys, *[f"{m}_{side}" for m in metrics for side in ("first", "second")], *gaps
    )


def arm_means(wide: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model", "dimension")) -> DataFrame:
    return wide.groupBy(*keys).agg(*[F.avg(f"{m}_{s}").alias(f"{m}_{s}") for m in metrics for s in ("first", "second")])


def reproduced(ours: DataFrame, published: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Largest absolute gap per model between re-run and published rows, with a verdict."""
    theirs = published.select(*keys, *[F.col(m).alias(f"__p_{m}") for m in metrics])
    worst = F.greatest(*[F.abs(F.col(m) - F.col(f"__p_{m}")) for m in metrics], F.lit(0.0))
    out = ours.join(theirs, list(keys)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max(worst).alias("worst_gap"))
    label = F.when(F.col("worst_gap") < 1e-6, F.lit("equal")).when(F.col("worst_gap") < 5e-3, F.lit("close")).otherwise(F.lit("differs"))
    return out.withColumn("agreement", label)


def rank_swaps(means: DataFrame, metrics: Mapping[str, str], n_dims: int, tie: float = SWAP_TIE) -> DataFrame:
    """Neighbours in the first arm's ranking whose order the second arm turns round.

    Rank 0 is the least damaging dimension. Each swap carries the gaps under both arms,
    whether either of them exceeds the tie threshold, and where in the ranking it sits.
    """
    cells = []
    for m, direction in metrics.items():
        harm = -1.0 if direction == "higher" else 1.0
        cells.append(
            F.struct(
                F.lit(m).alias("metric"),
                (F.lit(harm) * F.col(f"{m}_first")).alias("first"),
                (F.lit(harm) * F.col(f"{m}_second")).alias("second"),
            )
        )
    long = means.select("model", "dimension", F.explode(F.array(*cells)).alias("m")).select("model", "dimension", "m.*")
    by_first = Window.partitionBy("metric", "model").orderBy("first", "dimension")
    by_second = Window.partitionBy("metric", "model").orderBy("second", "dimension")
    ranked = long.withColumn("rank", F.row_number().over(by_first) - 1).withColumn(
        "rank_second", F.row_number().over(by_second) - 1
    )
    nxt = {c: F.lead(c).over(by_first) for c in ("dimension", "first", "second", "rank_second")}
    paired = ranked.withColumns({f"next_{c}": v for c, v in nxt.items()})
    gap1, gap2 = F.abs(F.col("next_first") - F.col("first")), F.abs(F.col("next_second") - F.col("second"))
    place = (
        F.when(F.col("rank") == 0, F.lit("least damaging end"))
        .when(F.col("rank") == n_dims - 2, F.lit("most damaging end"))
        .otherwise(F.lit("middle"))
    )
    return paired.filter(F.col("rank_second") > F.col("next_rank_second")).select(
        "metric", "model", F.col("dimension").alias("lost"), F.col("next_dimension").alias("won"), "rank",
        gap1.alias("gap_first"), gap2.alias("gap_second"),
        (F.greatest(gap1, gap2) > tie).alias("beyond_tie"), place.alias("place"),
    )
