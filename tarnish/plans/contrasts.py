"""Pairwise contrasts between dimensions: signed rank, Holm, percentile interval."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnish.functions.tails import two_sided_p
from tarnish.operators.ordering import grouped_quantiles, prefix_sums

EXACT_PAIRS = 50
ALPHA = 0.05


def by_dimension(loss: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """One row per (keys, model, replicate), one column per dimension; duplicates averaged."""
    values = [F.avg(F.when(F.col("dimension") == d, F.col("loss"))).alias(f"loss_{d}") for d in dims]
    return loss.groupBy(*keys, "model", "replicate").agg(*values)


def differences(wide: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Per replicate the difference of every pair of dimensions that are both there."""
    cells = [
        F.struct(F.lit(a).alias("dim_A"), F.lit(b).alias("dim_B"), (F.col(f"loss_{a}") - F.col(f"loss_{b}")).alias("diff"))
        for a, b in combinations(dims, 2)
    ]
    return (
        wide.select(*keys, "model", "replicate", F.explode(F.array(*cells)).alias("d"))
        .select(*keys, "model", "replicate", "d.*")
        .filter(F.col("diff").isNotNull())
    )


def rank_sum(df: DataFrame, groups: Sequence[str], value: str, flag: Column, **size) -> DataFrame:
    """Sum of average-tie ranks of the flagged rows in each group.

    Ties are collapsed before ranks are formed. Returns n_ranked, n_flag, rank_sum and
    tie_term (sum of t^3 - t over tied values).
    """
    tied = df.groupBy(*groups, F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(flag.cast("long")).alias("__flagged")
    )
    placed = prefix_sums(tied, list(groups), "__v", ["__n"], **size)
    t = F.col("__n").cast("double")
    return placed.groupBy(*groups).agg(
        F.sum("__n").alias("n_ranked"),
        F.sum("__flagged").alias("n_flag"),
        F.sum(F.col("__flagged") * (F.col("before___n") + (t + 1) / 2)).alias("rank_sum"),
        F.sum(t * t * t - t).alias("tie_term"),
    )


def signed_rank_table(spark, max_n: int = EXACT_PAIRS) -> DataFrame:
    """Null distribution of the signed-rank statistic: P(T <= t) for n up to ``max_n``."""
    counts, rows = [1.0], []
    for n in range(1, max_n + 1):
        longer = counts + [0.0] * n
        for s, c in enumerate(counts):
            longer[s + n] += c
        counts, running = longer, 0.0
        for s, c in enumerate(counts[: n * (n + 1) // 4 + 1]):
            running += c
            rows.append((n, float(s), running / 2.0**n))
    return spark.createDataFrame(rows, "x_n long, x_stat double, x_cdf double")


def signed_rank(diffs: DataFrame, groups: Sequence[str], **size) -> DataFrame:
    """Two-sided signed-rank test per group over the column ``diff``.

    Zero differences are dropped. Up to 50 differences without zeros or ties take the
    exact distribution, all others the normal approximation with the tie correction.
    """
    moved = diffs.filter(F.col("diff") != 0).withColumn("__size", F.abs(F.col("diff")))
    ranks = rank_sum(moved, groups, "__size", F.col("diff") > 0, **size)
    n = F.col("n_ranked").cast("double")
    total = n * (n + 1) / 2
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24)
    stat = F.least(F.col("rank_sum"), total - F.col("rank_sum"))
    tested = ranks.select(
        *groups,
        F.col("n_ranked").alias("n_moved"),
        stat.alias("wilcoxon_stat"),
        two_sided_p((stat - total / 2) / spread).alias("p_normal"),
        (F.col("tie_term") == 0).alias("untied"),
    )
    table = F.broadcast(signed_rank_table(diffs.sparkSession))
    return tested.join(
        table, (F.col("n_moved") == F.col("x_n")) & (F.col("wilcoxon_stat") == F.col("x_stat")), "left"
    ).select(*groups, "n_moved", "wilcoxon_stat", "p_normal", "untied", F.least(2 * F.col("x_cdf"), F.lit(1.0)).alias("p_exact"))


def holm(df: DataFrame, family: Sequence[str], p: str = "p_raw", out: str = "p_holm") -> DataFrame:
    """Step-down adjustment inside each family; null p-values neither count nor change."""
    by_p = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    n = F.count(p).over(Window.partitionBy(*family))
    step = (n - F.row_number().over(by_p) + 1) * F.col(p)
    upto = by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = df.withColumn("__step", step)
    running = F.max("__step").over(upto)
    return stepped.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("__step")


def pairwise_contrasts(
    loss: DataFrame,
    dims: Sequence[str],
    models: Sequence[str],
    keys: Sequence[str] = ("metric",),
) -> DataFrame:
    """All pairs of dimensions per model: median difference, interval, test, agreement.

    ``loss`` is restricted to the level(s) of interest beforehand. Pairs of dimensions
    without data come out with ``n_pairs`` 0 and nulls; fewer than two pairs give nulls.
    """
    keys = list(keys)
    diffs = differences(by_dimension(loss, keys, dims), keys, dims)
    groups = [*keys, "model", "dim_A", "dim_B"]
    shape = diffs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("diff") > 0).alias("n_up"),
        F.count_if(F.col("diff") < 0).alias("n_down"),
    )
    probs = {"median_diff": 0.5, "pct2_5": 0.025, "pct97_5": 0.975}
    spread = grouped_quantiles(diffs, groups, "diff", probs)
    tests = signed_rank(diffs, groups)
    cells = [
        F.struct(F.lit(m).alias("model"), F.lit(a).alias("dim_A"), F.lit(b).alias("dim_B"))
        for m in models
        for a, b in combinations(dims, 2)
    ]
    frame = loss.select(*keys).distinct().select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    joined = frame
    for part in (shape, spread, tests):
        joined = joined.join(part, groups, "left")
    joined = joined.withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    enough = F.col("n_pairs") >= 2
    exact = (F.col("n_moved") == F.col("n_pairs")) & F.col("untied") & (F.col("n_moved") <= EXACT_PAIRS)
    p = F.when(exact, F.col("p_exact")).otherwise(F.col("p_normal"))
    n_agree = F.when(F.col("median_diff") > 0, F.col("n_up")).otherwise(F.col("n_down"))
    tested = joined.select(
        *groups,
        "n_pairs",
        *[F.when(enough, F.col(c)).alias(c) for c in ("median_diff", "pct2_5", "pct97_5", "wilcoxon_stat")],
        F.when(enough, p).alias("p_raw"),
        F.coalesce(n_agree, F.lit(0)).alias("n_agree"),
    )
    adjusted = holm(tested, [*keys, "model"])
    excludes = F.coalesce((F.col("pct2_5") > 0) | (F.col("pct97_5") < 0), F.lit(False))
    return adjusted.select(
        "*",
        excludes.alias("ci_excludes_zero"),
        (F.col("n_agree") / F.nullif(F.col("n_pairs"), F.lit(0))).alias("share"),
        F.coalesce((F.col("p_holm") < ALPHA) & excludes, F.lit(False)).alias("separable"),
    )


def pair_order(contrasts: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Pairs of dimensions with their mean absolute median difference across models."""
    return contrasts.groupBy(*keys, "dim_A", "dim_B").agg(F.avg(F.abs("median_diff")).alias("mean_abs_median"))


def gap_to_others(
    loss: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("metric",)
) -> DataFrame:
    """Median over replicates of a dimension's loss minus the mean loss of the others."""
    keys = list(keys)
    wide = by_dimension(loss, keys, dims)
    present = reduce(lambda a, b: a + b, [F.when(F.col(f"loss_{d}").isNotNull(), 1).otherwise(0) for d in dims])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"loss_{d}"), F.lit(0.0)) for d in dims])
    cells = []
    for d in dims:
        others = (F.col("__total") - F.col(f"loss_{d}")) / F.nullif(F.col("__present") - 1, F.lit(0))
        cells.append(F.struct(F.lit(d).alias("dimension"), (F.col(f"loss_{d}") - others).alias("gap")))
    long = (
        wide.withColumns({"__total": total, "__present": present})
        .select(*keys, "model", F.explode(F.array(*cells)).alias("g"))
        .select(*keys, "model", "g.*")
        .filter(F.col("gap").isNotNull())
    )
    return grouped_quantiles(long, [*keys, "model", "dimension"], "gap", {"gap": 0.5})


def sided(contrasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wins and losses of every dimension over the separable contrasts of a model."""
    ahead = F.col("median_diff") > 0
    winner = F.when(ahead, F.col("dim_A")).otherwise(F.col("dim_B"))
    loser = F.when(ahead, F.col("dim_B")).otherwise(F.col("dim_A"))
    one = F.col("separable").cast("int")
    cells = F.array(
        F.struct(winner.alias("dimension"), one.alias("win"), F.lit(0).alias("loss")),
        F.struct(loser.alias("dimension"), F.lit(0).alias("win"), one.alias("loss")),
    )
    return (
        contrasts.select(*keys, "model", F.explode(cells).alias("s"))
        .groupBy(*keys, "model", "s.dimension")
        .agg(F.sum("s.win").alias("wins"), F.sum("s.loss").alias("losses"))
    )


def verdicts(contrasts: DataFrame, gaps: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Most and least damaging dimensions per model.

    Most: a separable win, no separable loss, and a loss above the mean of the others;
    least is the mirror image.
    """
    on = [*keys, "model", "dimension"]
    scored = sided(contrasts, keys).join(gaps, on, "left")
    most = (F.col("wins") > 0) & (F.col("losses") == 0) & (F.col("gap") > 0)
    least = (F.col("losses") > 0) & (F.col("wins") == 0) & (F.col("gap") < 0)
    return scored.select(
        *on, "wins", "losses", "gap",
        F.coalesce(most, F.lit(False)).alias("is_most"),
        F.coalesce(least, F.lit(False)).alias("is_least"),
    )


def families(verdict: DataFrame, roles: dict[str, str], keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Roll verdicts up: "all" if every model agrees, else the family whose models all do.

    ``roles`` maps each model to its family. A model without a verdict row counts against.
    """
    size: dict[str, int] = {}
    for family in roles.values():
        size[family] = size.get(family, 0) + 1
    role = reduce(lambda acc, m: F.when(F.col("model") == m, F.lit(roles[m])).otherwise(acc), roles, F.lit(None))
    flags = F.array(
        F.struct(F.lit("most").alias("kind"), F.col("is_most").alias("yes")),
        F.struct(F.lit("least").alias("kind"), F.col("is_least").alias("yes")),
    )
    long = (
        verdict.select(*keys, "dimension", "model", role.alias("family"), F.explode(flags).alias("f"))
        .filter(F.col("f.yes") & F.col("family").isNotNull())
        .groupBy(*keys, "dimension", "f.kind", "family")
        .agg(F.count_distinct("model").alias("__n"))
    )
    full = reduce(lambda acc, f: F.when(F.col("family") == f, F.lit(size[f])).otherwise(acc), size, F.lit(None))
    agreed = long.filter(F.col("__n") == full)
    return (
        agreed.groupBy(*keys, "dimension", "kind")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("family").alias("family"))
        .select(*keys, "dimension", "kind", F.when(F.col("__n") == len(size), F.lit("all")).otherwise(F.col("family")).alias("family"))
    )


def leaders(contrasts: DataFrame, present: DataFrame, dims: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Dimension most often on the damaging side per key, ties by the order of ``dims``.

    ``present`` lists (keys, model) with data in every dimension; other models are left out.
    """
    whole = contrasts.join(present, [*keys, "model"], "left_semi")
    order = reduce(lambda acc, i: F.when(F.col("dimension") == dims[i], F.lit(i)).otherwise(acc), range(len(dims)), F.lit(None))
    counted = sided(whole, keys).groupBy(*keys, "dimension").agg(F.sum("wins").alias("wins"))
    return counted.groupBy(*keys).agg(
        F.max_by("dimension", F.struct(F.col("wins"), -order)).alias("leader"), F.sum("wins").alias("n_separable")
    )


def complete_models(loss: DataFrame, dims: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, model) that have losses in every dimension."""
    return (
        loss.filter(F.col("dimension").isin(list(dims)))
        .groupBy(*keys, "model")
        .agg(F.count_distinct("dimension").alias("__n"))
        .filter(F.col("__n") == len(dims))
        .drop("__n")
    )


def stable_rows(by_level: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Whether a key keeps the same leader at every level."""
    return by_level.groupBy(*keys).agg((F.count_distinct("leader") == 1).alias("stable"))


def verdict_counts(verdict_families: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many rows name each dimension as most or least damaging ("none" names nobody)."""
    return verdict_families.groupBy(*keys, "kind", "dimension").agg(
        F.count_if(F.col("family") != "none").alias("n_named")
    )
