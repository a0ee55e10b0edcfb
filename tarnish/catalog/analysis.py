"""Losses, contrasts and verdicts on the derived grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.data import round_col, rounded
from tarnish.catalog.grid import DIMS, DIRECTIONS, LEVELS, LOSS_SQL, MODELS, ROLES, SHIFTED_LOSS_SQL, grid, grid_sql
from tarnish.functions.tails import STEP, TERMS
from tarnish.plans import contrasts as C
from tarnish.plans import losses as L
from tarnish.session import staged


def losses(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    return L.paired_loss(grid(spark, sf_dir, shifted=shifted), DIRECTIONS, digits=6)


def _shifted_at_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses at the highest level of the grid in which dimensions differ, computed once."""
    return staged(losses(spark, sf_dir, shifted=True).filter(F.col("level") == 3))


def _contrasts(spark: SparkSession, sf_dir: str, level: int = 3) -> DataFrame:
    at = losses(spark, sf_dir).filter(F.col("level") == level)
    return C.pairwise_contrasts(at, DIMS, MODELS)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _shifted_at_3(spark, sf_dir)
    return C.verdicts(C.pairwise_contrasts(at, DIMS, MODELS), C.gap_to_others(at, DIMS))


def paired_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses(spark, sf_dir).withColumn("level", L.level_label().cast("string"))


def loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and percentile interval of the loss per metric, dimension and level."""
    groups = ["metric", "dimension", "level"]
    probs = {"median": 0.5, "low": 0.025, "high": 0.975}
    loss = losses(spark, sf_dir)
    mean = loss.groupBy(*groups).agg(F.count("loss").alias("n"), F.avg("loss").alias("mean"))
    spread = L.grouped_quantiles(loss, groups, "loss", probs)
    joined = mean.join(spread, groups)
    return joined.select(*groups, "n", round_col(F.col("mean"), 5).alias("mean"), *[round_col(F.col(c), 9).alias(c) for c in probs])


def loss_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loss_coverage(losses(spark, sf_dir), len(DIMS), len(MODELS), len(LEVELS))


def pairwise_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _contrasts(spark, sf_dir)
    real = ["median_diff", "pct2_5", "pct97_5", "wilcoxon_stat", "p_raw", "p_holm", "share"]
    return df.select(
        "metric", "model", "dim_A", "dim_B", "n_pairs", "n_agree", "ci_excludes_zero", "separable",
        *[round_col(F.col(c), 9 if c in real[:3] else 6).alias(c) for c in real],
    )


def pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.pair_order(_contrasts(spark, sf_dir))
    return df.withColumn("mean_abs_median", round_col(F.col("mean_abs_median"), 5))


def sign_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates on the side of the median difference, at every level."""
    loss = losses(spark, sf_dir)
    df = C.pairwise_contrasts(loss, DIMS, MODELS, ["metric", "level"])
    return df.select("metric", "level", "model", "dim_A", "dim_B", "n_agree", "n_pairs")


def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjustment of one share per (model, dimension, level), one family per model:
    the share of order lines with a quantity of 10 or less."""
    from tarnish.catalog.grid import lines

    few = F.count_if(F.col("units") <= 10) / F.count(F.lit(1))
    shares = lines(spark, sf_dir).groupBy("model", "dimension", "level").agg(few.alias("p_raw"))
    out = C.holm(shares.withColumn("p_raw", F.col("p_raw") / 20), ["model"])
    return out.select("model", "dimension", "level", *[F.round(c, 9).alias(c) for c in ("p_raw", "p_holm")])


def gap_to_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.gap_to_others(_shifted_at_3(spark, sf_dir), DIMS)
    return df.withColumn("gap", round_col(F.col("gap"), 9))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).withColumn("gap", round_col(F.col("gap"), 9))


def verdict_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which dimension costs most and least, and for which family of models.

    Families are joined to the full list of metrics, dimensions and kinds, so that
    dimensions nobody names show up as "none".
    """
    named = C.families(_verdicts(spark, sf_dir), ROLES)
    cells = [
        F.struct(F.lit(m).alias("metric"), F.lit(d).alias("dimension"), F.lit(k).alias("kind"))
        for m in DIRECTIONS
        for d in DIMS
        for k in ("most", "least")
    ]
    frame = spark.range(1).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    joined = frame.join(named, ["metric", "dimension", "kind"], "left")
    return joined.withColumn("family", F.coalesce("family", F.lit("none")))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.verdict_counts(verdict_families(spark, sf_dir))


def leader_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading dimension at each level, and whether it is the same at all of them."""
    loss = staged(losses(spark, sf_dir, shifted=True))
    keys = ["metric", "level"]
    df = C.pairwise_contrasts(loss, DIMS, MODELS, keys)
    led = C.leaders(df, C.complete_models(loss, DIMS, keys), DIMS, keys)
    return led.join(C.stable_rows(led), "metric")


def raw_metric_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from the metric itself at the highest level, without a clean baseline."""
    at = L.raw_loss(grid(spark, sf_dir, shifted=True).filter(F.col("level") == 3), DIRECTIONS)
    at = staged(at.withColumn("loss", F.round("loss", 6)))
    df = C.verdicts(C.pairwise_contrasts(at, DIMS, MODELS), C.gap_to_others(at, DIMS))
    return df.withColumn("gap", round_col(F.col("gap"), 9))


def metric_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = {"qty": (20.0, 30.0)}
    df = L.metric_band(grid(spark, sf_dir), ["price", "qty"], ["model", "dimension", "level"], clip)
    return df.select("model", "dimension", "level", "metric", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


def effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.effect_size(losses(spark, sf_dir), ["metric", "dimension"])
    return df.select("metric", "dimension", "n_pairs", *[round_col(F.col(c), 9).alias(c) for c in ("median", "low", "high")])


def effect_size_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from results in which every row came twice, the second time with other values."""
    once = grid(spark, sf_dir).withColumn("run", F.lit(1))
    again = once.withColumns({"run": F.lit(2), "price": F.col("price") * 2, "qty": F.col("qty") + 5})
    first = L.first_pairs(once.unionByName(again), [], "run").drop("run")
    df = L.effect_size(L.paired_loss(first, DIRECTIONS, digits=6), ["metric", "dimension"])
    return df.select("metric", "dimension", "n_pairs", *[round_col(F.col(c), 9).alias(c) for c in ("median", "low", "high")])


def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.relative_change(grid(spark, sf_dir), DIRECTIONS)
    return df.select("model", "dimension", "metric", *[round_col(F.col(c), 5).alias(c) for c in ("mean_change", "loss_pct")])


# ------------------------------------------------------------------ oracle text


def erfc_sql(x: str) -> str:
    terms = " + ".join(f"exp(-{(n * STEP) ** 2}::DOUBLE) / ({(n * STEP) ** 2}::DOUBLE + {x} * {x})" for n in range(1, TERMS + 1))
    body = f"{2 * STEP / math.pi!r}::DOUBLE * {x} * exp(-{x} * {x}) * (0.5::DOUBLE / ({x} * {x}) + {terms})"
    pole = f"2.0::DOUBLE / (1.0::DOUBLE - exp({2 * math.pi / STEP!r}::DOUBLE * least({x}, 7.0::DOUBLE)))"
    series = f"1.0::DOUBLE - {2 / math.sqrt(math.pi)!r}::DOUBLE * ({x} - {x} * {x} * {x} / 3.0 + {x} * {x} * {x} * {x} * {x} / 10.0)"
    return f"CASE WHEN {x} < 1e-3 THEN {series} WHEN {x} < {math.pi / STEP!r} THEN {body} + {pole} ELSE {body} END"


PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[i + 1 :]]


def contrast_sql(loss: str, keys: list[str]) -> str:
    """CTEs from ``loss`` (already at the wanted level) to ``contrast``.

    Groups of 50 or fewer differences without ties use the exact distribution, built by
    a recursive count of signed sums.
    """
    k = ", ".join(keys)
    frame = " UNION ALL ".join(f"SELECT '{a}' AS dim_A, '{b}' AS dim_B" for a, b in PAIRS)
    models = " UNION ALL ".join(f"SELECT '{m}' AS model" for m in MODELS)
    on = ", ".join([*keys, "model", "dim_A", "dim_B"])
    return f"""mean_loss AS (
  SELECT {k}, model, replicate, dimension, avg(loss) AS loss FROM {loss} GROUP BY {k}, model, replicate, dimension),
diffs AS (
  SELECT {', '.join('a.' + x for x in keys)}, a.model, a.replicate, a.dimension AS dim_A, b.dimension AS dim_B, a.loss - b.loss AS diff
  FROM mean_loss a JOIN mean_loss b USING ({k}, model, replicate) WHERE a.dimension < b.dimension),
shape AS (
  SELECT {on}, count(*) AS n_pairs, count(*) FILTER (diff > 0) AS n_up, count(*) FILTER (diff < 0) AS n_down,
         quantile_cont(diff, 0.5) AS median_diff, quantile_cont(diff, 0.025) AS pct2_5, quantile_cont(diff, 0.975) AS pct97_5
  FROM diffs GROUP BY {on}),
ranks AS (
  SELECT *, rank() OVER (PARTITION BY {on} ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY {on}, abs(diff)) - 1) / 2.0::DOUBLE AS r,
         count(*) OVER (PARTITION BY {on}, abs(diff)) AS t
  FROM diffs WHERE diff <> 0),
sums AS (
  SELECT {on}, count(*)::DOUBLE AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w, sum(t * t - 1)::DOUBLE AS ties
  FROM ranks GROUP BY {on}),
stats AS (
  SELECT {on}, n, ties, least(w, n * (n + 1) / 2 - w) AS wilcoxon_stat,
    abs(least(w, n * (n + 1) / 2 - w) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) / sqrt(2.0::DOUBLE) AS x
  FROM sums),
frame AS (SELECT * FROM (SELECT DISTINCT {k} FROM {loss}), ({models}), ({frame})),
tested AS (
  SELECT f.*, coalesce(s.n_pairs, 0) AS n_pairs, s.n_up, s.n_down, s.median_diff AS md,
    CASE WHEN s.n_pairs >= 2 THEN s.median_diff END AS median_diff, CASE WHEN s.n_pairs >= 2 THEN s.pct2_5 END AS pct2_5,
    CASE WHEN s.n_pairs >= 2 THEN s.pct97_5 END AS pct97_5, CASE WHEN s.n_pairs >= 2 THEN t.wilcoxon_stat END AS wilcoxon_stat,
    CASE WHEN s.n_pairs < 2 THEN NULL
         WHEN t.n = s.n_pairs AND t.ties = 0 AND t.n <= 50 THEN least(1.0, 2 * (SELECT sum(c) FROM signed_sums z WHERE z.n = t.n AND z.s <= t.wilcoxon_stat) / pow(2, t.n))
         ELSE {erfc_sql('t.x')} END AS p_raw
  FROM frame f LEFT JOIN shape s USING ({on}) LEFT JOIN stats t USING ({on})),
stepped AS (
  SELECT *, (count(p_raw) OVER (PARTITION BY {k}, model) - row_number() OVER (PARTITION BY {k}, model ORDER BY p_raw NULLS LAST) + 1) * p_raw AS step
  FROM tested),
contrast AS (
  SELECT *, CASE WHEN p_raw IS NOT NULL THEN least(1.0, max(step) OVER (PARTITION BY {k}, model ORDER BY p_raw NULLS LAST ROWS UNBOUNDED PRECEDING)) END AS p_holm,
    coalesce(CASE WHEN md > 0 THEN n_up ELSE n_down END, 0) AS n_agree,
    coalesce(pct2_5 > 0 OR pct97_5 < 0, FALSE) AS ci_excludes_zero
  FROM stepped),
sep AS (SELECT *, coalesce(p_holm < 0.05 AND ci_excludes_zero, FALSE) AS separable FROM contrast)"""


SIGNED_SUMS = """RECURSIVE signed_sums(n, s, c) AS (
  SELECT 1, 0, 1.0::DOUBLE UNION ALL SELECT 1, 1, 1.0::DOUBLE
  UNION ALL
  SELECT n + 1, s + step * (n + 1), sum(c) FROM signed_sums, (SELECT 0 AS step UNION ALL SELECT 1) WHERE n < 50 GROUP BY 1, 2)"""

# one statement: counts of signed sums, grid, losses at the highest level, contrasts
RECURSIVE = f"WITH {SIGNED_SUMS},\n{LOSS_SQL},\n"
AT3_SQL = f"{RECURSIVE}at3 AS (SELECT * FROM loss WHERE level = 3),\n{contrast_sql('at3', ['metric'])}"


def verdict_sql(loss: str) -> str:
    return f"""others AS (
  SELECT metric, model, replicate, dimension, loss,
         (sum(loss) OVER w - loss) / nullif(count(loss) OVER w - 1, 0) AS rest
  FROM mean_loss WINDOW w AS (PARTITION BY metric, model, replicate)),
gaps AS (SELECT metric, model, dimension, quantile_cont(loss - rest, 0.5) AS gap FROM others WHERE rest IS NOT NULL GROUP BY metric, model, dimension),
sides AS (
  SELECT metric, model, CASE WHEN median_diff > 0 THEN dim_A ELSE dim_B END AS dimension, separable::INT AS win, 0 AS lose FROM sep
  UNION ALL
  SELECT metric, model, CASE WHEN median_diff > 0 THEN dim_B ELSE dim_A END, 0, separable::INT FROM sep),
scored AS (SELECT metric, model, dimension, sum(win)::BIGINT AS wins, sum(lose)::BIGINT AS losses FROM sides GROUP BY metric, model, dimension),
verdict AS (
  SELECT s.*, gap, coalesce(wins > 0 AND losses = 0 AND gap > 0, FALSE) AS is_most, coalesce(losses > 0 AND wins = 0 AND gap < 0, FALSE) AS is_least
  FROM scored s LEFT JOIN gaps USING (metric, model, dimension))"""


SHIFTED = f"WITH {SIGNED_SUMS},\n{SHIFTED_LOSS_SQL},\n"
VERDICT_SQL = f"{SHIFTED}at3 AS (SELECT * FROM loss WHERE level = 3),\n{contrast_sql('at3', ['metric'])},\n{verdict_sql('at3')}"
FAMILY_CTES = """kinds AS (
  SELECT metric, dimension, model, 'most' AS kind, is_most AS yes FROM verdict
  UNION ALL SELECT metric, dimension, model, 'least', is_least FROM verdict),
agreed AS (
  SELECT metric, dimension, kind, count(*) FILTER (yes AND model IN ('A', 'N')) = 2 AS trees, count(*) FILTER (yes AND model = 'R') = 1 AS linear
  FROM kinds GROUP BY metric, dimension, kind),
named AS (
  SELECT metric, dimension, kind,
    CASE WHEN trees AND linear THEN 'all' WHEN trees THEN 'trees' WHEN linear THEN 'linear' ELSE 'none' END AS family
  FROM agreed)"""

QUERIES = {
    "paired_loss": paired_loss,
    "loss_summary": loss_summary,
    "loss_coverage": loss_coverage,
    "pairwise_contrasts": pairwise_contrasts,
    "pair_order": pair_order,
    "sign_agreement": sign_agreement,
    "holm_adjust": holm_adjust,
    "gap_to_others": gap_to_others,
    "verdicts": verdicts,
    "verdict_families": verdict_families,
    "verdict_counts": verdict_counts,
    "leader_by_level": leader_by_level,
    "raw_metric_verdicts": raw_metric_verdicts,
    "metric_band": metric_band,
    "effect_size": effect_size,
    "effect_size_first": effect_size_first,
    "relative_change": relative_change,
}

ORACLES = {
    "paired_loss": f"WITH {LOSS_SQL} SELECT metric, dimension, model, replicate, loss, concat('0.', level) AS level FROM loss",
    "loss_summary": f"""WITH {LOSS_SQL} SELECT metric, dimension, level, count(loss) AS n, {rounded('avg(loss)', 5)} AS mean,
  {rounded('quantile_cont(loss, 0.5)', 9)} AS median, {rounded('quantile_cont(loss, 0.025)', 9)} AS low,
  {rounded('quantile_cont(loss, 0.975)', 9)} AS high FROM loss GROUP BY metric, dimension, level""",
    "loss_coverage": f"""WITH {LOSS_SQL} SELECT metric, count(*) AS n_observed, count(DISTINCT replicate) * 45 AS n_expected,
  count(*) = count(DISTINCT replicate) * 45 AS complete FROM loss GROUP BY metric""",
    "pairwise_contrasts": f"""{AT3_SQL} SELECT metric, model, dim_A, dim_B, n_pairs, n_agree, ci_excludes_zero, separable,
  {rounded('median_diff', 9)} AS median_diff, {rounded('pct2_5', 9)} AS pct2_5, {rounded('pct97_5', 9)} AS pct97_5,
  {rounded('wilcoxon_stat')} AS wilcoxon_stat, {rounded('p_raw')} AS p_raw, {rounded('p_holm')} AS p_holm,
  {rounded('n_agree::DOUBLE / nullif(n_pairs, 0)')} AS share FROM sep""",
    "pair_order": f"{AT3_SQL} SELECT metric, dim_A, dim_B, {rounded('avg(abs(median_diff))', 5)} AS mean_abs_median FROM sep GROUP BY metric, dim_A, dim_B",
    "sign_agreement": f"""{RECURSIVE}{contrast_sql('loss', ['metric', 'level'])}
  SELECT metric, level, model, dim_A, dim_B, n_agree, n_pairs FROM sep""",
    "holm_adjust": f"""WITH {grid_sql()},
shares AS (SELECT model, dimension, level, (count(*) FILTER (units <= 10))::DOUBLE / count(*) / 20 AS p_raw FROM lines GROUP BY model, dimension, level),
stepped AS (SELECT *, (count(*) OVER (PARTITION BY model) - row_number() OVER (PARTITION BY model ORDER BY p_raw) + 1) * p_raw AS step FROM shares)
SELECT model, dimension, level, round(p_raw, 9) AS p_raw,
  round(least(1.0, max(step) OVER (PARTITION BY model ORDER BY p_raw ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM stepped""",
    "gap_to_others": f"{VERDICT_SQL} SELECT metric, model, dimension, {rounded('gap', 9)} AS gap FROM gaps",
    "verdicts": f"{VERDICT_SQL} SELECT metric, model, dimension, wins, losses, {rounded('gap', 9)} AS gap, is_most, is_least FROM verdict",
    "verdict_families": f"{VERDICT_SQL},\n{FAMILY_CTES} SELECT * FROM named",
    "verdict_counts": f"{VERDICT_SQL},\n{FAMILY_CTES} SELECT kind, dimension, count(*) FILTER (family <> 'none') AS n_named FROM named GROUP BY kind, dimension",
    "leader_by_level": f"""{SHIFTED}{contrast_sql('loss', ['metric', 'level'])},
present AS (SELECT metric, level, model FROM loss GROUP BY metric, level, model HAVING count(DISTINCT dimension) = 5),
sides AS (
  SELECT metric, level, CASE WHEN median_diff > 0 THEN dim_A ELSE dim_B END AS dimension, separable::INT AS win FROM sep JOIN present USING (metric, level, model)
  UNION ALL SELECT metric, level, CASE WHEN median_diff > 0 THEN dim_B ELSE dim_A END, 0 FROM sep JOIN present USING (metric, level, model)),
wins AS (SELECT metric, level, dimension, sum(win) AS wins FROM sides GROUP BY metric, level, dimension),
led AS (SELECT metric, level, first(dimension ORDER BY wins DESC, dimension) AS leader, sum(wins)::BIGINT AS n_separable FROM wins GROUP BY metric, level),
steady AS (SELECT metric, count(DISTINCT leader) = 1 AS stable FROM led GROUP BY metric)
SELECT metric, level, leader, n_separable, stable FROM led JOIN steady USING (metric)""",
    "raw_metric_verdicts": f"""WITH {SIGNED_SUMS},\n{grid_sql(shifted=True)},
loss AS (SELECT 'price' AS metric, dimension, model, level, replicate, round(-price, 6) AS loss FROM grid WHERE level = 3
  UNION ALL SELECT 'qty', dimension, model, level, replicate, round(qty, 6) FROM grid WHERE level = 3),
{contrast_sql('loss', ['metric'])},
{verdict_sql('loss')}
SELECT metric, model, dimension, wins, losses, {rounded('gap', 9)} AS gap, is_most, is_least FROM verdict""",
    "metric_band": f"""WITH {grid_sql()},
long AS (SELECT model, dimension, level, 'price' AS metric, price AS v FROM grid UNION ALL SELECT model, dimension, level, 'qty', qty FROM grid),
band AS (SELECT model, dimension, level, metric, avg(v) AS mean, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM long GROUP BY ALL)
SELECT model, dimension, level, metric, {', '.join(f"round(CASE WHEN metric = 'qty' THEN greatest(20.0, least(30.0, {c})) ELSE {c} END, 5) AS {c}" for c in ('mean', 'low', 'high'))} FROM band""",
    "effect_size": f"""WITH {LOSS_SQL} SELECT metric, dimension, count(loss) AS n_pairs, {rounded('quantile_cont(loss, 0.5)', 9)} AS median,
  {rounded('quantile_cont(loss, 0.025)', 9)} AS low, {rounded('quantile_cont(loss, 0.975)', 9)} AS high FROM loss WHERE level = 3 GROUP BY metric, dimension""",
    "relative_change": f"""WITH {grid_sql()},
wide AS (SELECT model, dimension, avg(price) FILTER (level = 0) AS p0, avg(price) FILTER (level = 3) AS p3,
  avg(qty) FILTER (level = 0) AS q0, avg(qty) FILTER (level = 3) AS q3 FROM grid GROUP BY model, dimension)
SELECT model, dimension, 'price' AS metric, {rounded('p3 - p0', 5)} AS mean_change, {rounded('-(p3 - p0) / abs(p0) * 100', 5)} AS loss_pct FROM wide
UNION ALL SELECT model, dimension, 'qty', {rounded('q3 - q0', 5)}, {rounded('(q3 - q0) / abs(q0) * 100', 5)} FROM wide""",
}
ORACLES["effect_size_first"] = ORACLES["effect_size"]
