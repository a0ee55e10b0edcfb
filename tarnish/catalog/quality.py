"""Checks, arms and the mixed model."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.analysis import losses
from tarnish.catalog.data import COHORT, COHORT_SQL, cohort, round_col, rounded, table
from tarnish.catalog.degradation import (
    COMPLETENESS_SQL,
    DENSITY,
    ORACLES as DEGRADED,
    SEED,
    UNIQUENESS_SQL,
    VALIDITY_SQL,
    precision_sql,
)
from tarnish.catalog.grid import DIMS, LEVELS, LOSS_SQL, MODELS, grid, grid_sql, lines
from tarnish.operators import checks, degrade, prep
from tarnish.plans import arms
from tarnish.plans import losses as L
from tarnish.plans import mixed_model as MM
from tarnish.session import staged, staged_alone

MEASURES = COHORT.numeric
DIMENSIONS = ["completeness", "coherence", "uniqueness", "validity", "precision"]


def _pairs(spark: SparkSession, sf_dir: str, columns: list[str]) -> dict[str, Callable[[], DataFrame]]:
    """Per dimension a function that makes the clean and the degraded value of every cell, side by side."""
    clean = staged(cohort(spark, sf_dir))

    def pairs(dim: str) -> DataFrame:
        return checks.side_by_side(degrade.OPERATORS[dim](clean, COHORT, DENSITY, SEED).work, columns)

    return {d: partial(pairs, d) for d in DIMENSIONS}


def change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised rate of every operator and whether it meets the requested one."""
    out = None
    for dim, pairs in _pairs(spark, sf_dir, COHORT.predictors).items():
        # one dimension after the other, so that the tables of only one lie in the staging folder
        rates = staged_alone(spark, lambda: checks.change_rate(pairs(), COHORT.predictors))
        checked = checks.rate_check(rates, DENSITY, dim in degrade.APPROXIMATE_RATE)
        row = checked.drop("target").withColumn("dimension", F.lit(dim))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("rate", F.round("rate", 9))


def severity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = prep.winsorised_scale(cohort(spark, sf_dir), MEASURES)
    df = checks.severity_profile(_pairs(spark, sf_dir, MEASURES), MEASURES, scale)
    return df.select("dimension", *[F.round(c, 6).alias(c) for c in df.columns if c != "dimension"])


def block_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.block_completeness(grid(spark, sf_dir), ["dimension", "model"])


def replicate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.replicate_coverage(grid(spark, sf_dir), ["dimension", "model"], [0, *LEVELS])


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned (dimension, level, replicate) of which not all models have both metrics."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(lv).alias("level")) for d in DIMS for lv in (0, *LEVELS)])
    planned = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("replicate"), F.explode(cells).alias("c"))
    keys = ["dimension", "level", "replicate"]
    done = checks.finished(grid(spark, sf_dir), keys, MODELS, ["price", "qty"])
    return checks.still_to_run(planned.select("c.*", "replicate"), done, keys)


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = grid(spark, sf_dir, "arm").drop("n")
    return rows.filter(F.col("arm") == "F").drop("arm"), rows.filter(F.col("arm") == "O").drop("arm")


def arm_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    published, other = _arms(spark, sf_dir)
    return arms.replace_rows(published, other, ["A"], [0, *LEVELS])


def arm_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and largest absolute difference between the arms per model."""
    wide = arms.wide_arms(grid(spark, sf_dir, "arm").filter(F.col("level") == 3), ("F", "O"), ["price", "qty"])
    medians = None
    for m in ("price", "qty"):
        part = L.grouped_quantiles(wide, ["model"], f"d_{m}", {f"median_{m}": 0.5})
        medians = part if medians is None else medians.join(part, "model")
    worst = wide.groupBy("model").agg(*[F.max(F.abs(f"d_{m}")).alias(f"worst_{m}") for m in ("price", "qty")])
    df = medians.join(worst, "model")
    return df.select("model", *[round_col(F.col(c), 7).alias(c) for c in df.columns if c != "model"])


def rank_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = arms.wide_arms(grid(spark, sf_dir, "arm"), ("F", "O"), ["price", "qty"], ["dimension", "model", "level", "replicate"])
    means = arms.arm_means(wide, ["price", "qty"])
    means = means.select("model", "dimension", *[F.round(f"{m}_{s}", 6).alias(f"{m}_{s}") for m in ("price", "qty") for s in ("first", "second")])
    df = arms.rank_swaps(means, {"price": "higher", "qty": "lower"}, len(DIMS))
    return df.select("*").withColumn("gap_first", F.round("gap_first", 6)).withColumn("gap_second", F.round("gap_second", 6))


def reproduced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst gap per model between the two arms, and its label."""
    first, second = _arms(spark, sf_dir)
    df = arms.reproduced(first, second, ["price", "qty"], ["dimension", "model", "level", "replicate"])
    return df.withColumn("worst_gap", F.round("worst_gap", 6))


def drift_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replacement of model A changes outside level 3: rows only one version has."""
    published, other = _arms(spark, sf_dir)
    replaced = arms.replace_rows(published, other, ["A"], [0, *LEVELS])
    diff = checks.drift(published, replaced, F.col("level") == 3)
    return diff.groupBy("side", "model").agg(F.count(F.lit(1)).alias("n"))


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per model and level: counted on the lines against summed over the grid. The claims for
    model A are one too high and one claim is about a model that is not there, so some must fail."""
    claim = F.concat_ws("/", "model", F.col("level").cast("string")).alias("claim_id")
    claims = lines(spark, sf_dir).groupBy(claim).agg((F.count(F.lit(1)) + F.max((F.col("model") == "A").cast("int"))).cast("double").alias("expected"))
    claims = claims.unionByName(spark.range(1).select(F.lit("X/9").alias("claim_id"), F.lit(1.0).alias("expected")))
    value = grid(spark, sf_dir).groupBy(claim).agg(F.sum("n").cast("double").alias("value"))
    return checks.expectations(value, claims)


def best_worst_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First result row per (dimension, model) in the order of level and replicate."""
    rows = grid(spark, sf_dir).withColumn("at", F.struct("level", "replicate"))
    kept = L.first_per_key(rows, ["dimension", "model"], "at")
    return kept.select("dimension", "model", "level", "replicate", F.round("price", 6).alias("price"))


# ----------------------------------------------------------------- mixed model


def _fit(loss: DataFrame) -> MM.Fit:
    return MM.fit(loss, DIMS, MODELS, LEVELS)


def _qty_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses(spark, sf_dir).filter(F.col("metric") == "qty")


def _complete(loss: DataFrame) -> DataFrame:
    """Losses of the replicates that have every cell of the design."""
    full = loss.groupBy("replicate").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(DIMS) * len(MODELS) * len(LEVELS))
    return loss.join(full.select("replicate"), "replicate", "left_semi")


def mixed_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance components of all losses, incomplete replicates included."""
    return MM.icc_row(spark, _fit(_qty_loss(spark, sf_dir)))


def mixed_icc_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = MM.icc_row(spark, _fit(_complete(_qty_loss(spark, sf_dir))))
    return df.select("n_rows", "n_fixed", *[round_col(F.col(c), 4).alias(c) for c in ("icc", "sigma_u2", "sigma_e2")])


def residual_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness of the residuals per metric, most skewed first."""
    out = None
    for metric in ("price", "qty"):
        loss = losses(spark, sf_dir).filter(F.col("metric") == metric)
        skew = MM.skewness(MM.residuals(loss, _fit(loss)), ["metric"])
        out = skew if out is None else out.unionByName(skew)
    return MM.skew_ranking(out, ["metric"])


def residual_skew_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = _complete(_qty_loss(spark, sf_dir))
    df = MM.skewness(MM.residuals(loss, _fit(loss)), ["metric"])
    return df.select("metric", "n", round_col(F.col("skew"), 4).alias("skew"))


def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = _qty_loss(spark, sf_dir)
    return MM.histogram(MM.residuals(loss, _fit(loss)))


def residual_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = _qty_loss(spark, sf_dir)
    return MM.plotting_positions(MM.residuals(loss, _fit(loss)))


# ------------------------------------------------------------------ oracle text

ALL_COLUMNS = COHORT.predictors


def _rate_sql(dimension: str, after: str, approximate: bool) -> str:
    changed = " + ".join(f"(b.{c} IS DISTINCT FROM a.{c})::INT" for c in ALL_COLUMNS)
    there = " + ".join(f"(b.{c} IS NOT NULL OR a.{c} IS NOT NULL)::INT" for c in ALL_COLUMNS)
    ok = "TRUE" if approximate else f"abs(n_changed::DOUBLE / n_cells - {DENSITY}) <= 0.01"
    return f"""SELECT '{dimension}' AS dimension, n_changed, n_cells, round(n_changed::DOUBLE / n_cells, 9) AS rate, {ok} AS ok FROM (
  SELECT sum({changed})::BIGINT AS n_changed, sum({there})::BIGINT AS n_cells FROM cohort b JOIN ({after}) a USING (row_id))"""


def _severity_sql(dimension: str, after: str) -> str:
    cells = " UNION ALL ".join(
        f"""SELECT b.{c} IS DISTINCT FROM a.{c} AS changed, CASE WHEN b.{c} <> a.{c} THEN abs(a.{c} - b.{c}) / s_{c} END AS moved
    FROM cohort b JOIN ({after}) a USING (row_id), scales""" for c in MEASURES
    )
    return f"""SELECT '{dimension}' AS dimension, round(100.0::DOUBLE * count(*) FILTER (changed) / count(*), 6) AS cells_pct,
  round(100.0::DOUBLE * (count(*) FILTER (changed) - count(moved)) / nullif(count(*) FILTER (changed), 0), 6) AS void_pct,
  round(quantile_cont(moved, 0.5), 6) AS median, round(quantile_cont(moved, 0.25), 6) AS q1, round(quantile_cont(moved, 0.75), 6) AS q3,
  round(100.0::DOUBLE * count(*) FILTER (moved > 5) / nullif(count(moved), 0), 6) AS beyond5_pct FROM ({cells})"""


_TOKENS = ", ".join(f"""max(token) FILTER ("column" = '{c}') AS t_{c}""" for c in ALL_COLUMNS)
_READ = ", ".join(f"CASE WHEN t_{c} IS NULL THEN {c} ELSE try_cast(t_{c} AS DOUBLE) END AS {c}" for c in COHORT.numeric)
#: Tokens read as numbers where they are some; the rest of a touched cell is null, which still counts as changed.
READ_SQL = f"""SELECT c.row_id, {_READ}, coalesce(t_status, status) AS status
  FROM cohort c LEFT JOIN (SELECT row_id, {_TOKENS} FROM ({VALIDITY_SQL}) GROUP BY row_id) w ON c.row_id = w.row_id"""
AFTER = {
    "completeness": COMPLETENESS_SQL,
    "coherence": DEGRADED["degrade_coherence"],
    "uniqueness": UNIQUENESS_SQL,
    "validity": READ_SQL,
    "precision": precision_sql(None),
}
ARMS_SQL = f"""{grid_sql('arm')},
f AS (SELECT dimension, model, level, replicate, price, qty FROM grid WHERE arm = 'F'),
o AS (SELECT dimension, model, level, replicate, price, qty FROM grid WHERE arm = 'O')"""
N_CELLS = len(DIMS) * len(MODELS) * len(LEVELS)
N_FIXED = len(DIMS) * (len(MODELS) + len(LEVELS) - 1)
BALANCED_SQL = f"""{LOSS_SQL},
bal AS (SELECT * FROM loss WHERE metric = 'qty' AND replicate IN (SELECT replicate FROM loss WHERE metric = 'qty' GROUP BY replicate HAVING count(*) = {N_CELLS})),
resid AS (
  SELECT *, loss - (avg(loss) OVER (PARTITION BY dimension, model) + avg(loss) OVER (PARTITION BY dimension, level) - avg(loss) OVER (PARTITION BY dimension)) AS e
  FROM bal),
centred AS (SELECT *, avg(e) OVER (PARTITION BY replicate) AS m FROM resid),
parts AS (
  SELECT count(*) AS n, count(DISTINCT replicate) AS r, sum((e - m) * (e - m)) AS within_ss,
    (SELECT sum(m * m) FROM (SELECT DISTINCT replicate, m FROM centred)) AS between_ss FROM centred),
comp AS (
  SELECT n, within_ss / (n - r - ({N_FIXED} - 1)) AS se,
    greatest(0, ({N_CELLS} * between_ss / (r - 1) - within_ss / (n - r - ({N_FIXED} - 1))) / {N_CELLS}) AS su FROM parts)"""

QUERIES = {
    "change_rate": change_rate,
    "severity_profile": severity_profile,
    "block_completeness": block_completeness,
    "replicate_coverage": replicate_coverage,
    "resume_todo": resume_todo,
    "arm_replace": arm_replace,
    "arm_gap": arm_gap,
    "rank_swaps": rank_swaps,
    "reproduced_rows": reproduced_rows,
    "drift_guard": drift_guard,
    "expectations": expectations,
    "first_per_key": best_worst_level,
    "mixed_icc": mixed_icc,
    "mixed_icc_balanced": mixed_icc_balanced,
    "residual_skew": residual_skew,
    "residual_skew_balanced": residual_skew_balanced,
    "residual_histogram": residual_histogram,
    "residual_positions": residual_positions,
}

_SIDES = " UNION ALL ".join(
    f"SELECT model, dimension, '{m}' AS metric, {s} * round(avg({m}_first), 6) AS a, {s} * round(avg({m}_second), 6) AS b FROM wide GROUP BY model, dimension"
    for m, s in (("price", -1), ("qty", 1))
)

ORACLES = {
    "change_rate": f"WITH {COHORT_SQL} " + " UNION ALL ".join(_rate_sql(d, q, d in degrade.APPROXIMATE_RATE) for d, q in AFTER.items()),
    "severity_profile": f"""WITH {COHORT_SQL},
edges AS (SELECT {', '.join(f'quantile_cont({c}, 0.001) AS lo_{c}, quantile_cont({c}, 0.999) AS hi_{c}' for c in MEASURES)} FROM cohort),
scales AS (SELECT {', '.join(f'stddev_samp(greatest(lo_{c}, least(hi_{c}, {c}))) AS s_{c}' for c in MEASURES)} FROM cohort, edges)
""" + " UNION ALL ".join(_severity_sql(d, q) for d, q in AFTER.items()),
    "block_completeness": f"""WITH {grid_sql()},
blocks AS (SELECT dimension, model, count(*) AS n_rows FROM grid GROUP BY dimension, model)
SELECT *, max(n_rows) OVER () AS expected, n_rows = max(n_rows) OVER () AS complete FROM blocks""",
    "replicate_coverage": f"""WITH {grid_sql()},
per AS (SELECT dimension, model, level, count(DISTINCT replicate) AS n FROM grid GROUP BY ALL)
SELECT dimension, model, string_agg(level::VARCHAR, ',' ORDER BY level) AS levels, count(*) AS n_levels, min(n) AS min_replicates, count(*) = 4 AS complete
FROM per GROUP BY dimension, model""",
    "resume_todo": f"""WITH {grid_sql()},
planned AS (SELECT d::VARCHAR AS dimension, lv::INT AS level, s_suppkey AS replicate FROM supplier, range(1, 6) a(d), range(4) b(lv)),
done AS (SELECT dimension, level, replicate FROM grid GROUP BY ALL HAVING count(DISTINCT model) = 3)
SELECT * FROM planned ANTI JOIN done USING (dimension, level, replicate)""",
    "arm_replace": f"WITH {ARMS_SQL} SELECT * FROM f WHERE model <> 'A' UNION ALL SELECT * FROM o WHERE model = 'A'",
    "arm_gap": f"""WITH {ARMS_SQL} SELECT model, {rounded('quantile_cont(o.price - f.price, 0.5)', 7)} AS median_price,
  {rounded('quantile_cont(o.qty - f.qty, 0.5)', 7)} AS median_qty, {rounded('max(abs(o.price - f.price))', 7)} AS worst_price,
  {rounded('max(abs(o.qty - f.qty))', 7)} AS worst_qty FROM f JOIN o USING (dimension, model, level, replicate) WHERE level = 3 GROUP BY model""",
    "rank_swaps": f"""WITH {ARMS_SQL},
wide AS (SELECT model, dimension, f.price AS price_first, o.price AS price_second, f.qty AS qty_first, o.qty AS qty_second
  FROM f JOIN o USING (dimension, model, level, replicate)),
sides AS ({_SIDES}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY metric, model ORDER BY a, dimension) - 1 AS ra, row_number() OVER (PARTITION BY metric, model ORDER BY b, dimension) - 1 AS rb
  FROM sides)
SELECT x.metric, x.model, x.dimension AS lost, y.dimension AS won, x.ra::INT AS rank, round(abs(y.a - x.a), 6) AS gap_first, round(abs(y.b - x.b), 6) AS gap_second,
  greatest(abs(y.a - x.a), abs(y.b - x.b)) > 0.002 AS beyond_tie,
  CASE WHEN x.ra = 0 THEN 'least damaging end' WHEN x.ra = 3 THEN 'most damaging end' ELSE 'middle' END AS place
FROM ranked x JOIN ranked y ON x.metric = y.metric AND x.model = y.model AND y.ra = x.ra + 1 WHERE x.rb > y.rb""",
    "reproduced_rows": f"""WITH {ARMS_SQL},
gap AS (SELECT model, count(*) AS n, max(greatest(abs(f.price - o.price), abs(f.qty - o.qty))) AS w FROM f JOIN o USING (dimension, model, level, replicate) GROUP BY model)
SELECT model, n, round(w, 6) AS worst_gap, CASE WHEN w < 1e-6 THEN 'equal' WHEN w < 5e-3 THEN 'close' ELSE 'differs' END AS agreement FROM gap""",
    "drift_guard": f"""WITH {ARMS_SQL},
new AS (SELECT * FROM f WHERE model <> 'A' UNION ALL SELECT * FROM o WHERE model = 'A'),
gone AS (SELECT * FROM f WHERE level <> 3 EXCEPT ALL SELECT * FROM new WHERE level <> 3),
came AS (SELECT * FROM new WHERE level <> 3 EXCEPT ALL SELECT * FROM f WHERE level <> 3)
SELECT 'old' AS side, model, count(*) AS n FROM gone GROUP BY model UNION ALL SELECT 'new', model, count(*) FROM came GROUP BY model""",
    "expectations": f"""WITH {grid_sql()},
c AS (SELECT concat_ws('/', model, level) AS claim_id, (count(*) + max((model = 'A')::INT))::DOUBLE AS expected FROM lines GROUP BY claim_id UNION ALL SELECT 'X/9', 1.0::DOUBLE),
v AS (SELECT concat_ws('/', model, level) AS claim_id, sum(n)::DOUBLE AS value FROM grid GROUP BY ALL)
SELECT claim_id, expected, value, coalesce(expected = value, FALSE) AS ok, concat(expected, ' / ', coalesce(value::VARCHAR, 'absent')) AS detail FROM c LEFT JOIN v USING (claim_id)""",
    "first_per_key": f"""WITH {grid_sql()} SELECT dimension, model, level, replicate, round(price, 6) AS price FROM grid
  QUALIFY row_number() OVER (PARTITION BY dimension, model ORDER BY level, replicate) = 1""",
    "mixed_icc_balanced": f"""WITH {BALANCED_SQL} SELECT n AS n_rows, {N_FIXED} AS n_fixed, {rounded('su / (su + se)', 4)} AS icc,
  {rounded('su', 4)} AS sigma_u2, {rounded('se', 4)} AS sigma_e2 FROM comp""",
    "residual_skew_balanced": f"""WITH {BALANCED_SQL},
left_over AS (SELECT e - (su / se) * {N_CELLS} * m / (1 + {N_CELLS} * su / se) AS r FROM centred, comp),
about AS (SELECT r, avg(r) OVER () AS mu FROM left_over)
SELECT 'qty' AS metric, count(*) AS n, {rounded('avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5)', 4)} AS skew FROM about""",
}
