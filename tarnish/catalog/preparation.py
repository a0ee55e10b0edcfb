"""Sampling, bootstrap, imputation, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.data import COHORT, COHORT_SQL, bits_sql, cohort, round_col, rounded, table, unit_sql
from tarnish.catalog.degradation import COMPLETENESS_SQL, DENSITY, SEED, VALIDITY_SQL
from tarnish.operators import degrade, prep, resample
from tarnish.operators.cells import row_id
from tarnish.operators.scenario import degrade_splits
from tarnish.spec import TableSpec

REPLICATES = 10
SAMPLE = 3500
SENTINELS = {"quantity": -9.0, "price": -1.0, "discount": -1.0, "tax": -1.0, "returned": -1.0, "filled": -1.0, "early": -1.0, "bulk": -1.0}
CUSTOMER = TableSpec(ids=["c_custkey"], numeric=["c_acctbal", "nation"], categorical=[])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation")
    )


def customers_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with 30 % of two measures missing."""
    return degrade.completeness(customers(spark, sf_dir), CUSTOMER, 0.3, 11).df


def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return resample.sample_exact(orders, ["o_orderkey"], SAMPLE).select("o_orderkey", "o_orderstatus")


def bootstrap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap(customers(spark, sf_dir), ["c_custkey"], REPLICATES, "c_mktsegment")


def bootstrap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-bag and out-of-bag rows of every usable replicate of an unstratified bootstrap."""
    return resample.usable_replicates(resample.bootstrap(customers(spark, sf_dir), ["c_custkey"], REPLICATES))


def hotdeck_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = customers_with_holes(spark, sf_dir)
    return resample.hot_deck(holes, ["c_custkey"], "c_mktsegment", ["c_acctbal", "nation"], resample.SEED_IMPUTE_TRAIN)


def _degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = degrade.completeness(cohort(spark, sf_dir), COHORT, DENSITY, SEED).df
    return out.select(row_id(COHORT).alias("row_id"), *COHORT.predictors)


def sentinel_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinels for missing measures, "missing" and 0/1 columns for the category."""
    df = prep.sentinel_encode(_degraded(spark, sf_dir), SENTINELS)
    df = prep.fill_category(df, ["status"])
    categories = [r["v"] for r in prep.fitted_categories(cohort(spark, sf_dir), "status").orderBy("v").collect()]
    return prep.one_hot(df, "status", categories)


def coerce_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the invalid-token table as numbers again; tokens that do not parse are null."""
    out = degrade.validity(cohort(spark, sf_dir), COHORT, DENSITY, SEED).df
    df = prep.coerce_numeric(out, COHORT.numeric)
    return df.select(row_id(COHORT).alias("row_id"), *COHORT.predictors)


def standardise_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["quantity", "price", "discount", "tax"]
    df = prep.standardise(_degraded(spark, sf_dir), cohort(spark, sf_dir), columns)
    return df.select("row_id", *[round_col(F.col(c), 6).alias(c) for c in columns])


def _split_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = resample.bootstrap(customers(spark, sf_dir), ["c_custkey"], REPLICATES, "c_mktsegment")
    rows = customers_with_holes(spark, sf_dir).withColumn("row_id", F.col("c_custkey").cast("string"))
    return split.join(rows.drop("c_mktsegment"), "row_id")


def standardise_in_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prep.standardise_in_bag(_split_with_holes(spark, sf_dir), ["c_acctbal", "nation"])
    return df.select("row_id", "replicate", "draws", *[round_col(F.col(c), 6).alias(c) for c in ("c_acctbal", "nation")])


def median_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prep.median_indicator(_split_with_holes(spark, sf_dir), ["c_acctbal", "nation"])
    real = [round_col(F.col(c), 6).alias(c) for c in ("c_acctbal", "nation")]
    return df.select("row_id", "replicate", "draws", "c_acctbal_missing", "nation_missing", *real)


def scenario_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells per side when both sides are degraded on their own."""
    split = F.when(F.col("l_suppkey") % 3 == 0, "test").otherwise("train")
    df = cohort(spark, sf_dir).withColumn("split", split)
    out = degrade_splits(df, "split", degrade.completeness, COHORT, DENSITY, "S3", 0).df
    from tarnish.operators.checks import missing_cells

    return missing_cells(out, COHORT.predictors, ["split"])


def winsorised_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["quantity", "price", "discount", "tax"]
    scale = prep.winsorised_scale(cohort(spark, sf_dir), columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(scale[c]).alias("scale")) for c in columns])
    out = spark.range(1).select(F.explode(cells).alias("c")).select("c.column", round_col(F.col("c.scale"), 7).alias("scale"))
    return out


# ------------------------------------------------------------------ oracle text

_STRATUM = "c_mktsegment"


def _bootstrap_sql(stratum: str) -> str:
    return f"""rows_ AS (SELECT c_custkey::VARCHAR AS row_id, {stratum} AS stratum FROM customer),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {bits_sql("concat('10000:', row_id, ':order')")}, row_id) - 1 AS ordinal,
         count(*) OVER (PARTITION BY stratum) AS size FROM rows_),
every AS (SELECT n.*, r AS replicate FROM numbered n, range({REPLICATES}) t(r)),
drawn AS (
  SELECT replicate, stratum, {bits_sql("concat(replicate + 10000, ':', stratum, ':', ordinal)")} % size AS ordinal, count(*) AS draws
  FROM every GROUP BY ALL),
split AS (
  SELECT row_id, stratum, replicate::INT AS replicate, coalesce(draws, 0) AS draws FROM every LEFT JOIN drawn USING (replicate, stratum, ordinal))"""


HOLES_SQL = f"""hole_cells AS (
  SELECT c_custkey, c_mktsegment, 'c_acctbal' AS col, c_acctbal AS v FROM customer
  UNION ALL SELECT c_custkey, c_mktsegment, 'nation', c_nationkey::DOUBLE FROM customer),
hole_rank AS (
  SELECT *, row_number() OVER (ORDER BY -ln({unit_sql("concat('11:', c_custkey, ':', col)")}), concat(c_custkey, ':', col)) AS rn FROM hole_cells),
holed AS (
  SELECT c_custkey, c_mktsegment, col, CASE WHEN rn > (SELECT floor(0.3::DOUBLE * count(*) * 2) FROM customer) THEN v END AS v FROM hole_rank),
holes AS (
  SELECT c_custkey, c_mktsegment, max(v) FILTER (col = 'c_acctbal') AS c_acctbal, max(v) FILTER (col = 'nation') AS nation
  FROM holed GROUP BY c_custkey, c_mktsegment)"""

_MEASURES = ["quantity", "price", "discount", "tax"]

QUERIES = {
    "sample_exact": sample_exact,
    "bootstrap_split": bootstrap_split,
    "bootstrap_sizes": bootstrap_sizes,
    "hotdeck_impute": hotdeck_impute,
    "sentinel_encode": sentinel_encode,
    "coerce_invalid": coerce_invalid,
    "standardise_clean": standardise_clean,
    "standardise_in_bag": standardise_in_bag,
    "median_indicator": median_indicator,
    "scenario_both": scenario_both,
    "winsorised_scale": winsorised_scale,
}

_BAG_SQL = f"""{_bootstrap_sql(_STRATUM)}, {HOLES_SQL},
joined AS (SELECT s.row_id, s.replicate, s.draws, h.c_acctbal, h.nation FROM split s JOIN holes h ON s.row_id = h.c_custkey::VARCHAR)"""

ORACLES = {
    "sample_exact": f"""SELECT o_orderkey, o_orderstatus FROM orders
  QUALIFY row_number() OVER (ORDER BY {bits_sql("concat('42:', o_orderkey, ':sample')")}, o_orderkey::VARCHAR) <= {SAMPLE}""",
    "bootstrap_split": f"WITH {_bootstrap_sql(_STRATUM)} SELECT * FROM split",
    "bootstrap_sizes": f"""WITH {_bootstrap_sql("'all'")} SELECT replicate, count(*) FILTER (draws > 0) AS n_in, count(*) FILTER (draws = 0) AS n_out
  FROM split GROUP BY replicate""",
    "hotdeck_impute": f"""WITH {HOLES_SQL},
pool AS (
  SELECT c_mktsegment, col, v, row_number() OVER w - 1 AS ordinal, count(*) OVER (PARTITION BY c_mktsegment, col) AS size FROM holed WHERE v IS NOT NULL
  WINDOW w AS (PARTITION BY c_mktsegment, col ORDER BY {bits_sql("concat('20000:', c_custkey, ':', col, ':pool')")}, c_custkey::VARCHAR)),
sizes AS (SELECT DISTINCT c_mktsegment, col, size FROM pool),
filled AS (
  SELECT h.c_custkey, h.c_mktsegment, h.col, coalesce(h.v, p.v) AS v
  FROM holed h LEFT JOIN sizes s USING (c_mktsegment, col)
  LEFT JOIN pool p ON p.c_mktsegment = h.c_mktsegment AND p.col = h.col
    AND p.ordinal = {bits_sql("concat('20000:', h.c_custkey, ':', h.col, ':donor')")} % s.size)
SELECT c_custkey, c_mktsegment, max(v) FILTER (col = 'c_acctbal') AS c_acctbal, max(v) FILTER (col = 'nation') AS nation
FROM filled GROUP BY c_custkey, c_mktsegment""",
    "sentinel_encode": f"""SELECT row_id, {', '.join(f'coalesce({c}, {v}) AS {c}' for c, v in SENTINELS.items())}, coalesce(status, 'missing') AS status,
  (coalesce(status, 'missing') = 'F')::INT AS "status_F", (coalesce(status, 'missing') = 'O')::INT AS "status_O" FROM ({COMPLETENESS_SQL})""",
    "coerce_invalid": f"""WITH {COHORT_SQL},
tokens AS ({VALIDITY_SQL}),
wide AS (SELECT row_id, {', '.join(f'''max(token) FILTER ("column" = '{c}') AS t_{c}''' for c in COHORT.predictors)} FROM tokens GROUP BY row_id)
SELECT c.row_id, {', '.join(f'CASE WHEN t_{c} IS NULL THEN {c} ELSE try_cast(t_{c} AS DOUBLE) END AS {c}' for c in COHORT.numeric)},
  coalesce(t_status, status) AS status FROM cohort c LEFT JOIN wide w ON c.row_id = w.row_id""",
    "standardise_clean": f"""WITH {COHORT_SQL},
fitted AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _MEASURES)} FROM cohort)
SELECT row_id, {', '.join(f"{rounded(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in _MEASURES)} FROM ({COMPLETENESS_SQL}), fitted""",
    "standardise_in_bag": f"""WITH {_BAG_SQL},
bag AS (SELECT j.* FROM joined j, range(100) t(i) WHERE i < draws),
fitted AS (
  SELECT replicate, avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(nation) AS m2, stddev_pop(nation) AS s2 FROM bag GROUP BY replicate)
SELECT row_id, replicate, draws, {rounded('(c_acctbal - m1) / s1')} AS c_acctbal, {rounded('(nation - m2) / s2')} AS nation
FROM joined JOIN fitted USING (replicate)""",
    "median_indicator": f"""WITH {_BAG_SQL},
bag AS (SELECT j.* FROM joined j, range(100) t(i) WHERE i < draws),
fitted AS (SELECT replicate, quantile_cont(c_acctbal, 0.5) AS m1, quantile_cont(nation, 0.5) AS m2 FROM bag GROUP BY replicate)
SELECT row_id, replicate, draws, (c_acctbal IS NULL)::INT AS c_acctbal_missing, (nation IS NULL)::INT AS nation_missing,
  {rounded('coalesce(c_acctbal, m1, 0)')} AS c_acctbal, {rounded('coalesce(nation, m2, 0)')} AS nation
FROM joined JOIN fitted USING (replicate)""",
    "scenario_both": f"""SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'test' ELSE 'train' END AS split,
  floor({DENSITY}::DOUBLE * count(*) * {len(COHORT.predictors)})::BIGINT AS n_missing, count(*) * {len(COHORT.predictors)} AS n_cells,
  floor({DENSITY}::DOUBLE * count(*) * {len(COHORT.predictors)}) / (count(*) * {len(COHORT.predictors)}) AS share FROM lineitem GROUP BY split""",
    "winsorised_scale": f"""WITH {COHORT_SQL},
edges AS (SELECT {', '.join(f'quantile_cont({c}, 0.001) AS lo_{c}, quantile_cont({c}, 0.999) AS hi_{c}' for c in _MEASURES)} FROM cohort)
{' UNION ALL '.join(f'''SELECT '{c}' AS "column", {rounded(f'stddev_samp(greatest(lo_{c}, least(hi_{c}, {c})))', 7)} AS scale FROM cohort, edges''' for c in _MEASURES)}""",
}
