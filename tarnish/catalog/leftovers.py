"""Small preparation and result steps that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.data import round_col, rounded, table
from tarnish.catalog.grid import grid, grid_sql
from tarnish.operators import checks, prep
from tarnish.plans import losses as L
from tarnish.plans import metrics as M

GUARD, TOLERANCE = 38_000.0, 300.0


def prepared_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a model's input: usable durations with their logarithm, no protected column, an
    expected column that is absent, and nothing missing."""
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), days.alias("days"))
    df = prep.valid_targets(prep.ensure_columns(df, {"age": "double"}), "days", positive=True)
    df = prep.zero_fill(prep.drop_protected(prep.log_target(df, "days"), ["o_custkey"]), ["age", "price"])
    return df.withColumn("log_days", round_col(F.col("log_days"), 9)).withColumn("price", round_col(F.col("price").cast("double"), 2))


def results_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of one cohort size and of two of the models."""
    rows = L.of_interest(grid(spark, sf_dir).withColumnRenamed("n", "N"), ["A", "R"], 2)
    return rows.select("dimension", "model", "level", "replicate", round_col(F.col("price"), 6).alias("price"))


def seed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over repeated fits of every cell of the grid; replicates stand for seeds."""
    means = M.mean_over_seeds(grid(spark, sf_dir), ["dimension", "model", "level"], ["price", "qty"])
    return means.select("dimension", "model", "level", *[round_col(F.col(c), 6).alias(c) for c in ("price", "qty")])


def baseline_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each model's clean mean is where it is expected."""
    clean = grid(spark, sf_dir).filter("level = 0").groupBy("model").agg(round_col(F.avg("price"), 6).alias("price"))
    return checks.within(clean, "price", GUARD, TOLERANCE)


QUERIES = {
    "prepared_matrix": prepared_matrix,
    "results_of_interest": results_of_interest,
    "seed_means": seed_means,
    "baseline_guard": baseline_guard,
}

ORACLES = {
    "prepared_matrix": f"""SELECT o_orderkey, {rounded('(o_totalprice::FLOAT)::DOUBLE', 2)} AS price, days, 0.0::FLOAT AS age, {rounded('ln(1 + days)', 9)} AS log_days
FROM (SELECT *, (o_orderdate::DATE - DATE '1995-01-01')::DOUBLE AS days FROM orders) WHERE days > 0""",
    "results_of_interest": f"""WITH {grid_sql()} SELECT dimension, model, level, replicate, {rounded('price', 6)} AS price FROM grid
WHERE model IN ('A', 'R') AND n = 2""",
    "seed_means": f"""WITH {grid_sql()} SELECT dimension, model, level, {rounded('avg(price)', 6)} AS price, {rounded('avg(qty)', 6)} AS qty
FROM grid GROUP BY dimension, model, level""",
    "baseline_guard": f"""WITH {grid_sql()}, m AS (SELECT model, {rounded('avg(price)', 6)} AS price FROM grid WHERE level = 0 GROUP BY model)
SELECT model, price, abs(price - {GUARD!r}) <= {TOLERANCE!r} AS ok FROM m""",
}
