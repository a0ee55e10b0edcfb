"""Sources and sinks: the grid written as result files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.grid import DIMS, grid, grid_sql
from tarnish.operators import checks
from tarnish.session import staging_path
from tarnish.sources import results as R

SCENARIOS = ["S1", "S2", "S3"]
SHOWN = ["dimension", "scenario", "p", "bootstrap", "model", "auc", "brier"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as result rows of three scenarios."""
    return grid(spark, sf_dir).select(
        "dimension",
        F.concat(F.lit("S"), F.col("replicate") % 3 + 1).alias("scenario"),
        F.lit(3500).alias("N"),
        (F.col("level") / 10).alias("p"),
        F.col("replicate").cast("int").alias("bootstrap"),
        "model",
        F.col("price").alias("auc"),
        F.col("qty").alias("brier"),
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("auc", "brier") else F.col(c) for c in SHOWN])


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, scanned with a sniffed separator, kept as a Parquet copy."""
    folder = staging_path(spark)
    R.write_csv(_rows(spark, sf_dir), folder)
    scanned = R.read_csv(spark, folder, R.result_schema("binary"))
    return _shown(R.cached(spark, scanned, staging_path(spark)))


def tree_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of CSV files by dimension and scenario, consolidated to partitioned Parquet."""
    root, whole = staging_path(spark), staging_path(spark)
    rows = _rows(spark, sf_dir).cache()
    for d in DIMS:
        for s in SCENARIOS:
            part = rows.filter((F.col("dimension") == d) & (F.col("scenario") == s)).drop("dimension")
            # half of the files call the level by its other name
            part = part.withColumnRenamed("p", "pollution") if s == "S2" else part
            R.write_csv(part.coalesce(1), f"{root}/{d}/{s}")
    rows.unpersist()
    R.write_consolidated(R.typed(R.collect_tree(spark, root, "binary"), "binary"), whole)
    back = spark.read.parquet(whole)
    return _shown(back.withColumn("dimension", F.col("dimension").cast("string")))


def append_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates appended in three runs, the last of which repeats all of them; rows per block."""
    table = staging_path(spark)
    rows = _rows(spark, sf_dir)
    keys = ["dimension", "scenario", "N", "p", "bootstrap", "model"]
    R.append_results(rows.filter("bootstrap % 2 = 0"), table)
    R.append_missing(rows.filter("bootstrap % 3 <> 0"), table, keys)
    R.append_missing(rows, table, keys)
    return checks.block_completeness(spark.read.parquet(table), ["dimension", "scenario"])


def select_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dimension and two scenarios of the consolidated table, by partition filters."""
    whole = staging_path(spark)
    R.write_consolidated(_rows(spark, sf_dir).withColumn("outcome_type", F.lit("binary")), whole)
    schema = spark.read.parquet(whole).withColumn("dimension", F.lit("")).schema
    part = R.select_results(spark, whole, {"outcome_type": "binary", "dimension": "2", "scenario": ["S1", "S3"]}, schema)
    return _shown(part)


_ROWS_SQL = f"""{grid_sql()},
rows_ AS (
  SELECT dimension, concat('S', replicate % 3 + 1) AS scenario, level::DOUBLE / 10 AS p, replicate::INT AS bootstrap, model,
    round(price, 6) AS auc, round(qty, 6) AS brier FROM grid)"""

QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "tree_consolidated": tree_consolidated,
    "append_resume": append_resume,
    "select_partition": select_partition,
}

ORACLES = {
    "csv_roundtrip": f"WITH {_ROWS_SQL} SELECT * FROM rows_",
    "tree_consolidated": f"WITH {_ROWS_SQL} SELECT * FROM rows_",
    "append_resume": f"""WITH {_ROWS_SQL},
blocks AS (SELECT dimension, scenario, count(*) AS n_rows FROM rows_ GROUP BY dimension, scenario)
SELECT *, max(n_rows) OVER () AS expected, n_rows = max(n_rows) OVER () AS complete FROM blocks""",
    "select_partition": f"WITH {_ROWS_SQL} SELECT * FROM rows_ WHERE dimension = '2' AND scenario IN ('S1', 'S3')",
}
