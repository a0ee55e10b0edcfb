"""A grid of result rows derived from order lines, in Spark and as SQL text.

dimension = order priority, model = return flag, level = discount in percent points,
replicate = supplier, arm = line status; the metrics are mean price (larger is better)
and mean quantity (smaller is better). Means come from integer sums, so they do not
depend on the order in which rows are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.data import table

DIMS = ["1", "2", "3", "4", "5"]
MODELS = ["A", "N", "R"]
ROLES = {"A": "trees", "N": "trees", "R": "linear"}
DIRECTIONS = {"price": "higher", "qty": "lower"}
LEVELS = [1, 2, 3]


# An effect of the dimension on the metrics, so that verdicts have something to find: for quantity
# one dimension costs most for the trees and another for the linear model, two are tied, and the
# leader changes with the level; for price one dimension costs most for all models.
UNITS_SHIFT = """CASE WHEN dimension = '1' AND model <> 'R' OR dimension = '5' AND model = 'R' THEN 300 * level
  WHEN dimension = '2' AND level = 1 THEN 1500 WHEN dimension IN ('2', '3') THEN 150 * level
  WHEN dimension = '4' THEN 50 * level ELSE 0 END"""
CENTS_SHIFT = "CASE WHEN dimension = '3' THEN -30000000 * level ELSE 0 END"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the grid's coordinates; clean and corrupted levels only."""
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_discount") < 0.035)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(
        F.substring("o_orderpriority", 1, 1).alias("dimension"),
        F.col("l_returnflag").alias("model"),
        F.round(F.col("l_discount") * 100).cast("int").alias("level"),
        F.col("l_suppkey").alias("replicate"),
        F.col("l_linestatus").alias("arm"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("units"),
    )


def grid(spark: SparkSession, sf_dir: str, *extra: str, shifted: bool = False) -> DataFrame:
    """Result rows: coordinates (and ``arm`` if asked for), price, qty, n."""
    rows = lines(spark, sf_dir)
    if shifted:
        rows = rows.withColumns({"cents": F.expr(f"cents + {CENTS_SHIFT}"), "units": F.expr(f"units + {UNITS_SHIFT}")})
    return (
        rows.groupBy("dimension", "model", "level", "replicate", *extra)
        .agg(F.sum("cents").alias("cents"), F.sum("units").alias("units"), F.count(F.lit(1)).alias("n"))
        .select(
            "dimension", "model", "level", "replicate", *extra,
            (F.col("cents") / F.col("n") / 100).alias("price"),
            (F.col("units") / F.col("n")).alias("qty"),
            "n",
        )
    )


LINES_SQL = """lines AS (
  SELECT substr(o_orderpriority, 1, 1) AS dimension, l_returnflag AS model,
         round(l_discount * 100)::INT AS level, l_suppkey AS replicate, l_linestatus AS arm,
         round(l_extendedprice * 100)::BIGINT AS cents, l_quantity::BIGINT AS units
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount < 0.035)"""


SHIFTED_SQL = LINES_SQL.replace("lines AS", "plain_lines AS") + f""",
lines AS (
  SELECT dimension, model, level, replicate, arm, cents + {CENTS_SHIFT} AS cents, units + {UNITS_SHIFT} AS units FROM plain_lines)"""


def grid_sql(*extra: str, name: str = "grid", shifted: bool = False) -> str:
    cols = ", ".join(["dimension", "model", "level", "replicate", *extra])
    return f"""{SHIFTED_SQL if shifted else LINES_SQL},
{name} AS (
  SELECT {cols}, sum(cents)::DOUBLE / count(*) / 100 AS price, sum(units)::DOUBLE / count(*) AS qty, count(*) AS n
  FROM lines GROUP BY {cols})"""


_PAIRED_SQL = """,
paired AS (
  SELECT s.dimension, s.model, s.level, s.replicate, b.price - s.price AS price, s.qty - b.qty AS qty
  FROM grid s JOIN grid b USING (dimension, model, replicate) WHERE b.level = 0 AND s.level IN (1, 2, 3)),
loss AS (
  SELECT metric, dimension, model, level, replicate, CASE WHEN round(v, 6) = 0 THEN 0.0 ELSE round(v, 6) END AS loss
  FROM (SELECT 'price' AS metric, dimension, model, level, replicate, price AS v FROM paired
        UNION ALL SELECT 'qty', dimension, model, level, replicate, qty FROM paired))"""
LOSS_SQL = grid_sql() + _PAIRED_SQL
SHIFTED_LOSS_SQL = grid_sql(shifted=True) + _PAIRED_SQL
