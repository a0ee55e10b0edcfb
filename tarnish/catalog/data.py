"""Tables the registered queries start from, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.session import spread
from tarnish.spec import TableSpec

SPAN_SQL = "281474976710656.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------- cohort

COHORT = TableSpec(
    ids=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    numeric=["quantity", "price", "discount", "tax", "returned", "filled", "early", "bulk"],
    categorical=["status"],
    flags=["returned", "filled", "early", "bulk"],
    severity="filled",
    swaps=[("quantity", "price"), ("discount", "tax")],
    noise_cv={"quantity": 0.05, "price": 0.03, "returned": 0.10, "filled": 0.10, "early": 0.10, "bulk": 0.10},
    additive_bias={"quantity": 1.0},
    multiplicative_bias={"price": 0.05},
    donor_column="price",
)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the shape of a cohort: ids, measures, 0/1 flags, one category."""
    line = table(spark, sf_dir, "lineitem")
    shaped = line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("double").alias("returned"),
        (F.col("l_linestatus") == "F").cast("double").alias("filled"),
        (F.col("l_linenumber") <= 3).cast("double").alias("early"),
        (F.col("l_quantity") >= 25).cast("double").alias("bulk"),
        F.col("l_linestatus").alias("status"),
    )
    return spread(shaped, *COHORT.ids)


COHORT_SQL = """cohort AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS returned,
         CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS filled,
         CASE WHEN l_linenumber <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS early,
         CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS bulk,
         l_linestatus AS status
  FROM lineitem)"""


def bits_sql(text: str, slot: int = 0) -> str:
    return f"('0x' || substr(md5({text}), {1 + 12 * slot}, 12))::BIGINT"


def small_bits_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 25, 8))::BIGINT"


def unit_sql(text: str, slot: int = 0) -> str:
    return f"(({bits_sql(text, slot)} + 0.5::DOUBLE) / {SPAN_SQL}::DOUBLE)"


def rounded(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END)"


def round_col(c, digits: int = 6):
    """Spark side of ``rounded``; adding zero makes a negative zero positive and rounds only once."""
    return F.round(c, digits) + F.lit(0.0)
