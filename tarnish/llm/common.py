"""Small expressions shared by the text operators."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.session import staged, staging_path

__all__ = ["ascii_lower", "packed_key", "remainder", "small_batches", "staged", "staged_by", "text_of"]

#: The white space of all contracts, space and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def text_of(df: DataFrame, column: str) -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` also maps letters such as the Kelvin sign, so
    it only serves texts that are ASCII throughout, where both agree."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def packed_key(id_column: Column, digest: Column) -> Column:
    """Text digest and id as one string, with null ids equal to each other and to nothing else."""
    return F.concat(digest, F.coalesce(F.concat(F.lit("="), id_column.cast("string")), F.lit("-")))


def small_batches(spark: SparkSession, rows: int = 1000, read: int = 512) -> None:
    """Let Python workers take at most ``rows`` texts at a time and Parquet scans ``read``: Spark's
    10,000 and 4,096 are too many where texts are long, as a batch of a scan is one array of many
    megabytes on the heap. Smaller settings of the session stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", read)):
        spark.conf.set(name, str(min(most, int(spark.conf.get(name)))))


def staged_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Like :func:`staged`, but as a table bucketed by ``column``: a later join or grouping on the
    column reads it where it lies instead of shuffling it. ``buckets`` is raised to the session's
    number of shuffle partitions, below which Spark would shuffle both sides instead."""
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    df.write.bucketBy(buckets, column).option("path", staging_path(spark)).saveAsTable(name)
    return spark.table(name)
