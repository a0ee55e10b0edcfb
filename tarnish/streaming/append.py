"""Result files arriving over time, appended once each.

The stream's checkpoint remembers which files went in, so a restarted job goes on where
it stopped and no replicate is appended twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnish.sources.results import result_schema


def result_stream(spark: SparkSession, folder: str, outcome: str) -> DataFrame:
    """CSV result files of one outcome as a stream; unusable rows (no model) are dropped."""
    return (
        spark.readStream.schema(result_schema(outcome))
        .option("header", "true")
        .option("nullValue", "nan")
        .option("recursiveFileLookup", "true")
        .csv(folder)
        .filter(F.col("model").isNotNull())
    )


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("scenario", "N", "p")
) -> StreamingQuery:
    """Append everything that has arrived to the partitioned result table, then stop."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*by)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
