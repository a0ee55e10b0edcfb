"""Result rows on disk: tolerant CSV scans, tree consolidation, partitioned sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of result rows per outcome.
_KEYS = "scenario string, N int, p double, bootstrap int, model string"
RESULT_SCHEMAS = {
    "binary": f"{_KEYS}, accuracy double, f1_macro double, auc double, brier double, auprc double, "
    "p_mean double, p_var double, p_entropy double, p_abs_dist_prior double",
    "continuous": f"{_KEYS}, rmse double, mae double, r2 double, yhat_mean double, yhat_var double, "
    "y_mean double, y_var double, bias double",
    "survival": f"{_KEYS}, c_index double, ibs double, brier_7d double, brier_14d double, brier_30d double, "
    "brier_60d double, risk_mean double, risk_var double, event_rate double, median_time double",
}
SEPARATORS = [",", ";", "\t", "|"]
LEVEL_NAMES = ("p", "pollution")


def result_schema(outcome: str) -> T.StructType:
    return T.StructType.fromDDL(RESULT_SCHEMAS[outcome])


def _header(line: str) -> tuple[list[str], str]:
    line = line.lstrip("﻿")
    sep = max(SEPARATORS, key=line.count)
    return [c.strip().strip('"') for c in line.split(sep)], sep


def header_of(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """Column names and separator, from the first line of a file."""
    first = spark.read.text(path).limit(1).collect()
    return _header(first[0][0]) if first else ([], SEPARATORS[0])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a sniffed separator. Lines with too many fields are skipped, short ones are
    padded with nulls; values that do not parse, and the text nan, become null.

    All ``path`` entries share the header of the first one. Columns outside ``schema``
    stay strings.
    """
    rows = _scan(spark, [path] if isinstance(path, str) else list(path)).drop("__path")
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    return rows.select(*[_read_as(c, types[c]) if c in types else F.col(c) for c in rows.columns])


def _read_as(c: str, kind: T.DataType) -> Column:
    """A text column as ``kind``; what does not parse, and NaN in any spelling, is null."""
    value = F.col(c).try_cast(kind)
    return (F.when(~F.isnan(value), value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value).alias(c)


def _scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """String columns of files with one header, and each row's file in ``__path``."""
    names, sep = header_of(spark, paths[0])
    raw = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt_record"]])
    rows = (
        spark.read.schema(raw)
        .option("header", "true")
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("nullValue", "nan")
        # a pruned scan does not count the fields it skips, and would let long lines through
        .option("columnPruning", "false")
        .csv(paths)
    )
    # separators inside quotes separate nothing
    bare = F.regexp_replace("_corrupt_record", '"(?:[^"]|"")*"', "")
    fields = F.size(F.split(bare, "\\Q" + sep + "\\E"))
    whole = rows.select("*", F.col("_metadata.file_path").alias("__path"))
    # the last term never decides; it keeps a data column in scans that only count rows,
    # which Spark refuses to run on the corrupt-record column alone
    usable = F.col("_corrupt_record").isNull() | (fields <= len(names)) | (fields.isNull() & F.col(names[0]).isNotNull())
    return whole.filter(usable).drop("_corrupt_record")


def cached(spark: SparkSession, source: DataFrame, cache: str) -> DataFrame:
    """The Parquet copy of a scan, written on first use, and again if it was never finished."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        source.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def level_of(columns: Sequence[str], names: Sequence[str] = LEVEL_NAMES) -> Column:
    """Corruption level under whichever name it has, as a double."""
    present = [F.col(c).cast("double") for c in names if c in columns]
    if not present:
        raise ValueError(f"no level column among {list(names)}")
    return F.coalesce(*present)


def with_level(results: DataFrame) -> DataFrame:
    """Add ``level`` in tenths from a level rounded to two digits, so that
    0.30000000000000004 and 0.3 meet; rows off the tenths keep a null level."""
    cents = F.bround(level_of(results.columns) * 100, 0).cast("int")
    return results.withColumn("level", F.when(cents % 10 == 0, (cents / 10).cast("int")))


def as_grid(results: DataFrame) -> DataFrame:
    """Result rows in the form the loss plans expect (level in tenths, replicate)."""
    return with_level(results).withColumnRenamed("bootstrap", "replicate")


def _files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """Every csv file below ``root`` with its first line, in one distributed pass."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root)
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), at)
    first = placed.groupBy("path").agg(F.min_by("value", "at").alias("line"))
    return sorted(tuple(r) for r in first.collect())


def collect_tree(spark: SparkSession, root: str, outcome: str, level: str = "p") -> DataFrame:
    """All result files under ``<root>/<dimension>/<scenario>/`` as one table.

    ``outcome_type`` and ``dimension`` are added, the dimension from the path. Files are
    grouped by header, each group is one scan; the level column gets one name.
    """
    groups: dict[tuple, list[str]] = {}
    for path, line in _files(spark, root):
        names, sep = _header(line)
        groups.setdefault((tuple(names), sep), []).append(path)
    whole = None
    for paths in groups.values():
        part = _scan(spark, paths)
        if level not in part.columns:
            other = next(c for c in LEVEL_NAMES if c in part.columns)
            part = part.withColumnRenamed(other, level)
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        raise ValueError(f"no csv file under {root}")
    dimension = F.regexp_extract("__path", r"([^/]+)/[^/]+/[^/]+\.csv$", 1)
    return whole.select(F.lit(outcome).alias("outcome_type"), dimension.alias("dimension"), *[c for c in whole.columns if c != "__path"])


def typed(results: DataFrame, outcome: str) -> DataFrame:
    """Cast the known result columns; whatever else is there stays as it is."""
    types = {f.name: f.dataType for f in result_schema(outcome).fields}
    return results.select(*[_read_as(c, types[c]) if c in types else F.col(c) for c in results.columns])


def write_consolidated(results: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Parquet by outcome and dimension; extra columns are left out."""
    kept = results.select(*columns) if columns else results
    kept.write.mode("overwrite").partitionBy("outcome_type", "dimension").parquet(path)


def append_results(results: DataFrame, path: str, by: Sequence[str] = ("scenario", "N", "p")) -> None:
    """Append finished replicates; partitions let a resumed run read only what it needs."""
    results.write.mode("append").partitionBy(*by).parquet(path)


def append_missing(results: DataFrame, path: str, keys: Sequence[str], by: Sequence[str] = ("scenario", "N", "p")) -> None:
    """Append only rows whose keys the table does not have yet, so that a retried job adds nothing."""
    there = results.sparkSession.read.schema(results.schema).parquet(path).select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    append_results(results.join(there, same, "left_anti"), path, by)


def select_results(
    spark: SparkSession, path: str, where: Mapping[str, object], schema: T.StructType | None = None
) -> DataFrame:
    """Result rows of one outcome, dimension, scenario or arm: the filters are partition
    filters wherever the layout has those columns."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    out = reader.parquet(path)
    for c, v in where.items():
        out = out.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export of a report table, written in parallel."""
    df.write.mode("overwrite").option("header", "true").csv(path)
