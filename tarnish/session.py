"""Session helpers: a tuned local session and reliable lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "tarnish") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TARNISH_DRIVER_MEMORY", "12g"))
        # a cell-wise projection makes one long method; past 8000 bytes of bytecode the JVM
        # would only interpret it, so let Spark split it instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session without that setting gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tarnish-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_STAGED: list[str] = []
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def staging_path(spark: SparkSession) -> str:
    """A new path in the shared folder, remembered for :func:`drop_staged`."""
    _STAGED.append(f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}")
    return _STAGED[-1]


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where a costly table is scanned several times: it cuts the lineage, survives
    lost executors, and later scans read only the columns they need. The shuffle files
    behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = staging_path(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables staged so far, but for the first ``since``; call it when their results have
    been written or read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    while len(_STAGED) > since:
        path = hadoop(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``staged(make())``, without the tables that ``make`` staged on the way: they are deleted."""
    begun = len(_STAGED)
    out = staged(make())
    kept = _STAGED.pop()
    drop_staged(spark, begun)
    _STAGED.append(kept)
    return out


def split_methods(spark: SparkSession) -> None:
    """Let Spark split the long methods of cell-wise projections: past 8000 bytes of bytecode the JVM
    does not compile a method but interprets it. A smaller setting of the session stays."""
    spark.conf.set(METHOD_LIMIT, str(min(8000, int(spark.conf.get(METHOD_LIMIT)))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that has fewer partitions than there are cores.

    A small file is one task however many cores there are; a large table already has
    more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
