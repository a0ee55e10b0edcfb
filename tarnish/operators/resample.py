"""Samples, bootstrap splits and hot-deck imputation as joins on hashed ordinals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions.hashing import digest, unit, wide_bits
from tarnish.operators.ordering import ROWS_PER_BUCKET, number_rows
from tarnish.operators.selection import cut_smallest
from tarnish.session import staged

# Seed bases of the bootstrap, the two imputations and the two degradations.
SEED_BOOTSTRAP = 10_000
SEED_IMPUTE_TRAIN = 20_000
SEED_IMPUTE_TEST = 30_000
SEED_DEGRADE_TRAIN = 40_000
SEED_DEGRADE_TEST = 50_000
#: Draws of a bootstrap that one task makes and counts.
DRAWS_PER_TASK = 250_000


def key_of(ids: Sequence[str]) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ids])


def sample_exact(df: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement (all of them if there are fewer)."""
    row = key_of(ids)
    key = unit(wide_bits(digest(seed, row, "sample")))
    cut = cut_smallest(df.select(key.alias("key"), row.alias("tie")), n)
    return df.filter(cut.keeps(key, row))


def bootstrap(
    df: DataFrame,
    ids: Sequence[str],
    replicates: int,
    stratum: str | None = None,
    seed: int = SEED_BOOTSTRAP,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """How often each row was drawn in each replicate: (row_id, stratum, replicate, draws).

    Within each stratum as many draws are made as it has rows. ``draws`` > 0 is the
    in-bag side with its multiplicity, 0 is out of bag. Draw number j of replicate b picks
    a row number by hash; rows are numbered once, in even hash buckets.
    """
    cls = F.col(stratum).cast("string") if stratum else F.lit("all")
    rows = df.select(key_of(ids).alias("row_id"), cls.alias("stratum"))
    rows = rows.withColumn("__bits", wide_bits(digest(seed, F.col("row_id"), "order")))
    numbered = number_rows(rows, ["stratum"], "__bits", "row_id", rows_per_bucket=rows_per_bucket)
    # every row becomes one per replicate, and a task counts what it draws: so dealt out anew by a fixed number
    numbered = numbered.repartition(max(1, math.ceil(df.count() * replicates / DRAWS_PER_TASK)), "stratum", "ordinal")
    every = numbered.select(
        "row_id", "stratum", "ordinal", "n_ordinal", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    )
    own = digest(F.col("replicate") + F.lit(seed), F.col("stratum"), F.col("ordinal"))
    drawn = (
        every.select("replicate", "stratum", F.pmod(wide_bits(own), F.col("n_ordinal")).alias("ordinal"))
        .groupBy("replicate", "stratum", "ordinal")
        .agg(F.count(F.lit(1)).alias("draws"))
    )
    return every.join(drawn, ["replicate", "stratum", "ordinal"], "left").select(
        "row_id", "stratum", "replicate", F.coalesce("draws", F.lit(0)).alias("draws")
    )


def in_bag(split: DataFrame) -> DataFrame:
    """Drawn rows, one output row per draw."""
    return split.filter(F.col("draws") > 0).select(
        "row_id", "stratum", "replicate", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int"))).alias("copy")
    )


def out_of_bag(split: DataFrame) -> DataFrame:
    return split.filter(F.col("draws") == 0).select("row_id", "stratum", "replicate")


def usable_replicates(split: DataFrame) -> DataFrame:
    """Replicates with both an in-bag and an out-of-bag side."""
    sides = split.groupBy("replicate").agg(
        F.count_if(F.col("draws") > 0).alias("n_in"), F.count_if(F.col("draws") == 0).alias("n_out")
    )
    return sides.filter((F.col("n_in") > 0) & (F.col("n_out") > 0))


def _cells(df: DataFrame, ids: Sequence[str], group: str, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(key_of(ids).alias("__row"), F.col(group).alias("__group"), F.explode(F.array(*cells)).alias("c")).select(
        "__row", "__group", "c.column", "c.value"
    )


def donor_pools(
    df: DataFrame, ids: Sequence[str], group: str, columns: Sequence[str], seed: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Numbered non-null values per (group, column): ordinal, value and pool size."""
    values = _cells(df, ids, group, columns).filter(F.col("value").isNotNull() & F.col("__group").isNotNull())
    values = values.withColumn("__bits", wide_bits(digest(seed, F.col("__row"), F.col("column"), "pool")))
    return number_rows(values, ["__group", "column"], "__bits", "__row", rows_per_bucket=rows_per_bucket).select(
        F.col("__group").alias("group"), "column", "ordinal", "value", F.col("n_ordinal").alias("size")
    )


def hot_deck(
    df: DataFrame,
    ids: Sequence[str],
    group: str,
    columns: Sequence[str],
    seed: int,
    pools: DataFrame | None = None,
) -> DataFrame:
    """Fill null cells with the value of a random donor of the same group.

    Rows without a group and cells whose pool is empty stay null.
    """
    pools = staged(donor_pools(df, ids, group, columns, seed)) if pools is None else pools
    sizes = pools.filter(F.col("ordinal") == 0).select("group", "column", "size")
    holes = _cells(df, ids, group, columns).filter(F.col("value").isNull()).drop("value")
    picks = holes.join(sizes, (holes["__group"] == sizes["group"]) & (holes["column"] == sizes["column"])).select(
        "__row",
        sizes["group"],
        sizes["column"],
        F.pmod(wide_bits(digest(seed, F.col("__row"), sizes["column"], "donor")), F.col("size")).alias("ordinal"),
    )
    found = picks.join(pools.drop("size"), ["group", "column", "ordinal"])
    filled = found.groupBy("__row").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"__fill_{c}") for c in columns]
    )
    keyed = df.withColumn("__key", key_of(ids))
    joined = keyed.join(filled, keyed["__key"] == filled["__row"], "left")
    new = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__fill_{c}")) for c in columns}
    return joined.withColumns(new).select(*df.columns)
