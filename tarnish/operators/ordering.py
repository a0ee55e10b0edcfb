"""Ranks, prefix sums, numbering and quantiles that survive a hot group.

A window over a whole group puts that group in one task. Here a group is cut into
ordered buckets, bucket totals are summed up, and windows only run inside a bucket.
The plan is the same at every size; a small table has a single bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnish.session import staged

ROWS_PER_BUCKET = 1_000_000


def _same(df: DataFrame, other: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on ``keys``."""
    out = F.lit(True)
    for k in keys:
        out = out & df[k].eqNullSafe(other[k])
    return out


def with_value_bucket(df: DataFrame, order: str, n_rows: int, rows_per_bucket: int) -> DataFrame:
    """Add ``__bucket``: an order-preserving bucket number with about equal row counts.

    Split points come from a quantile sketch; they only steer balance, so any error in
    them leaves the results exact.
    """
    n = max(1, math.ceil(n_rows / rows_per_bucket))
    probs = [i / n for i in range(1, n)]
    splits = sorted(set(df.approxQuantile(order, probs, 1.0 / (4 * n)))) if probs else []
    if not splits:
        return df.withColumn("__bucket", F.lit(0))
    edges = [-math.inf, *splits, math.inf]
    doubled = df.withColumn("__order", F.col(order).cast("double"))
    cut = Bucketizer(splits=edges, inputCol="__order", outputCol="__cut", handleInvalid="keep")
    return cut.transform(doubled).withColumn("__bucket", F.col("__cut").cast("int")).drop("__order", "__cut")


def prefix_sums(
    df: DataFrame, groups: list[str], order: str, columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``before_c`` (sum of c over smaller ``order`` in the group) and ``total_c``.

    ``(groups, order)`` must be unique: pre-aggregate ties first, which also collapses
    a value that holds most of the rows. The input is computed once and staged.
    """
    df = staged(df)
    bucketed = with_value_bucket(df, order, df.count(), rows_per_bucket)
    totals = bucketed.groupBy(*groups, "__bucket").agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
    earlier = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = totals.select(
        *[F.col(g).alias(f"__g_{g}") for g in groups],
        F.col("__bucket").alias("__g_bucket"),
        *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in columns],
        *[F.sum(f"__s_{c}").over(whole).alias(f"total_{c}") for c in columns],
    )
    inside = Window.partitionBy(*groups, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__l_{c}") for c in columns]
    )
    on = local["__bucket"].eqNullSafe(offsets["__g_bucket"])  # a null order has no bucket
    for g in groups:
        on = on & local[g].eqNullSafe(offsets[f"__g_{g}"])
    return local.join(offsets, on).select(
        *df.columns,
        *[(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(f"before_{c}") for c in columns],
        *[F.col(f"total_{c}") for c in columns],
    )


def number_rows(
    df: DataFrame, groups: list[str], bits: str, tie: str, out: str = "ordinal", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Number rows 0..n-1 inside each group in the order of a 48-bit hash column.

    The top hash bits are the bucket, so buckets are even whatever the group sizes.
    Adds ``out`` and ``n_<out>`` (the group size).
    """
    depth = min(48, max(0, math.ceil(math.log2(max(1, df.count()) / rows_per_bucket))))
    bucketed = df.withColumn("__bucket", F.shiftright(F.col(bits), 48 - depth))
    totals = bucketed.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"__g_{g}") for g in groups],
        F.col("__bucket").alias("__g_bucket"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(*groups)).alias(f"n_{out}"),
    )
    inside = Window.partitionBy(*groups, "__bucket").orderBy(bits, tie)
    local = bucketed.withColumn("__rank", F.row_number().over(inside) - 1)
    on = local["__bucket"] == offsets["__g_bucket"]
    for g in groups:
        on = on & local[g].eqNullSafe(offsets[f"__g_{g}"])
    return local.join(offsets, on).select(
        *df.columns, (F.col("__rank") + F.col("__offset")).alias(out), f"n_{out}"
    )


def grouped_quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    probs: dict[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    weight: str | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, one output column per entry.

    ``weight`` names a column of row counts for a table that is already counted. A group
    whose values are all null gets nulls.
    """
    times = F.when(F.col(value).isNotNull(), F.lit(1) if weight is None else F.col(weight)).otherwise(0)
    counted = df.groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(F.sum(times).cast("long").alias("__n"))
    placed = prefix_sums(counted, groups, "__v", ["__n"], rows_per_bucket)
    picks = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total___n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before___n") <= rank) & (rank < F.col("before___n") + F.col("__n"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}_{name}"))
        picks.append(F.max(at - F.floor(at)).alias(f"__f_{name}"))
    found = placed.groupBy(*groups).agg(*picks)
    return found.select(
        *groups,
        *[
            F.when(F.col(f"__lo_{n}") == F.col(f"__hi_{n}"), F.col(f"__lo_{n}"))
            .otherwise((1 - F.col(f"__f_{n}")) * F.col(f"__lo_{n}") + F.col(f"__f_{n}") * F.col(f"__hi_{n}"))
            .alias(n)
            for n in probs
        ],
    )


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns, found by narrowing value intervals.

    One pass narrows every column and every quantile at once; what comes back to the
    driver per pass is one bounded histogram per open interval.
    """
    stats = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns],
    ).collect()[0]
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}
    for c in columns:
        n, lo, hi = stats[f"n_{c}"], stats[f"lo_{c}"], stats[f"hi_{c}"]
        if n == 0:
            continue
        for p in probs:
            at = p * (n - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                if lo == hi:
                    found[c, rank] = lo
                else:
                    open_[c, rank] = (lo, hi, rank)
    while open_:
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        cells = []
        for i, (c, lo, hi) in enumerate(spans):
            v = F.col(c).cast("double")
            digit = F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(4096.0))
            inside = v.between(F.lit(lo), F.lit(hi))
            cells.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.least(digit, F.lit(4095)).alias("d"), v.alias("v"))))
        counts: dict[int, list] = {}
        rows = (
            df.select(F.explode(F.array(*cells)).alias("c"))
            .filter(F.col("c").isNotNull())
            .groupBy("c.i", "c.d")
            .agg(F.count(F.lit(1)).alias("n"), F.min("c.v").alias("lo"), F.max("c.v").alias("hi"))
            .collect()
        )
        for r in rows:
            counts.setdefault(r["i"], []).append((r["d"], r["n"], r["lo"], r["hi"]))
        index = {s: i for i, s in enumerate(spans)}
        for (c, rank), (lo, hi, left) in list(open_.items()):
            for _, n, first, last in sorted(counts[index[c, lo, hi]]):
                if left < n:
                    break
                left -= n
            if first == last or n == 1:
                found[c, rank] = first
                del open_[c, rank]
            else:
                open_[c, rank] = (first, last, left)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n = stats[f"n_{c}"]
        out[c] = []
        for p in probs:
            if n == 0:
                out[c].append(None)
                continue
            at = p * (n - 1)
            a, b = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[c].append(a + (b - a) * (at - math.floor(at)))
    return out
