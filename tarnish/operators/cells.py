"""The working form of a table while cells are being degraded.

Next to each predictor ``c`` the working table carries ``__was_c`` (clean value),
``__dim_c`` (the cell-level defect it received, null if free) and ``__cpy_c`` (a record
copy changed it). Everything about a cell is in its row, so cell-level operators are
projections and the touched-cell list is one ``explode``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.operators.selection import BUCKETS, GROUP_BUCKETS, Cut, GroupedCut, cut_smallest, cut_smallest_by
from tarnish.session import split_methods
from tarnish.spec import TableSpec

#: Counters of a pass over all groups, unless the groups are so many that each has the least number.
ALL_COUNTERS = 1 << 17
TOUCHED_SCHEMA = "row_id string, column string, dimension string, before string, after string"


class Degraded(NamedTuple):
    """A degraded table, the list of cells that were touched, and the working form behind both, in
    which every cell stands next to its clean value."""

    df: DataFrame
    touched: DataFrame
    work: DataFrame | None = None


class Share(NamedTuple):
    """A budget: a share of the cells of a table, ``per_row`` of each row, or of the candidates.

    Halves are rounded to even and at least one cell is asked for; ``whole`` drops fractions
    instead and may come to nothing. ``pairs`` asks for half as many, rounded up.
    """

    density: float
    per_row: int | None = None
    whole: bool = False
    pairs: bool = False

    def number(self, total: int, n_rows: int | None) -> int:
        if self.whole:
            return int(self.density * n_rows * self.per_row)
        cells = total if self.per_row is None else n_rows * self.per_row
        n = max(1, min(round(self.density * cells), cells))
        return -(-n // 2) if self.pairs else n

    def column(self, total: Column) -> Column:
        """The same for the groups of a table with a column ``n_rows``."""
        density, n_rows = F.lit(self.density), F.col("n_rows")
        if self.whole:
            return F.floor(density * n_rows * F.lit(self.per_row))
        cells = total if self.per_row is None else n_rows * F.lit(self.per_row)
        n = F.greatest(F.lit(1), F.least(F.bround(density * cells), cells))
        return F.ceil(n / 2) if self.pairs else n


@dataclass(frozen=True)
class Scope:
    """What a budget is a share of: a table of ``n_rows``, or every group of it by itself, with
    ``sizes`` holding the groups and their ``n_rows``."""

    n_rows: int | None = None
    groups: tuple[str, ...] = ()
    sizes: DataFrame | None = None

    def cut(self, cells: DataFrame, share: Share | int | Callable[[int], int], upto: float = 1.0) -> Cut | GroupedCut:
        if self.groups:
            # few groups may have more counters each
            digits = max(GROUP_BUCKETS, min(BUCKETS, ALL_COUNTERS // max(1, self.sizes.count())))
            return cut_smallest_by(cells, self.groups, share.column, self.sizes, digits, upto=upto)
        if isinstance(share, Share):
            return cut_smallest(cells, lambda total: share.number(total, self.n_rows), upto)
        return cut_smallest(cells, share, upto)


def row_id(spec: TableSpec) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in spec.ids])


def base_cells(df: DataFrame, spec: TableSpec) -> DataFrame:
    """``df`` with numerics as doubles, NaN as null, and the row's id."""
    split_methods(df.sparkSession)
    kept = [c for c in df.columns if c not in spec.predictors]
    numeric = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in spec.numeric]
    return df.select(*kept, *numeric, *spec.categorical, row_id(spec).alias("__row"))


def untouched(base: DataFrame, spec: TableSpec) -> DataFrame:
    """Working form of a table from :func:`base_cells`: nothing touched yet."""
    return base.select(
        "*",
        *[F.col(c).alias(f"__was_{c}") for c in spec.predictors],
        *[F.lit(None).cast("string").alias(f"__dim_{c}") for c in spec.predictors],
        *[F.lit(False).alias(f"__cpy_{c}") for c in spec.predictors],
        F.lit(None).cast("string").alias("__donor"),
    )


def open_cells(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Working form of ``df``: numerics as doubles, NaN as null, nothing touched yet."""
    return untouched(base_cells(df, spec), spec)


def free(c: str) -> Column:
    return F.col(f"__dim_{c}").isNull()


def cell_tie(c: str) -> Column:
    return F.concat(F.col("__row"), F.lit(":" + c))


def each_cell(work: DataFrame, columns: Sequence[Column | str], cells: Sequence[Column], place: bool = False) -> DataFrame:
    """A row (columns, ``cell``) for each of ``cells`` that is not null, with its ``place`` if asked for.

    The cells are made by a projection of their own: what stands inside a generator is interpreted where
    the long projections of cells keep Spark from making one method of the stage. The outer form adds no
    filter on the size of the array, which would make all cells a second time.
    """
    made = work.select(*columns, F.array(*cells).alias("__cells"))
    kept = made.columns[:-1]
    cell = F.posexplode_outer("__cells").alias("place", "cell") if place else F.explode_outer("__cells").alias("cell")
    return made.select(*kept, cell).filter(F.col("cell").isNotNull())


def candidates(work: DataFrame, keys: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Long form (groups, key, tie) of the cells that may be chosen; null keys are left out.

    The tie is built after the explode, so a pass that only counts keys never makes it.
    """
    names = F.array(*[F.lit(f":{c}") for c in keys])
    long = each_cell(work, [*groups, "__row"], list(keys.values()), place=True)
    return long.select(*groups, F.col("cell").alias("key"), F.concat("__row", F.element_at(names, F.col("place") + 1)).alias("tie"))


def write_cells(
    work: DataFrame, cut: Cut | GroupedCut, keys: dict[str, Column], values: dict[str, Column], dimension: str
) -> DataFrame:
    """Put the new value and the tag into every cell the cut selects."""
    # two projections, so that each hit is decided once
    marked = cut.attach(work).withColumns({f"__hit_{c}": cut.keeps(k, cell_tie(c)) for c, k in keys.items()})
    changed: dict[str, Column] = {}
    for c in keys:
        hit = F.col(f"__hit_{c}")
        changed[c] = F.when(hit, values[c]).otherwise(F.col(c))
        changed[f"__dim_{c}"] = F.when(hit, F.lit(dimension)).otherwise(F.col(f"__dim_{c}"))
    return cut.detach(marked.withColumns(changed)).drop(*[f"__hit_{c}" for c in keys])


def as_text(work: DataFrame, columns: list[str]) -> DataFrame:
    return work.withColumns({c: F.col(c).cast("string") for c in columns})


def close_cells(work: DataFrame, spec: TableSpec, columns: list[str]) -> Degraded:
    """Degraded table with the original columns, plus the touched cells."""
    cells = []
    for c in spec.predictors:
        body = [F.col(f"__was_{c}").cast("string").alias("before"), F.col(c).cast("string").alias("after")]
        for dim in (F.when(F.col(f"__cpy_{c}"), F.lit("uniqueness")), F.col(f"__dim_{c}")):
            cells.append(F.when(dim.isNotNull(), F.struct(F.lit(c).alias("column"), dim.alias("dimension"), *body)))
    touched = each_cell(work, [F.col("__row").alias("row_id")], cells).select(
        "row_id", "cell.column", "cell.dimension", "cell.before", "cell.after"
    )
    return Degraded(work.select(*columns), touched, work)


def nothing_touched(df: DataFrame) -> Degraded:
    return Degraded(df, df.sparkSession.createDataFrame([], TOUCHED_SCHEMA))
