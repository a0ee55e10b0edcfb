"""Exact-budget selection without a global sort.

``cut_smallest`` finds the boundary of "the rows with the smallest keys whose amounts
add up to the budget" by counting rows per key interval and zooming into the interval
that holds the boundary, until that has so few rows that they can be looked at. Each pass
is one partial aggregation with a bounded result; the outcome is a literal, so applying
the selection is a plain filter. ``cut_smallest_by`` does the same for many groups at once
and leaves a table of boundaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnish.session import staged

BUCKETS = 1 << 14
#: Key intervals per group and pass where there are many groups, and rows of an interval that may be ranked.
GROUP_BUCKETS, NARROW = 1 << 8, 1 << 12
#: Rows of an interval that are looked at on the driver.
LOOKED_AT = 1 << 15


@dataclass(frozen=True)
class Cut:
    """Boundary of a selection: everything up to and including (key, tie)."""

    key: float | None
    tie: str | None
    total: int
    everything: bool = False

    def keeps(self, key: Column, tie: Column) -> Column:
        """True for selected rows; a null key is never selected."""
        if self.everything:
            return key.isNotNull()
        if self.key is None:
            return F.lit(False)
        edge = F.lit(self.key)
        # one comparison settles most rows, so that a key that is costly to make is made once
        return F.coalesce((key <= edge) & ((key < edge) | (tie <= F.lit(self.tie))), F.lit(False))

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` as they are: the boundary is a literal."""
        return rows

    def detach(self, rows: DataFrame) -> DataFrame:
        return rows


NOTHING = Cut(None, None, 0)


def _digit(key: Column, low: float, width: float) -> Column:
    raw = F.floor((key - F.lit(low)) / F.lit(width) * F.lit(float(BUCKETS)))
    return F.greatest(F.lit(0), F.least(raw, F.lit(BUCKETS - 1))).cast("int")


def cut_smallest(candidates: DataFrame, budget: int | Callable[[int], int], upto: float = 1.0) -> Cut:
    """Boundary of the smallest-key rows of ``candidates(key, tie[, amount])``.

    ``key`` is a double in (0, 1) and (key, tie) is unique. A row is kept while the
    amounts before it (1 per row if there is no such column) add up to less than the
    budget. ``budget`` may be a function of the total amount. ``upto`` is a key that the boundary
    hardly exceeds: the first pass counts finely up to there, and all keys beyond in one interval.
    """
    if "amount" not in candidates.columns:
        candidates = candidates.withColumn("amount", F.lit(1))
    current = candidates.filter(F.col("key").isNotNull())
    low, width, need, total = 0.0, upto, None, 0
    while True:
        # numbers only: a text among the aggregates would make Spark sort all rows
        counts = sorted(
            current.groupBy(_digit(F.col("key"), low, width).alias("digit"))
            .agg(
                F.sum("amount").alias("amount"),
                F.min("key").alias("first"),
                F.max("key").alias("last"),
                F.count(F.lit(1)).alias("n"),
            )
            .collect()
        )
        if need is None:
            total = sum(r["amount"] for r in counts)
            need = budget(total) if callable(budget) else budget
            if need <= 0:
                return Cut(None, None, total)
            if need > total:
                return Cut(None, None, total, everything=True)
        before = 0
        for row in counts:
            if before + row["amount"] >= need:
                break
            before += row["amount"]
        need -= before
        current = current.filter(F.col("key").between(F.lit(row["first"]), F.lit(row["last"])))
        if row["n"] <= LOOKED_AT:
            for edge in sorted(current.select("key", "tie", "amount").collect()):
                need -= edge["amount"]
                if need <= 0:
                    return Cut(edge["key"], edge["tie"], total)
        if row["first"] == row["last"]:
            break
        low, width = row["first"], row["last"] - row["first"]
    # rows of one key, possibly all of them: sorted by range, so that no task sees more than one range
    edge = running_amounts(current, [], ["tie"]).filter(F.col("running") >= F.lit(need)).orderBy("running", "tie").first()
    return Cut(edge["key"], edge["tie"], total)


def running_amounts(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``running``: the sum of ``amount`` up to and including a row, per group in ``order``.

    The rows are sorted by range and written; what a range holds of each group is summed up, and a
    window only runs inside a range. A group that holds all rows is spread over all ranges.
    """
    sort = [*groups, *order]
    at = F.monotonically_increasing_id()
    sorted_rows = staged(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", at))
    sorted_rows = sorted_rows.withColumn("__range", F.shiftright("__at", 33))
    held = sorted_rows.groupBy("__range", *groups).agg(F.sum("amount").alias("__held"))
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("__range", *groups, F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range", *groups).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sorted_rows.withColumn("running", F.sum("amount").over(inside)).join(held, ["__range", *groups])
    return local.withColumn("running", F.col("running") + F.col("__before")).drop("__at", "__range", "__before")


# ------------------------------------------------------------------ many groups


@dataclass(frozen=True)
class GroupedCut:
    """One boundary per group, as a table ``groups, __edge_key, __edge_tie, __edge_all``."""

    table: DataFrame
    groups: tuple[str, ...]

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the boundary of their group; a group without one selects nothing."""
        return rows.join(self.table, list(self.groups), "left")

    def keeps(self, key: Column, tie: Column) -> Column:
        """True for selected rows of an attached table; a null key is never selected."""
        edge = F.col("__edge_key")
        inside = (key <= edge) & ((key < edge) | (tie <= F.col("__edge_tie")))
        return F.coalesce((F.col("__edge_all") & key.isNotNull()) | inside, F.lit(False))

    def detach(self, rows: DataFrame) -> DataFrame:
        return rows.drop("__edge_key", "__edge_tie", "__edge_all")

    def literals(self) -> dict[tuple, Cut]:
        """The boundaries on the driver, for groups that are few by their nature."""
        edges = {tuple(r[g] for g in self.groups): r for r in self.table.collect()}
        return {g: Cut(r["__edge_key"], r["__edge_tie"], 0, r["__edge_all"]) for g, r in edges.items()}


def cut_smallest_by(
    candidates: DataFrame,
    groups: Sequence[str],
    budget: Callable[[Column], Column],
    sizes: DataFrame | None = None,
    digits: int = GROUP_BUCKETS,
    narrow: int = NARROW,
    upto: float = 1.0,
) -> GroupedCut:
    """What :func:`cut_smallest` does, for every group at once.

    ``candidates`` has the groups, ``key``, ``tie`` and perhaps ``amount``; ``budget`` maps the
    total amount to the group's budget and may use the columns of ``sizes``, one row per group.
    Every pass counts rows per group and key interval and leaves one interval per group, until
    no interval holds more than ``narrow`` rows; those are ranked. The number of passes follows
    the size of the largest group, not the number of groups, and only the largest count of an
    interval comes back to the driver.
    """
    groups = list(groups)
    if "amount" not in candidates.columns:
        candidates = candidates.withColumn("amount", F.lit(1).cast("long"))
    rows = candidates.filter(F.col("key").isNotNull()).select(*groups, "key", "tie", "amount")
    first = F.least(F.lit(digits - 1), F.floor(F.col("key") / F.lit(upto) * digits)).cast("int")
    cells = _histogram(rows.withColumn("digit", first), groups)
    totals = cells.groupBy(*groups).agg(F.sum("amount").alias("total"))
    totals = totals if sizes is None else totals.join(sizes, groups)
    needs = staged(totals.select(*groups, "total", budget(F.col("total")).cast("long").alias("need")))
    state = staged(_interval(cells, needs.filter("need > 0 and need <= total").drop("total"), groups))
    while (state.agg(F.max(F.when(F.col("low") < F.col("high"), F.col("n")))).first()[0] or 0) > narrow:
        open_ = state.filter(f"n > {narrow} and low < high")
        inside = rows.join(open_, groups).filter("key between low and high")
        digit = F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * digits)
        cells = _histogram(inside.withColumn("digit", F.least(F.lit(digits - 1), digit).cast("int")), groups)
        narrowed = _interval(cells, open_.select(*groups, "need"), groups)
        state = staged(narrowed.unionByName(state.join(open_.select(*groups), groups, "left_anti")))
    inside = rows.join(state, groups).filter("key between low and high")
    reached = running_amounts(inside.select(*groups, "key", "tie", "amount", "need"), groups, ["key", "tie"]).filter("running >= need")
    edge = reached.groupBy(*groups).agg(F.min(F.struct("key", "tie")).alias("edge"))
    none, all_ = needs.filter("need > total"), F.lit(True)
    table = edge.select(*groups, F.col("edge.key").alias("__edge_key"), F.col("edge.tie").alias("__edge_tie"), F.lit(False).alias("__edge_all"))
    whole = none.select(*groups, F.lit(None).cast("double").alias("__edge_key"), F.lit(None).cast("string").alias("__edge_tie"), all_.alias("__edge_all"))
    return GroupedCut(staged(table.unionByName(whole)), tuple(groups))


def _histogram(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.groupBy(*groups, "digit").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
    )


def _interval(cells: DataFrame, needs: DataFrame, groups: list[str]) -> DataFrame:
    """Per group the interval in which the amounts reach ``need``, and what is needed inside it."""
    upto = Window.partitionBy(*groups).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.withColumn("upto", F.sum("amount").over(upto)).join(needs, groups)
    hit = summed.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("amount") < F.col("need")))
    return hit.select(*groups, (F.col("need") - F.col("upto") + F.col("amount")).alias("need"), "n", "low", "high")
