"""Survival metrics: concordance, Breslow hazard, censoring law, Brier scores.

Everything rests on prefix sums over time (or score), so no group has to fit in a task.
Input tables have ``time`` (double), ``event`` (boolean) and, where needed, ``risk`` or
``eta`` (log risk).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnish.operators.ordering import column_quantiles, prefix_sums

# Horizons in days, integration grid, smallest evaluable set.
HORIZONS = [7.0, 14.0, 30.0, 60.0]
GRID_POINTS = 50
GRID_QUANTILES = (0.05, 0.90)
MIN_EVENTS = 10
MIN_SUBJECTS = 20
CLIP = 20.0


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, k: a & left[k].eqNullSafe(right[k]), keys, F.lit(True))


def c_index(pred: DataFrame, groups: Sequence[str], **size) -> DataFrame:
    """Concordance index per group: comparable and concordant pairs, ties count half.

    A pair is comparable when the earlier subject has an event (an event also precedes a
    censoring at the same time). Pairs are never formed: subjects get a time slot, and
    for each binary digit of the slot the pairs that first differ in that digit are one
    rank-sum problem between the two halves of a slot block. A row takes part once per
    digit, so the work is n log n and spreads over blocks.
    """
    groups = list(groups)
    seen = pred.filter(F.col("risk").isNotNull() & F.col("time").isNotNull())
    counted = seen.groupBy(*groups, "time", "event", "risk").agg(F.count(F.lit(1)).alias("__n"))
    times = counted.groupBy(*groups, "time").agg(F.lit(1).alias("one"))
    slots = prefix_sums(times, groups, "time", ["one"], **size)
    last = slots.agg(F.max("before_one")).collect()[0][0]
    if last is None:
        last = 0
    depth = max(1, int(2 * last + 1).bit_length())
    slotted = (
        counted.join(slots.select(*groups, "time", "before_one"), [*groups, "time"])
        .withColumn("slot", 2 * F.col("before_one") + F.when(F.col("event"), 0).otherwise(1))
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
    digits = slotted.select(*groups, "event", "risk", "__n", "slot", levels.alias("level"))
    late = F.col("slot").bitwiseAND(F.expr("shiftleft(1L, level)")) != 0
    block = F.expr("shiftright(slot, level + 1)")
    sides = (
        digits.select(*groups, "level", block.alias("block"), "risk", "__n", "event", late.alias("late"))
        .filter(F.col("late") | F.col("event"))
        .groupBy(*groups, "level", "block", "risk")
        .agg(
            F.sum(F.when(~F.col("late"), F.col("__n")).otherwise(0)).alias("early"),
            F.sum(F.when(F.col("late"), F.col("__n")).otherwise(0)).alias("late"),
        )
    )
    placed = prefix_sums(sides, [*groups, "level", "block"], "risk", ["early", "late"], **size)
    early = F.col("early").cast("double")
    sums = placed.groupBy(*groups).agg(
        F.sum(early * (F.col("before_late") + F.col("late") / 2)).alias("concordant"),
        F.sum(early * F.col("total_late")).alias("comparable"),
    )
    return sums.withColumn("c_index", F.col("concordant") / F.nullif(F.col("comparable"), F.lit(0.0)))


def relative_risk(eta: Column, center: Column) -> Column:
    """exp of the centred log risk, clipped; a missing log risk counts as average."""
    centred = F.coalesce(eta, center) - center
    return F.exp(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), centred)))


def risk_centers(train: DataFrame, groups: Sequence[str]) -> DataFrame:
    finite = F.when(F.col("eta").isNotNull() & ~F.isnan("eta") & (F.abs("eta") < float("inf")), F.col("eta"))
    return train.groupBy(*groups).agg(F.coalesce(F.avg(finite), F.lit(0.0)).alias("center"))


def breslow(train: DataFrame, groups: Sequence[str], **size) -> DataFrame:
    """Breslow baseline hazard per group: (groups, time, hazard, center) at event times.

    The risk set at t is the total risk minus the risk of those who left before t. A
    group without events has no rows.
    """
    groups = list(groups)
    centers = risk_centers(train, groups)
    if groups:
        rows = train.join(centers, groups)
    else:
        rows = train.withColumn("center", F.lit(centers.collect()[0]["center"]))
    by_time = rows.groupBy(*groups, "time").agg(
        F.sum(relative_risk(F.col("eta"), F.col("center"))).alias("risk"),
        F.sum(F.col("event").cast("long")).alias("events"),
        F.max("center").alias("center"),
    )
    at_risk = prefix_sums(by_time, groups, "time", ["risk"], **size)
    left = F.col("total_risk") - F.col("before_risk")
    steps = at_risk.filter((F.col("events") > 0) & (left > 0)).select(
        *groups, "time", "center", (F.col("events") / left).alias("step")
    )
    summed = prefix_sums(steps, groups, "time", ["step"], **size)
    return summed.select(*groups, "time", (F.col("before_step") + F.col("step")).alias("hazard"), "center")


def hazard_at(baseline: DataFrame, groups: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Hazard at given times: linear between event times, 0 before, the last value after.

    Each event row meets the (few) points and is reduced to the nearest neighbours on
    both sides by one combinable aggregation; no ordered pass over the group.
    """
    grid = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    here = F.struct("time", "hazard")
    near = (
        baseline.select(*groups, "time", "hazard", "center", grid.alias("point"))
        .groupBy(*groups, "point")
        .agg(
            F.max(F.when(F.col("time") <= F.col("point"), here)).alias("lo"),
            F.min(F.when(F.col("time") > F.col("point"), here)).alias("hi"),
            F.max("center").alias("center"),
        )
    )
    slope = (F.col("hi.hazard") - F.col("lo.hazard")) / (F.col("hi.time") - F.col("lo.time"))
    between = F.col("lo.hazard") + (F.col("point") - F.col("lo.time")) * slope
    value = F.when(F.col("lo").isNull(), F.lit(0.0)).when(F.col("hi").isNull(), F.col("lo.hazard")).otherwise(between)
    return near.select(*groups, "point", value.alias("hazard"), "center")


def censoring_law(reference: DataFrame, **size) -> DataFrame:
    """Kaplan-Meier estimate of staying uncensored at each time of the reference.

    At tied times events leave the risk set before censorings. ``log_factor`` and
    ``zero`` hold the step, so the law can be re-summed at other times.
    """
    by_time = reference.groupBy("time").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("event")).alias("censored")
    )
    placed = prefix_sums(by_time, [], "time", ["rows"], **size)
    events = F.col("rows") - F.col("censored")
    left = F.col("total_rows") - F.col("before_rows") - events
    factor = F.when(F.col("censored") > 0, 1 - F.col("censored") / left).otherwise(F.lit(1.0))
    steps = placed.select(
        "time",
        F.when(factor > 0, F.ln(factor)).otherwise(F.lit(0.0)).alias("log_factor"),
        F.when(factor > 0, 0).otherwise(1).alias("zero"),
    )
    return uncensored_at(steps, None, **size)


def uncensored_at(steps: DataFrame, times: DataFrame | None, **size) -> DataFrame:
    """The censoring law at extra times (as-of lookup): the steps are summed over the
    union of both time lists, extra times adding nothing of their own."""
    rows = steps.select("time", "log_factor", "zero")
    if times is not None:
        extra = times.select("time", F.lit(0.0).alias("log_factor"), F.lit(0).alias("zero"))
        rows = rows.unionByName(extra)
    merged = rows.groupBy("time").agg(F.sum("log_factor").alias("log_factor"), F.sum("zero").alias("zero"))
    placed = prefix_sums(merged, [], "time", ["log_factor", "zero"], **size)
    alive = F.exp(F.col("before_log_factor") + F.col("log_factor"))
    gone = (F.col("before_zero") + F.col("zero")) > 0
    return placed.select("time", "log_factor", "zero", F.when(gone, F.lit(0.0)).otherwise(alive).alias("uncensored"))


def integration_grid(clean: DataFrame, points: int = GRID_POINTS) -> list[float]:
    """Times over which the Brier score is integrated, fixed once on the clean cohort."""
    events = clean.filter("event")
    basis = events if events.limit(MIN_EVENTS).count() >= MIN_EVENTS else clean
    lo, hi = column_quantiles(basis, ["time"], list(GRID_QUANTILES))["time"]
    top = clean.agg(F.max("time")).collect()[0][0]
    lo = max(lo, 1e-3)
    if hi <= lo:
        lo, hi = 1.0, max(2.0, top * 0.9)
    hi = min(hi, top * (1 - 1e-9))
    step = (hi - lo) / (points - 1)
    return [lo + i * step for i in range(points - 1)] + [hi]


def brier_scores(
    pred: DataFrame,
    groups: Sequence[str],
    reference: DataFrame,
    baseline: DataFrame,
    points: Sequence[float],
) -> DataFrame:
    """Censoring-weighted Brier score per group and time point.

    Subjects beyond the reference's largest time are left out. Groups with fewer than 20
    subjects or no event, and points outside the reference, give no row.
    """
    groups = list(groups)
    window = reference.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).collect()[0]
    points = [p for p in points if window["lo"] <= p < window["hi"]]
    kept = pred.filter(F.col("time") <= F.lit(window["hi"]))
    sizes = kept.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.count_if("event").alias("__e"))
    usable = sizes.filter((F.col("__n") >= MIN_SUBJECTS) & (F.col("__e") > 0)).select(*groups)
    law = censoring_law(reference)
    spark = pred.sparkSession
    wanted = kept.select("time").distinct().unionByName(spark.createDataFrame([(float(p),) for p in points], "time double"))
    known = uncensored_at(law, wanted.distinct())
    # one row per (group, point): the hazards and the law at the points
    at_points = hazard_at(baseline, groups, points).join(
        known.select(F.col("time").alias("point"), F.col("uncensored").alias("g_point")), "point"
    )
    weighed = kept.join(usable, groups, "left_semi").join(
        known.select("time", F.col("uncensored").alias("g_time")), "time"
    )
    rows = weighed.join(at_points, groups)
    survival = F.exp(-F.col("hazard") * relative_risk(F.col("eta"), F.col("center")))
    case = F.col("event") & (F.col("time") <= F.col("point"))
    control = F.col("time") > F.col("point")
    term = (
        F.when(case & (F.col("g_time") > 0), survival * survival / F.col("g_time"))
        .when(control & (F.col("g_point") > 0), (1 - survival) * (1 - survival) / F.col("g_point"))
        .otherwise(F.lit(0.0))
    )
    return rows.groupBy(*groups, "point").agg(F.avg(term).alias("brier"))


def integrated(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Trapezoidal mean of a Brier curve over its (few) points."""
    w = Window.partitionBy(*groups).orderBy("point")
    area = (F.lead("point").over(w) - F.col("point")) * (F.lead("brier").over(w) + F.col("brier")) / 2
    return scores.withColumn("area", area).groupBy(*groups).agg(
        (F.sum("area") / (F.max("point") - F.min("point"))).alias("ibs")
    )
