"""Degrade the training side, the test side or both: one split table, or all replicates at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.operators.cells import Degraded, each_cell
from tarnish.operators.degrade import OPERATORS, DegradationOp
from tarnish.operators.resample import SEED_DEGRADE_TEST, SEED_DEGRADE_TRAIN, key_of
from tarnish.session import staged
from tarnish.spec import TableSpec

# Scenario -> sides that are degraded.
SCENARIOS = {"S1": ("train",), "S2": ("test",), "S3": ("train", "test")}
SEEDS = {"train": SEED_DEGRADE_TRAIN, "test": SEED_DEGRADE_TEST}
#: Columns that a replicate table has besides those of the table it was drawn from.
GROUPS = ("replicate", "side")


def degrade_splits(
    df: DataFrame, split: str, op: DegradationOp, spec: TableSpec, density: float, scenario: str, replicate: int = 0
) -> Degraded:
    """Degrade the sides a scenario names, each on its own, and put the table together.

    ``split`` holds "train" or "test". The target is no predictor of the spec, so it
    never enters the operator.
    """
    parts, touched = [], None
    for side in ("train", "test"):
        rows = df.filter(F.col(split) == side)
        if side in SCENARIOS[scenario]:
            out = op(rows, spec, density, SEEDS[side] + replicate)
            rows = out.df
            touched = out.touched if touched is None else touched.unionByName(out.touched)
        parts.append(rows)
    text = {c for p in parts for c, t in p.dtypes if t == "string"}
    whole = [p.select(*[F.col(c).cast("string").alias(c) if c in text else F.col(c) for c in df.columns]) for p in parts]
    return Degraded(whole[0].unionByName(whole[1]), touched)


def replicate_rows(df: DataFrame, split: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The rows of every replicate of a bootstrap: ``replicate``, ``side`` ("train" once per draw,
    "test" if never drawn), ``copy`` (number of the draw, 0 for test) and the columns of ``df``.

    ``split`` is what :func:`tarnish.operators.resample.bootstrap` returns for ``df``.
    """
    train = F.col("draws") > 0
    copies = F.when(train, F.sequence(F.lit(1), F.col("draws").cast("int"))).otherwise(F.array(F.lit(0)))
    side = F.when(train, F.lit("train")).otherwise(F.lit("test"))
    drawn = split.select("row_id", "replicate", side.alias("side"), F.explode(copies).alias("copy"))
    return df.withColumn("row_id", key_of(ids)).join(drawn, "row_id").drop("row_id")


def degrade_replicates(
    rows: DataFrame, spec: TableSpec, density: float, operators: Mapping[str, DegradationOp] = OPERATORS
) -> dict[str, Degraded]:
    """Every operator on every side of every replicate, one plan for each operator.

    ``rows`` comes from :func:`replicate_rows`. The sides are degraded independently, with the
    seeds of their replicates as a column, exactly as if each were a table of its own. How many
    jobs run depends on the size of the largest side and not on the number of replicates.
    """
    one = replace(spec, ids=[*spec.ids, "copy"])
    seeded = staged(rows.withColumn("__seed_of", F.when(F.col("side") == "train", F.lit(SEEDS["train"])).otherwise(SEEDS["test"]) + F.col("replicate")))
    return {name: op(seeded, one, density, F.col("__seed_of"), groups=GROUPS) for name, op in operators.items()}


def scenario_cells(degraded: Mapping[str, Degraded], spec: TableSpec) -> DataFrame:
    """The touched cells of every scenario: ``scenario, operator, replicate, side, row_id, column,
    after``. A scenario's table is the clean one with these cells replaced."""
    out = None
    pairs = [(s, side) for s, sides in SCENARIOS.items() for side in sides]
    scenarios = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(side).alias("of")) for s, side in pairs])
    for name, result in degraded.items():
        cells = [
            F.when(
                F.col(f"__cpy_{c}") | F.col(f"__dim_{c}").isNotNull(),
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("after")),
            )
            for c in spec.predictors
        ]
        long = each_cell(result.work, ["replicate", "side", F.col("__row").alias("row_id")], cells)
        each = long.withColumn("s", F.explode(scenarios)).filter(F.col("s.of") == F.col("side"))
        part = each.select("s.scenario", F.lit(name).alias("operator"), "replicate", "side", "row_id", "cell.column", "cell.after")
        out = part if out is None else out.unionByName(part)
    return out
