"""Many groups in one plan, donor chains and long ties against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tarnish.catalog.scenarios import SPEC, order_cohort
from tarnish.operators import degrade, resample, scenario
from tarnish.operators.degrade import follow_donors
from tarnish.operators.selection import cut_smallest, cut_smallest_by


def kept(rows, need):
    """(key, tie) of the rows whose earlier amounts stay below ``need``."""
    out, before = set(), 0
    for key, tie, amount in sorted(r for r in rows if r[0] is not None):
        if before < need:
            out.add((key, tie))
        before += amount
    return out


@pytest.mark.parametrize("narrow", [3, 4096])
def test_one_boundary_per_group(spark, narrow):
    rng = random.Random(narrow)
    rows = []
    for g in range(12):
        for i in range(rng.choice([1, 7, 400])):
            key = None if i % 50 == 9 else 0.25 if g == 5 else rng.choice([rng.random(), rng.random() / 1e4, 0.125])
            rows.append((g % 4, f"h{g // 4}", key, f"t{i}", rng.randint(1, 5)))
    df = spark.createDataFrame(rows, "g int, h string, key double, tie string, amount long").repartition(3)
    sizes = df.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n_rows"))
    share = {0: 0.0, 1: 0.3, 2: 0.9, 3: 2.0}
    budget = lambda total: F.floor(total * F.coalesce(*[F.when(F.col("g") == g, F.lit(s)) for g, s in share.items()]))
    cut = cut_smallest_by(df, ["g", "h"], budget, sizes, digits=16, narrow=narrow)
    got = cut.attach(df).filter(cut.keeps(F.col("key"), F.col("tie"))).select("g", "h", "key", "tie").collect()
    groups = defaultdict(list)
    for g, h, *rest in rows:
        groups[g, h].append(tuple(rest))
    for (g, h), cells in groups.items():
        total = sum(a for k, _, a in cells if k is not None)
        mine = [(r["key"], r["tie"]) for r in got if (r["g"], r["h"]) == (g, h)]
        assert len(mine) == len(set(mine)) and set(mine) == kept(cells, int(total * share[g]))


def test_long_ties_without_a_global_window(spark):
    df = spark.range(20000).select(F.lit(0.5).alias("key"), F.concat(F.lit("t"), "id").alias("tie"))
    cut = cut_smallest(df, 7000)
    chosen = {r["tie"] for r in df.filter(cut.keeps(F.col("key"), F.col("tie"))).collect()}
    assert chosen == set(sorted(f"t{i}" for i in range(20000))[:7000])


def test_donor_chains_follow_the_order_of_the_draw(spark):
    rng = random.Random(8)
    rows = []
    for g in range(2):
        n = 120
        donors = [rng.randrange(n) for _ in range(n)]
        keys = [i / n for i in range(n)] if g else [rng.random() for _ in range(n)]
        if g:  # one chain over all targets, then a circle back to the first
            donors = [n - 1, *range(n - 1)]
        rows += [(g, f"r{i}", f"r{d}", k) for i, (d, k) in enumerate(zip(donors, keys)) if d != i]
    df = spark.createDataFrame(rows, "g int, __row string, __donor string, key double")
    got = {(r["g"], r["__row"]): r["__end"] for r in follow_donors(df, ["g"]).collect()}
    held = {}
    for g, row, donor, _ in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        held[g, row] = held.get((g, donor), donor)
    assert got == held and len({v for (g, _), v in held.items() if g}) == 1


@pytest.mark.parametrize("name", list(degrade.OPERATORS))
def test_all_replicates_equal_each_by_itself(spark, name):
    df = order_cohort(spark, "/root/testdata/sf0.001").filter("o_orderkey % 3 = 0")
    split = resample.bootstrap(df, SPEC.ids, 2)
    rows = scenario.replicate_rows(df, split, SPEC.ids).cache()
    op = degrade.OPERATORS[name]
    together = scenario.degrade_replicates(rows, SPEC, 0.2, {name: op})[name]
    values = [F.col(c).cast("string").alias(c) for c in SPEC.predictors]
    got = defaultdict(list)
    for r in together.work.select("replicate", "side", "__row", *values).collect():
        got[r["replicate"], r["side"]].append(tuple(r)[2:])
    one = replace(SPEC, ids=["o_orderkey", "copy"])
    for side, seed in scenario.SEEDS.items():
        alone = op(rows.filter((F.col("replicate") == 1) & (F.col("side") == side)), one, 0.2, seed + 1).work
        expected = [tuple(r) for r in alone.select("__row", *values).collect()]
        order = lambda rs: sorted(rs, key=lambda r: tuple(str(v) for v in r))
        assert order(got[1, side]) == order(expected)
    cells = scenario.scenario_cells({name: together}, SPEC)
    sides = {(r["scenario"], r["side"]) for r in cells.select("scenario", "side").distinct().collect()}
    assert sides == {("S1", "train"), ("S2", "test"), ("S3", "train"), ("S3", "test")}
    rows.unpersist()
