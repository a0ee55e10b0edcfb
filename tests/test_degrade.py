"""Invariants of the degradation operators."""

import math

import pytest
from pyspark.sql import functions as F

from tarnish.functions.hashing import HASH_SETTING
from tarnish.operators import checks, composite, degrade
from tarnish.operators.scenario import degrade_splits
from tarnish.spec import ICU_COHORT, ICU_FLAGS, ICU_NUMERIC, INVALID_CATEGORY, INVALID_FLAG, INVALID_TEXT, TableSpec

IDS = list(ICU_COHORT.ids)
N, P = 240, 19


def rows_of(df):
    return {r["stay_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("name", list(degrade.OPERATORS))
def test_contract(icu, name):
    op = degrade.OPERATORS[name]
    out = op(icu, ICU_COHORT, 0.15, 4)
    assert out.df.columns == icu.columns and out.df.count() == N
    cells = out.touched.collect()
    assert len({(r["row_id"], r["column"]) for r in cells}) == len(cells)
    assert {r["dimension"] for r in cells} == {name}
    before, after = rows_of(icu), rows_of(out.df)
    for c in [*IDS, "in_hospital_mortality"]:
        assert all(before[k][c] == after[k][c] for k in before)
    touched = {(int(r["row_id"].split("-")[2]), r["column"]) for r in cells}
    for k in before:
        for c in ICU_COHORT.predictors:
            b, a = before[k][c], after[k][c]
            if name == "validity" and c in ICU_NUMERIC and (k, c) not in touched:
                a = None if a is None else float(a)
            assert (b != a) == ((k, c) in touched), (k, c)
    # the same cells whatever the partitioning
    again = op(icu.repartition(2), ICU_COHORT, 0.15, 4)
    assert sorted(again.touched.collect()) == sorted(cells)
    assert sorted(op(icu, ICU_COHORT, 0.15, 5).touched.collect()) != sorted(cells)


@pytest.mark.parametrize("name", list(degrade.OPERATORS))
def test_density_limits(icu, name):
    out = degrade.OPERATORS[name](icu, ICU_COHORT, 0.0, 1)
    assert out.df is icu and out.touched.count() == 0
    with pytest.raises(ValueError):
        degrade.OPERATORS[name](icu, ICU_COHORT, 1.5, 1)


def test_budgets(icu):
    held = N * P - checks.missing_cells(icu, ICU_COHORT.predictors).collect()[0]["n_missing"]
    assert degrade.completeness(icu, ICU_COHORT, 0.15, 4).touched.count() == int(0.15 * N * P)
    assert degrade.completeness(icu, ICU_COHORT, 1.0, 4).touched.count() == held
    assert degrade.validity(icu, ICU_COHORT, 0.15, 4).touched.count() == round(0.15 * N * P)
    numeric = N * 18 - checks.missing_cells(icu, ICU_NUMERIC).collect()[0]["n_missing"]
    assert degrade.precision(icu, ICU_COHORT, 0.15, 4).touched.count() == round(0.15 * numeric)
    assert degrade.precision(icu, ICU_COHORT, 1.0, 4).touched.count() == numeric
    assert degrade.coherence(icu, ICU_COHORT, 0.15, 4).touched.count() == 2 * math.ceil(round(0.15 * N * 18) / 2)
    n = degrade.uniqueness(icu, ICU_COHORT, 0.15, 4).touched.count()
    assert round(0.15 * N * P) <= n < round(0.15 * N * P) + P


def test_severe_rows_lose_more_cells(icu):
    out = degrade.completeness(icu, ICU_COHORT, 0.2, 4).touched
    lost = {r["row_id"]: r["n"] for r in out.groupBy("row_id").agg(F.count("*").alias("n")).collect()}
    severe, mild = [], []
    for r in icu.collect():
        n = lost.get(f"{r['subject_id']}-{r['hadm_id']}-{r['stay_id']}", 0)
        (severe if r["norepinephrine"] == 1 else mild).append(n)
    assert sum(severe) / len(severe) > 4 * sum(mild) / len(mild)


def test_tokens(icu):
    cells = degrade.validity(icu, ICU_COHORT, 0.5, 4).touched.collect()
    for r in cells:
        if r["column"] == "gender":
            assert r["after"] in INVALID_CATEGORY
        elif r["column"] in ICU_FLAGS:
            assert r["after"] in INVALID_TEXT + INVALID_FLAG
        else:
            assert r["after"] in INVALID_TEXT
    flags = [r["after"] in INVALID_FLAG for r in cells if r["column"] in ICU_FLAGS]
    assert 0.3 < sum(flags) / len(flags) < 0.5
    only = degrade.validity(icu, ICU_COHORT, 0.5, 4, kinds={"typing": 0.0, "bool_ood": 1.0}).touched
    assert {r["after"] for r in only.filter(F.col("column").isin(ICU_FLAGS)).collect()} <= set(INVALID_FLAG)


def test_swaps_exchange_two_cells_of_a_row(icu):
    out = degrade.coherence(icu, ICU_COHORT, 0.3, 4)
    before, after = rows_of(icu), rows_of(out.df)
    for k in before:
        b, a = before[k], after[k]
        assert sorted(str(b[c]) for c in ICU_NUMERIC) == sorted(str(a[c]) for c in ICU_NUMERIC)
        for x, y in ICU_COHORT.swaps:
            assert (a[x], a[y]) in ((b[x], b[y]), (b[y], b[x]))
        assert sum(b[f] for f in ICU_FLAGS) == sum(a[f] for f in ICU_FLAGS)
    # a request beyond the ceiling swaps whatever can be swapped, once
    most = degrade.coherence(icu, ICU_COHORT, 1.0, 4).touched.count()
    possible = 0
    for r in before.values():
        possible += sum(r[x] is not None and r[y] is not None and r[x] != r[y] for x, y in ICU_COHORT.swaps)
        ones = sum(r[f] for f in ICU_FLAGS)
        possible += int(min(ones, 4 - ones))
    assert most == 2 * possible


def test_overlapping_swap_rules_move_a_cell_once(icu):
    from dataclasses import replace

    spec = replace(ICU_COHORT, swaps=[("age", "hr_mean"), ("hr_mean", "rr_mean"), ("rr_mean", "age")], flags=ICU_FLAGS)
    cells = degrade.coherence(icu, spec, 0.5, 2).touched.collect()
    assert len({(r["row_id"], r["column"]) for r in cells}) == len(cells)


def test_copies_come_from_clean_records(icu):
    out = degrade.uniqueness(icu, ICU_COHORT, 0.3, 4)
    before, after = rows_of(icu), rows_of(out.df)
    originals = {tuple(b[c] for c in ICU_COHORT.predictors) for b in before.values()}
    assert all(tuple(a[c] for c in ICU_COHORT.predictors) in originals for a in after.values())


def test_fast_hash_gives_the_same_budget(spark, icu):
    spark.conf.set(HASH_SETTING, "xxhash64")
    try:
        assert degrade.completeness(icu, ICU_COHORT, 0.15, 4).touched.count() == int(0.15 * N * P)
    finally:
        spark.conf.unset(HASH_SETTING)


def test_largest_remainder():
    assert composite.largest_remainder(10, [0.25, 0.25, 0.5]) == [3, 2, 5]
    assert sum(composite.largest_remainder(3500, list(composite.OBSERVED_PROFILE.values()))) == 3500
    with pytest.raises(ValueError):
        composite.normalised({"nonsense": 1.0})
    with pytest.raises(ValueError):
        composite.normalised({"validity": 0.0})


def test_mixed_touches_each_row_in_one_dimension(icu):
    weights = {"completeness": 0.4, "validity": 0.2, "precision": 0.2, "coherence": 0.1, "uniqueness": 0.1}
    out = composite.mixed(icu, ICU_COHORT, 0.3, 4, weights)
    assert out.df.count() == N
    per_row = out.touched.groupBy("row_id").agg(F.count_distinct("dimension").alias("n"))
    assert per_row.agg(F.max("n")).collect()[0][0] == 1
    sizes = composite.with_stratum(icu, ICU_COHORT, weights, 4).groupBy("stratum").count().collect()
    assert {r["stratum"]: r["count"] for r in sizes} == {"completeness": 96, "validity": 48, "precision": 48, "coherence": 24, "uniqueness": 24}


def test_cumulative_budgets_and_distinct_cells(icu):
    weights = {d: 0.2 for d in composite.DIMENSIONS}
    out = composite.cumulative(icu, ICU_COHORT, 0.3, 4, weights)
    total = round(0.3 * N * P)
    counts = {r["dimension"]: r["n"] for r in out.touched.groupBy("dimension").agg(F.count("*").alias("n")).collect()}
    target = round(0.2 * total)
    assert counts["completeness"] == counts["precision"] == counts["validity"] == target
    assert abs(counts["coherence"] - target) <= 1 and target <= counts["uniqueness"] < target + P
    cell_level = out.touched.filter("dimension <> 'uniqueness'")
    assert cell_level.count() == cell_level.select("row_id", "column").distinct().count()


def test_copies_last_inherit_defects(icu):
    weights = {"completeness": 0.5, "uniqueness": 0.3, "precision": 0.2}
    work = composite.cumulative_copies_last_cells(icu, ICU_COHORT, 0.4, 4, weights)
    rows = {r["__row"]: r for r in work.collect()}
    copied = [r for r in rows.values() if r["__donor"] is not None]
    assert copied
    for r in copied:
        donor = rows[r["__donor"]]
        if donor["__donor"] is None:
            assert all(r[c] == donor[c] and r[f"__dim_{c}"] == donor[f"__dim_{c}"] for c in ICU_COHORT.predictors)
    stats = composite.composite_stats(work, ICU_COHORT).collect()[0]
    assert stats["n_duplicates"] == len(copied)
    assert stats["cells_completeness"] == round(0.5 * round(0.4 * N * P))
    assert 0 < stats["share_duplicates_inheriting"] <= 1
    assert stats["share_rows_two_types"] <= stats["share_rows_any_defect"] <= 1


def test_partial_repair_restores_values(icu):
    share = 1 - 2 / 15
    weights = {"completeness": 0.9, "precision": 0.1}
    out = composite.cumulative_copies_last(icu, ICU_COHORT, 0.3, 4, weights, completeness_repair=share)
    k = round(0.9 * round(0.3 * N * P))
    cells = out.touched.collect()
    repaired = [r for r in cells if r["dimension"] == "repaired"]
    assert len(repaired) == round(share * k)
    assert all(r["before"] == r["after"] for r in repaired)
    assert sum(r["dimension"] == "completeness" for r in cells) == k - len(repaired)


def test_composites_hold_only_uniforms_in_reach(icu, monkeypatch):
    """A uniform that no boundary can reach is not written; should too few be left, all are drawn again."""
    n = icu.count()
    target = composite._budgets(0.1, composite.OBSERVED_PROFILE, n, P)
    work = composite._prepared(composite.open_cells(icu, ICU_COHORT), ICU_COHORT, target, 5, n)
    held = work.select(*[F.count(f"__u_validity_{c}").alias(c) for c in ICU_COHORT.predictors]).first()
    assert target["validity"] <= sum(held) < n * P / 10

    def rows():
        work = composite.cumulative_copies_last_cells(icu, ICU_COHORT, 0.1, 5, completeness_repair=0.5)
        return sorted(map(str, work.select("__row", *ICU_COHORT.predictors, *[f"__dim_{c}" for c in ICU_COHORT.predictors]).collect()))

    usual = rows()
    monkeypatch.setattr(composite, "SLACK", 0.1)
    assert rows() == usual


def test_scenarios(icu):
    df = icu.withColumn("split", F.when(F.col("stay_id") % 3 == 0, "test").otherwise("train"))
    for scenario, sides in (("S1", {"train"}), ("S2", {"test"}), ("S3", {"train", "test"})):
        out = degrade_splits(df, "split", degrade.completeness, ICU_COHORT, 0.2, scenario)
        split_of = {f"{r['subject_id']}-{r['hadm_id']}-{r['stay_id']}": r["split"] for r in df.collect()}
        assert {split_of[r["row_id"]] for r in out.touched.collect()} == sides
        assert out.df.count() == N


def test_copies_keep_the_rows_of_repeated_ids(spark):
    spec = TableSpec(ids=["id"], numeric=["a", "b"], categorical=[])
    df = spark.createDataFrame([(i % 200, float(i % 7), float(i % 11)) for i in range(400)], "id long, a double, b double")
    out = degrade.uniqueness(df, spec, 0.2, 5)
    assert out.df.count() == 400 and out.touched.count() > 0


def test_swaps_are_picked_by_plain_comparisons(icu):
    """What is taken of the options that share cells, against a greedy loop over all of them."""
    spec, work = ICU_COHORT, degrade.open_cells(icu, ICU_COHORT)
    listed = degrade.with_swaps(work, spec, 4)
    assert "lambda" not in listed._jdf.queryExecution().analyzed().toString()
    options = degrade._swap_options(spec)
    lightest = min(rate for _, _, rate in options)
    every = {}
    for i, (a, b, rate) in enumerate(options):
        u = degrade.unit(degrade.wide_bits(degrade.digest(4, F.col("__row"), f"{a}~{b}")))
        every[f"all_{i}"] = F.when(F.col(a) != F.col(b), degrade.exponential_rank(u, F.lit(rate), lightest))
    got = listed.withColumns(every).collect()
    assert any(r[c] is not None for r in got for c in degrade.swap_columns(spec))
    for r in got:
        used, kept = set(), set()
        for key, tie, i in sorted((r[f"all_{i}"], f"{a}~{b}", i) for i, (a, b, _) in enumerate(options) if r[f"all_{i}"] is not None):
            if not used & set(options[i][:2]):
                used |= set(options[i][:2])
                kept.add((i, key))
        assert kept == {(i, r[c]) for i, c in enumerate(degrade.swap_columns(spec)) if r[c] is not None}


def test_copies_pair_only_rows_in_reach(icu, monkeypatch):
    """Rows that the budget cannot reach are not paired; should too few be, more are."""
    sizes, follow = [], degrade.follow_donors

    def counted(pairs, groups=()):
        sizes.append(pairs.count())
        return follow(pairs, groups)

    def touched():
        return sorted(map(str, degrade.uniqueness(icu, ICU_COHORT, 0.1, 4).touched.collect()))

    monkeypatch.setattr(degrade, "follow_donors", counted)
    usual = touched()
    assert usual and sizes[0] < N / 2 and len(sizes) == 1
    for slack in (0.3, 100.0):
        monkeypatch.setattr(degrade, "COPY_SLACK", slack)
        assert touched() == usual
    assert max(sizes) > N / 2 and len(sizes) > 3
