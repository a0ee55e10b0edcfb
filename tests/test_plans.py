"""Losses, contrasts, verdicts, arms, mixed model against small hand-made cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.operators import checks
from tarnish.plans import arms, contrasts, losses, mixed_model

DIMS = ["completeness", "coherence", "validity", "precision", "uniqueness"]


def grid(spark, rows):
    return spark.createDataFrame(rows, "dimension string, model string, level int, replicate int, auc double, brier double")


def test_paired_loss_signs_fanout_and_missing_baseline(spark):
    rows = [
        ("validity", "m", 0, 1, 0.9, 0.1), ("validity", "m", 3, 1, 0.7, 0.3),
        ("validity", "m", 0, 1, 0.8, 0.1),  # duplicated clean row fans out
        ("validity", "m", 3, 2, 0.7, 0.3),  # no clean row
        ("validity", "m", 5, 1, 0.1, 0.9),  # level of no interest
    ]
    out = losses.paired_loss(grid(spark, rows), {"auc": "higher", "brier": "lower"}, digits=6).collect()
    assert sorted((r["metric"], r["loss"]) for r in out) == [("auc", 0.1), ("auc", 0.2), ("brier", 0.2), ("brier", 0.2)]
    kept = losses.first_per_key(grid(spark, rows).withColumn("at", F.col("auc")), ["model", "replicate", "level"], "at")
    assert kept.count() == 4


def brute_signed_rank(diff):
    d = [x for x in diff if x != 0]
    if not d:
        return None
    sizes = sorted(abs(x) for x in d)
    rank = {v: np.mean([i + 1 for i, s in enumerate(sizes) if s == v]) for v in set(sizes)}
    up = sum(rank[abs(x)] for x in d if x > 0)
    return min(up, len(d) * (len(d) + 1) / 2 - up)


def diffs_df(spark, groups):
    rows = [(g, float(x)) for g, values in groups.items() for x in values]
    return spark.createDataFrame(rows, "g string, diff double")


@pytest.mark.parametrize("size", [{}, {"rows_per_bucket": 7}])
def test_signed_rank(spark, size):
    rng = random.Random(2)
    groups = {
        "exact": [0.3, -0.1, 0.5, 0.7, 0.9, 1.1],
        "ties": [1, 1, -1, 2, 2, -3, 0, 0],
        "zeros": [0, 0, 0],
        "large": [rng.gauss(0.3, 1) for _ in range(60)],
    }
    out = {r["g"]: r for r in contrasts.signed_rank(diffs_df(spark, groups), ["g"], **size).collect()}
    assert "zeros" not in out
    for g in ("exact", "ties", "large"):
        assert out[g]["wilcoxon_stat"] == pytest.approx(brute_signed_rank(groups[g]))
    # exact p by enumeration of all signs
    d = groups["exact"]
    stats = []
    for signs in itertools.product([1, -1], repeat=len(d)):
        up = sum(i + 1 for i, s in enumerate(signs) if s > 0)
        stats.append(min(up, 21 - up))
    assert out["exact"]["p_exact"] == pytest.approx(np.mean([s <= brute_signed_rank(d) for s in stats]))
    assert out["exact"]["untied"] and not out["ties"]["untied"]


def test_holm_with_nulls_and_equal_values(spark):
    rows = [("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, None), ("g", 1, 0.5), ("g", 2, 0.5)]
    df = contrasts.holm(spark.createDataFrame(rows, "fam string, i int, p_raw double"), ["fam"])
    got = {(r["fam"], r["i"]): r["p_holm"] for r in df.collect()}
    assert got[("f", 1)] == pytest.approx(0.03) and got[("f", 2)] == got[("f", 3)] == pytest.approx(0.06)
    assert got[("f", 4)] is None and got[("g", 1)] == got[("g", 2)] == 1.0


def shifted(spark, shift, models=("dt", "lin"), n=30, skip=()):
    rng = random.Random(4)
    rows = []
    for m in models:
        for b in range(n):
            for d in DIMS:
                if (m, d) not in skip:
                    rows.append(("auc", d, m, 3, b, shift[d] + rng.gauss(0, 0.01)))
    return spark.createDataFrame(rows, "metric string, dimension string, model string, level int, replicate int, loss double")


def test_contrasts_verdicts_and_families(spark):
    shift = dict(zip(DIMS, [0.30, 0.1, 0.1, 0.0, 0.1]))
    loss = shifted(spark, shift)
    con = contrasts.pairwise_contrasts(loss, DIMS, ["dt", "lin"])
    rows = con.collect()
    assert len(rows) == 20 and all(r["n_pairs"] == 30 for r in rows)
    first = next(r for r in rows if (r["model"], r["dim_A"], r["dim_B"]) == ("dt", "completeness", "precision"))
    assert first["separable"] and first["share"] == 1.0 and first["wilcoxon_stat"] == 0
    verdict = contrasts.verdicts(con, contrasts.gap_to_others(loss, DIMS))
    named = {(r["dimension"], r["kind"]): r["family"] for r in contrasts.families(verdict, {"dt": "trees", "lin": "linear"}).collect()}
    assert named == {("completeness", "most"): "all", ("precision", "least"): "all"}
    alone = contrasts.families(verdict.filter("model = 'dt'"), {"dt": "trees", "lin": "linear"}).collect()
    assert {r["family"] for r in alone} == {"trees"}


def test_missing_dimension_gives_null_pairs_and_drops_the_model_from_leaders(spark):
    shift = dict(zip(DIMS, [0.1, 0.0, 0.4, 0.1, 0.1]))
    loss = shifted(spark, shift, skip={("lin", "coherence")})
    con = contrasts.pairwise_contrasts(loss, DIMS, ["dt", "lin"])
    gone = [r for r in con.collect() if r["n_pairs"] == 0]
    assert len(gone) == 4 and all(r["p_raw"] is None and r["p_holm"] is None and not r["separable"] for r in gone)
    present = contrasts.complete_models(loss, DIMS, ["metric"])
    assert [r["model"] for r in present.collect()] == ["dt"]
    led = contrasts.leaders(con, present, DIMS, ["metric"]).collect()[0]
    assert led["leader"] == "validity" and led["n_separable"] >= 4


def test_leader_ties_follow_the_order_of_dimensions(spark):
    flat = shifted(spark, dict.fromkeys(DIMS, 0.0), models=("dt",))
    con = contrasts.pairwise_contrasts(flat, DIMS, ["dt"]).withColumn("separable", F.lit(False))
    led = contrasts.leaders(con, contrasts.complete_models(flat, DIMS, ["metric"]), DIMS, ["metric"])
    assert led.collect()[0]["leader"] == "completeness"


def test_single_pair_gives_nulls(spark):
    con = contrasts.pairwise_contrasts(shifted(spark, dict.fromkeys(DIMS, 0.0), n=1), DIMS, ["dt"])
    assert all(r["n_pairs"] == 1 and r["median_diff"] is None and r["p_raw"] is None for r in con.collect())


def test_arms(spark):
    rows = [("F", "d1", "A", 3, 1, 0.5), ("O", "d1", "A", 3, 1, 0.6), ("F", "d1", "A", 3, 2, 0.5), ("F", "d2", "A", 3, 1, 0.55), ("O", "d2", "A", 3, 1, 0.52)]
    df = spark.createDataFrame(rows, "arm string, dimension string, model string, level int, replicate int, auc double")
    wide = arms.wide_arms(df, ("F", "O"), ["auc"])
    assert wide.count() == 2
    swap = arms.rank_swaps(arms.arm_means(wide, ["auc"]), {"auc": "higher"}, 2).collect()
    assert len(swap) == 1 and swap[0]["lost"] == "d2" and swap[0]["won"] == "d1" and swap[0]["beyond_tie"]
    f, o = df.filter("arm = 'F'").drop("arm"), df.filter("arm = 'O'").drop("arm")
    swapped = arms.replace_rows(f, o, ["A"], [3])
    assert sorted(swapped.collect()) == sorted(o.collect())
    rep = arms.reproduced(f, f, ["auc"], ["dimension", "model", "level", "replicate"]).collect()[0]
    assert rep["agreement"] == "equal"
    assert checks.drift(f, swapped, F.col("level") == 3).count() == 0
    assert checks.drift(f, swapped, F.lit(False)).count() == 5


def brute_reml(y, x, rep):
    """Direct REML by dense covariance matrices."""
    n, p = x.shape
    z = (rep[:, None] == np.unique(rep)[None, :]).astype(float)

    def crit(ratio):
        v = np.eye(n) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        a = x.T @ vi @ x
        beta = np.linalg.solve(a, x.T @ vi @ y)
        r = y - x @ beta
        rss = r @ vi @ r
        return (n - p) * np.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], rss / (n - p)

    grid = np.linspace(0.0, 3, 1501)
    best = grid[int(np.argmin([crit(g)[0] for g in grid]))]
    s2 = crit(best)[1]
    return best * s2, s2


def test_mixed_model_on_an_unbalanced_table(spark):
    rng = np.random.default_rng(6)
    dims, models, levels = ["d1", "d2"], ["a", "b"], [1, 2]
    rows = []
    for r in range(12):
        shift = rng.normal(0, 0.7)
        for d, m, lv in itertools.product(dims, models, levels):
            if rng.random() < 0.85:
                rows.append((d, m, lv, r, float(shift + 0.3 * lv + (d == "d2") + rng.normal(0, 1.0))))
    df = spark.createDataFrame(rows, "dimension string, model string, level int, replicate int, loss double").repartition(3)
    fit = mixed_model.fit(df, dims, models, levels)
    x = mixed_model.design(dims, models, levels)
    su, se = brute_reml(np.array([r[4] for r in rows]), np.array([x[r[0], r[1], r[2]] for r in rows]), np.array([r[3] for r in rows]))
    assert fit.n_fixed == 6 and fit.n_rows == len(rows)
    assert fit.sigma_e2 == pytest.approx(se, rel=0.01) and fit.sigma_u2 == pytest.approx(su, abs=0.01)
    res = mixed_model.residuals(df, fit)
    assert res.agg(F.sum("resid")).collect()[0][0] == pytest.approx(0, abs=1e-6)
    assert mixed_model.histogram(res, 10).agg(F.sum("n")).collect()[0][0] == len(rows)
    probs = mixed_model.plotting_positions(res).agg(F.min("prob"), F.max("prob")).collect()[0]
    assert 0 < probs[0] < probs[1] < 1


def test_skew_ranking_and_rest(spark):
    rows = [(f"s{i}", v) for i, v in enumerate([0.1, -2.0, 1.0, 0.5, -0.2])]
    df = spark.createDataFrame(rows, "scenario string, skew double")
    top = mixed_model.skew_ranking(df, ["scenario"], top=2)
    assert [r["scenario"] for r in top.collect()] == ["s1", "s2"]
    rest = mixed_model.rest_range(df, top, ["scenario"]).collect()[0]
    assert (rest["min_at"], rest["max_at"], rest["n_rest"]) == ("s4", "s3", 3)
