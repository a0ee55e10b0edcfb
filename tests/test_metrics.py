"""Prediction and survival metrics against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnish.plans import metrics, survival


def predictions(spark, seed=1, n=120):
    rng = random.Random(seed)
    rows = [("g", rng.randint(0, 1), round(rng.random(), 1)) for _ in range(n)]
    rows += [("one", 1, 0.5), ("one", 1, 0.9)]
    return rows, spark.createDataFrame(rows, "g string, y int, score double")


@pytest.mark.parametrize("size", [{}, {"rows_per_bucket": 3}])
def test_ranking_metrics(spark, size):
    rows, df = predictions(spark)
    out = {r["g"]: r for r in metrics.ranking_metrics(df, ["g"], **size).collect()}
    pos = [s for g, y, s in rows if g == "g" and y == 1]
    neg = [s for g, y, s in rows if g == "g" and y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap = 0.0
    for t in sorted({*pos, *neg}, reverse=True):
        tp, said = sum(p >= t for p in pos), sum(s >= t for s in pos + neg)
        ap += sum(p == t for p in pos) / len(pos) * tp / said
    assert out["g"]["auc"] == pytest.approx(auc) and out["g"]["auprc"] == pytest.approx(ap)
    assert out["one"]["auc"] is None and out["one"]["auprc"] is None


def test_threshold_metrics(spark):
    _, df = predictions(spark)
    out = {r["g"]: r for r in metrics.threshold_metrics(df, ["g"]).collect()}
    # a score of exactly one half is class 0: one hit, one miss, class 0 only predicted
    assert out["one"]["accuracy"] == 0.5 and out["one"]["f1_macro"] == pytest.approx(1 / 3)


def test_regression_and_diagnostics(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 1.5), ("a", 3.0, 3.0), ("b", 1.0, 2.0), ("c", 1.0, 1.0), ("c", 1.0, 1.0)], "g string, y double, score double")
    out = {r["g"]: r for r in metrics.regression_metrics(df, ["g"]).collect()}
    assert out["a"]["r2"] == pytest.approx(1 - 0.5 / 2) and out["a"]["bias"] == pytest.approx(0.0)
    assert out["b"]["r2"] is None and out["c"]["r2"] == 1.0
    p = spark.createDataFrame([("a", 0.0, 0.2), ("a", 1.0, 0.2)], "g string, score double, prior double")
    d = metrics.prediction_diagnostics(p, ["g"]).collect()[0]
    assert d["p_entropy"] == pytest.approx(0.0, abs=1e-9) and d["p_abs_dist_prior"] == pytest.approx(0.5)


def test_point632_and_plus(spark):
    rows = [("auc", "in_bag", 0.9), ("auc", "oob", 0.7), ("brier", "in_bag", 0.12), ("brier", "oob", 0.2), ("auc2", "oob", 0.7)]
    df = spark.createDataFrame(rows, "metric string, split string, value double")
    out = {r["metric"]: r for r in metrics.point632plus(df, ["metric"]).collect()}
    assert out["auc"]["v632"] == pytest.approx(0.368 * 0.9 + 0.632 * 0.7)
    w = 0.632 / (1 - 0.368 * 0.5)
    assert out["auc"]["w"] == pytest.approx(w) and out["auc"]["vplus"] == pytest.approx(1 - ((1 - w) * 0.1 + w * 0.3))
    assert out["brier"]["w"] == pytest.approx(0.632)  # in-bag error above no information
    assert out["auc2"]["v632"] is None


def subjects(seed, n, groups=("a", "b")):
    rng = random.Random(seed)
    return [(rng.choice(groups), float(rng.randint(1, 15)), rng.random() < 0.4, round(rng.random(), 1)) for _ in range(n)]


def brute_c(rows):
    num = den = 0.0
    for _, ti, ei, ri in rows:
        if ei:
            for _, tj, ej, rj in rows:
                if ti < tj or (ti == tj and not ej):
                    den += 1
                    num += (ri > rj) + 0.5 * (ri == rj)
    return num, den


@pytest.mark.parametrize("size", [{}, {"rows_per_bucket": 5}])
def test_c_index(spark, size):
    rows = subjects(3, 150) + [("none", 5.0, False, 0.1), ("none", 6.0, False, 0.2)]
    df = spark.createDataFrame(rows, "g string, time double, event boolean, risk double")
    out = {r["g"]: r for r in survival.c_index(df, ["g"], **size).collect()}
    for g in ("a", "b"):
        num, den = brute_c([r for r in rows if r[0] == g])
        assert out[g]["concordant"] == pytest.approx(num) and out[g]["comparable"] == den
    assert "none" not in out or out["none"]["c_index"] is None


def brute_km(rows):
    g, law = 1.0, {}
    for t in sorted({r[1] for r in rows}):
        left = sum(r[1] >= t for r in rows) - sum(r[1] == t and r[2] for r in rows)
        c = sum(r[1] == t and not r[2] for r in rows)
        if c:
            g *= 1 - c / left
        law[t] = g
    return law


def at(law, t):
    past = [k for k in law if k <= t]
    return law[max(past)] if past else 1.0


@pytest.mark.parametrize("size", [{}, {"rows_per_bucket": 4}])
def test_censoring_law(spark, size):
    rows = subjects(5, 80, ("a",))
    df = spark.createDataFrame(rows, "g string, time double, event boolean, risk double")
    law = brute_km(rows)
    got = {r["time"]: r["uncensored"] for r in survival.censoring_law(df, **size).collect()}
    assert got.keys() == law.keys() and all(got[t] == pytest.approx(law[t], abs=1e-12) for t in law)
    extra = survival.uncensored_at(survival.censoring_law(df), spark.createDataFrame([(0.5,), (7.5,), (99.0,)], "time double"))
    more = {r["time"]: r["uncensored"] for r in extra.collect()}
    assert all(more[t] == pytest.approx(at(law, t), abs=1e-12) for t in (0.5, 7.5, 99.0))


def test_breslow_hazard_and_brier(spark):
    rows = subjects(8, 90, ("a",)) + [("quiet", 3.0, False, 0.4)]
    df = spark.createDataFrame(rows, "g string, time double, event boolean, eta double")
    mine = [r for r in rows if r[0] == "a"]
    center = sum(r[3] for r in mine) / len(mine)
    risk = [math.exp(r[3] - center) for r in mine]
    hazard, total = {}, 0.0
    for t in sorted({r[1] for r in mine if r[2]}):
        total += sum(r[1] == t and r[2] for r in mine) / sum(x for r, x in zip(mine, risk) if r[1] >= t)
        hazard[t] = total
    base = survival.breslow(df, ["g"])
    got = {r["time"]: r["hazard"] for r in base.collect()}
    assert {r["g"] for r in base.collect()} == {"a"}
    assert got.keys() == hazard.keys() and all(got[t] == pytest.approx(hazard[t]) for t in hazard)

    def h0(p):
        ts = sorted(hazard)
        if p < ts[0]:
            return 0.0
        if p >= ts[-1]:
            return hazard[ts[-1]]
        lo, hi = max(t for t in ts if t <= p), min(t for t in ts if t > p)
        return hazard[lo] + (p - lo) / (hi - lo) * (hazard[hi] - hazard[lo])

    points = [0.5, 4.25, 9.0, 400.0]
    near = {r["point"]: r["hazard"] for r in survival.hazard_at(base, ["g"], points).collect()}
    assert all(near[p] == pytest.approx(h0(p)) for p in points)

    scores = survival.brier_scores(df, ["g"], df.filter("g = 'a'"), base, [4.0, 7.0, 400.0]).collect()
    assert {r["point"] for r in scores} == {4.0, 7.0}
    law = brute_km(mine)
    for r in scores:
        t, terms = r["point"], []
        for (_, ti, ei, _), x in zip(mine, risk):
            s = math.exp(-h0(t) * x)
            if ei and ti <= t:
                terms.append(s * s / at(law, ti) if at(law, ti) > 0 else 0.0)
            elif ti > t:
                terms.append((1 - s) ** 2 / at(law, t) if at(law, t) > 0 else 0.0)
            else:
                terms.append(0.0)
        assert r["brier"] == pytest.approx(sum(terms) / len(terms))
    grid = survival.integration_grid(df.filter("g = 'a'"), 10)
    assert len(grid) == 10 and grid == sorted(grid)
    curve = survival.brier_scores(df, ["g"], df.filter("g = 'a'"), base, grid)
    ibs = survival.integrated(curve, ["g"]).collect()[0]["ibs"]
    assert 0 < ibs < 1


def test_few_events_fall_back_to_all_times(spark):
    df = spark.createDataFrame([(float(t), t < 4) for t in range(1, 31)], "time double, event boolean")
    grid = survival.integration_grid(df)
    assert len(grid) == 50 and grid[0] == pytest.approx(2.45) and grid[-1] == pytest.approx(27.1)


def test_mean_over_seeds(spark):
    df = spark.createDataFrame([("m", 1.0, None), ("m", 3.0, None)], "model string, a double, b double")
    r = metrics.mean_over_seeds(df, ["model"], ["a", "b"]).collect()[0]
    assert r["a"] == 2.0 and r["b"] is None
    assert df.agg(F.count("b")).collect()[0][0] == 0
