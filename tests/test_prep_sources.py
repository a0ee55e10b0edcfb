"""Preparation, resampling, checks, sources and the append stream."""

import pytest
from pyspark.sql import functions as F

from tarnish.operators import checks, degrade, prep, resample
from tarnish.sources import results
from tarnish.spec import ICU_COHORT, ICU_NUMERIC, ICU_SENTINELS
from tarnish.streaming import append

IDS = list(ICU_COHORT.ids)


def test_coercion_and_encoding(spark, icu):
    broken = degrade.validity(icu, ICU_COHORT, 0.3, 1).df
    df = prep.coerce_numeric(broken, ICU_NUMERIC)
    assert all(dict(df.dtypes)[c] == "double" for c in ICU_NUMERIC)
    full = prep.sentinel_encode(df, ICU_SENTINELS)
    assert full.filter(prep.any_null(ICU_NUMERIC)).count() == 0
    hot = prep.one_hot(prep.fill_category(broken, ["gender"]), "gender", [r["v"] for r in prep.fitted_categories(icu, "gender").orderBy("v").collect()])
    assert hot.filter("gender in ('X', 'U', '?', 'missing')").agg(F.max("gender_M"), F.max("gender_F")).collect()[0] == (0, 0)
    tokens = spark.createDataFrame([("abc",), ("1O.O",), ("--",), ("2",), (None,), ("nan",)], "c string")
    assert [r[0] for r in prep.coerce_numeric(tokens, ["c"]).collect()] == [None, None, None, 2.0, None, None]


def test_schema_repair_and_targets(spark):
    df = spark.createDataFrame([(1.0, "1"), (None, "x"), (-2.0, None)], "time double, ev string")
    out = prep.ensure_columns(df, {"age": "double", "death_event": "boolean"}, {"death_event": False})
    assert out.filter("age is null and death_event = false").count() == 3
    assert [r["ev"] for r in prep.coerce_event(df, "ev").collect()] == [True, False, False]
    assert prep.valid_targets(df, "time").count() == 2 and prep.valid_targets(df, "time", positive=True).count() == 1
    assert prep.log_target(df, "time").first()["log_time"] == pytest.approx(0.693147, abs=1e-6)
    assert [r[0] for r in spark.createDataFrame([(0.5,), (0.51,)], "s double").select(prep.predicted_class(F.col("s"))).collect()] == [0, 1]
    assert prep.zero_fill(df, ["time"]).dtypes[0] == ("time", "float")


def test_scaling(spark):
    clean = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    df = prep.standardise(spark.createDataFrame([(5.0, 7.0)], "a double, b double"), clean, ["a", "b"]).first()
    assert df["a"] == 3.0 and df["b"] == 2.0  # population deviation; a constant column is only centred
    rows = [(0, 2, 1.0, 4.0), (0, 1, 4.0, 4.0), (0, 0, 7.0, 4.0)]
    bag = spark.createDataFrame(rows, "replicate int, draws int, a double, b double")
    out = {r["draws"]: r for r in prep.standardise_in_bag(bag, ["a", "b"]).collect()}
    assert out[0]["a"] == pytest.approx(5 / 2**0.5) and out[0]["b"] == 0.0


def test_median_indicator(spark):
    rows = [(0, 2, 1.0, None, 1.0), (0, 1, None, None, 2.0), (0, 1, 9.0, None, 3.0), (0, 0, 4.0, None, 4.0)]
    df = spark.createDataFrame(rows, "replicate int, draws int, a double, b double, c double")
    out = prep.median_indicator(df, ["a", "b", "c"]).collect()
    filled = next(r for r in out if r["a_missing"] == 1)
    assert filled["a"] == 1.0 and filled["b"] == 0.0 and all(r["c_missing"] is None for r in out)


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 32])
def test_bootstrap(icu, rows_per_bucket):
    split = resample.bootstrap(icu, IDS, 4, "in_hospital_mortality", rows_per_bucket=rows_per_bucket)
    sizes = {r["in_hospital_mortality"]: r["count"] for r in icu.groupBy("in_hospital_mortality").count().collect()}
    for r in split.groupBy("replicate", "stratum").agg(F.sum("draws").alias("n"), F.count("*").alias("rows")).collect():
        assert r["n"] == r["rows"] == sizes[int(r["stratum"])]
    assert resample.in_bag(split).filter("replicate = 0").count() == 240
    share = resample.out_of_bag(split).count() / (4 * 240)
    assert 0.3 < share < 0.44 and resample.usable_replicates(split).count() == 4


def test_bootstrap_deals_out_its_draws(icu, monkeypatch):
    usual = sorted(map(tuple, resample.bootstrap(icu, IDS, 3).collect()))
    monkeypatch.setattr(resample, "DRAWS_PER_TASK", 100)
    split = resample.bootstrap(icu, IDS, 3)
    assert "REPARTITION_BY_NUM" in split._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, split.collect())) == usual


def test_sample_and_hot_deck(icu):
    assert resample.sample_exact(icu, IDS, 77).count() == 77
    assert resample.sample_exact(icu, IDS, 1000).count() == 240
    holes = degrade.completeness(icu, ICU_COHORT, 0.2, 3).df
    filled = resample.hot_deck(holes, IDS, "gender", ICU_NUMERIC, 1)
    assert filled.columns == holes.columns and filled.count() == 240
    assert filled.filter("gender is not null").filter(prep.any_null(ICU_NUMERIC)).count() == 0
    nobody = "gender is null"
    assert filled.filter(nobody).filter(prep.any_null(ICU_NUMERIC)).count() == holes.filter(nobody).filter(prep.any_null(ICU_NUMERIC)).count()
    pool = {(r["gender"], r["age"]) for r in holes.collect()}
    assert all((r["gender"], r["age"]) in pool for r in filled.collect())


def test_change_rate_and_expectations(spark, icu):
    out = degrade.validity(icu, ICU_COHORT, 0.2, 3)
    rate = checks.change_rate(checks.matched(icu, out.df, IDS, ICU_COHORT.predictors), ICU_COHORT.predictors).collect()[0]
    assert rate["n_changed"] == out.touched.count()
    none = checks.change_rate(checks.matched(icu, icu, IDS, ICU_NUMERIC), ICU_NUMERIC)
    assert none.collect()[0]["rate"] == 0.0
    assert not checks.rate_check(none, 0.2, False).collect()[0]["ok"] and checks.rate_check(none, 0.2, True).collect()[0]["ok"]
    claims = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "claim_id string, expected double")
    report = checks.expectations(spark.createDataFrame([("a", 1.0), ("b", 2.5)], "claim_id string, value double"), claims)
    assert {r["claim_id"]: r["ok"] for r in report.collect()} == {"a": True, "b": False, "c": False}
    with pytest.raises(AssertionError):
        checks.fail_if_any(report)
    checks.fail_if_any(report.filter("ok"))
    assert checks.within(none, "rate", 0.0, 0.01).collect()[0]["ok"]


def test_blocks_coverage_and_resume(spark):
    rows = [("d", "S1", 3500, 1, b, m, 0.5) for b in range(3) for m in ("x", "y")]
    rows[-1] = (*rows[-1][:-1], None)
    df = spark.createDataFrame(rows, "dimension string, scenario string, N int, level int, replicate int, model string, c_index double")
    assert checks.block_completeness(df, expected=6).collect()[0]["complete"]
    assert not checks.block_completeness(df).unionByName(checks.block_completeness(df, expected=7)).filter("not complete").isEmpty()
    cover = checks.replicate_coverage(df, ["model"], [1], 3).collect()
    assert all(r["complete"] for r in cover) and not checks.replicate_coverage(df, ["model"], [0, 1]).first()["complete"]
    done = checks.finished(df, ["N", "level", "replicate"], ["x", "y"], ["c_index"])
    planned = df.select("N", "level", "replicate").distinct()
    assert [r["replicate"] for r in checks.still_to_run(planned, done, ["N", "level", "replicate"]).collect()] == [2]


HEAD = "scenario;N;pollution;bootstrap;model;accuracy;f1_macro;auc;brier;auprc;p_mean;p_var;p_entropy;p_abs_dist_prior\n"


def write_tree(root):
    a = root / "validity" / "S1"
    b = root / "precision" / "S2"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    (a / "r.csv").write_text(
        HEAD
        + "S1;3500;0.0;1;LASSO;0.9;0.8;0.7;0.1;0.5;0.1;0.1;0.1;0.1\n"
        + "S1;3500;0.30000000000000004;1;LASSO;0.9;0.8;nan;0.1;0.5;0.1;0.1;0.1;0.1\n"
        + "S1;3500;0.3;2;LASSO;0.9\n"
        + "S1;3500;0.3;3;LASSO;0.9;0.8;0.7;0.1;0.5;0.1;0.1;0.1;0.1;extra;extra\n"
    )
    (b / "r.csv").write_text(HEAD.replace(";", ",").replace("pollution", "p") + "S2,3500,0.1,1,MLP1,0.9,0.8,0.6,0.2,0.5,0.1,0.1,0.1,0.1\n")


def test_tolerant_scan_and_tree(spark, tmp_path):
    write_tree(tmp_path)
    one = results.read_csv(spark, str(tmp_path / "validity" / "S1" / "r.csv"), results.result_schema("binary"))
    rows = {(r["bootstrap"], r["level"]): r for r in results.with_level(one).collect()}
    assert set(rows) == {(1, 0), (1, 3), (2, 3)}  # the long line is skipped, the short one padded
    assert rows[1, 3]["auc"] is None and rows[2, 3]["auc"] is None and rows[1, 0]["auc"] == 0.7
    tree = results.typed(results.collect_tree(spark, str(tmp_path), "binary"), "binary")
    got = {(r["outcome_type"], r["dimension"], r["scenario"], r["p"]) for r in tree.collect()}
    assert ("binary", "precision", "S2", 0.1) in got and tree.count() == 4
    out = str(tmp_path / "consolidated")
    results.write_consolidated(tree, out)
    part = results.select_results(spark, out, {"dimension": "precision", "outcome_type": ["binary"]})
    assert part.count() == 1 and "PartitionFilters: [isnotnull(dimension" in part._jdf.queryExecution().toString()
    again = results.cached(spark, tree, str(tmp_path / "cache"))
    assert again.count() == 4 and results.cached(spark, tree.limit(0), str(tmp_path / "cache")).count() == 4
    results.append_results(tree, str(tmp_path / "appended"))
    results.append_results(tree, str(tmp_path / "appended"))
    assert spark.read.parquet(str(tmp_path / "appended")).count() == 8
    results.write_csv(tree, str(tmp_path / "export"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "export")).count() == 4
    grid = results.as_grid(tree)
    assert {"level", "replicate"} <= set(grid.columns)
    assert checks.newest_file(spark.read.parquet(out)).collect()[0][0] is not None
    assert checks.is_fresh(spark.read.parquet(str(tmp_path / "appended")), spark.read.text(str(tmp_path / "validity" / "S1")))


def test_append_stream_takes_each_file_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    line = "S1,3500,0.1,{},LASSO,0.9,0.8,0.7,0.1,0.5,0.1,0.1,0.1,0.1\n"
    (src / "a.csv").write_text(HEAD.replace(";", ",") + line.format(1))
    append.append_stream(append.result_stream(spark, str(src), "binary"), out, mark).awaitTermination(60)
    (src / "b.csv").write_text(HEAD.replace(";", ",") + line.format(2))
    append.append_stream(append.result_stream(spark, str(src), "binary"), out, mark).awaitTermination(60)
    assert sorted(r["bootstrap"] for r in spark.read.parquet(out).collect()) == [1, 2]
