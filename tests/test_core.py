"""Hash uniforms, tails, selection, ordering."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnish.functions.hashing import HASH_SETTING, digest, gaussian, pick, small_bits, unit, wide_bits
from tarnish.functions.tails import erfc, two_sided_p
from tarnish.operators import ordering
from tarnish.operators.selection import cut_smallest
from tarnish.session import METHOD_LIMIT, split_methods, staged, staged_alone


@pytest.mark.parametrize("name", ["md5", "xxhash64"])
def test_uniforms_are_even_and_repeatable(spark, name):
    spark.conf.set(HASH_SETTING, name)
    try:
        d = digest(7, F.col("id"), "x")
        rows = spark.range(20000).select(unit(wide_bits(d)).alias("u"), unit(wide_bits(d, 1)).alias("v"), small_bits(d).alias("s"), wide_bits(d).alias("b"))
        again = spark.range(20000).repartition(3).select(wide_bits(d).alias("b"))
        assert rows.select(F.sum("b")).collect() == again.select(F.sum("b")).collect()
    finally:
        spark.conf.unset(HASH_SETTING)
    got = rows.agg(F.avg("u"), F.var_pop("u"), F.corr("u", "v"), F.min("u"), F.max("u"), F.max("s")).collect()[0]
    assert abs(got[0] - 0.5) < 0.01 and abs(got[1] - 1 / 12) < 0.003 and abs(got[2]) < 0.03
    assert 0 < got[3] and got[4] < 1 and got[5] < 2**32


def test_gaussian_and_pick(spark):
    d = digest(1, F.col("id"))
    df = spark.range(20000).select(gaussian(unit(wide_bits(d)), unit(wide_bits(d, 1))).alias("z"), pick(small_bits(d), ["a", "b"]).alias("p"))
    mean, var, low = df.agg(F.avg("z"), F.var_pop("z"), F.min(F.abs("z"))).collect()[0]
    assert abs(mean) < 0.03 and abs(var - 1) < 0.05 and low >= 1e-6
    assert {r[0] for r in df.select("p").distinct().collect()} == {"a", "b"}


def test_erfc_matches_library(spark):
    xs = [0.0, 1e-5, 5e-4, 1e-3, 0.01, 0.3, 1.0, 2.5, 6.2, 6.3, 8.0, 20.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y"))
    for x, y in df.collect():
        assert y == pytest.approx(math.erfc(x), rel=1e-11, abs=1e-300), x
    p = spark.createDataFrame([(-1.96,), (1.96,)], "z double").select(two_sided_p(F.col("z"))).collect()
    assert p[0][0] == p[1][0] == pytest.approx(0.04999579, abs=1e-7)


@pytest.mark.parametrize("budget", [0, 1, 17, 999, 1000, 5000])
def test_cut_takes_the_smallest_keys(spark, budget):
    rng = random.Random(budget)
    # clustered keys force several zoom levels
    rows = [(0.25 + rng.random() * 1e-9, f"r{i}") for i in range(600)] + [(rng.random(), f"s{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "key double, tie string").repartition(5)
    cut = cut_smallest(df, budget)
    kept = {r["tie"] for r in df.filter(cut.keeps(F.col("key"), F.col("tie"))).collect()}
    assert kept == {t for _, t in sorted(rows)[:budget]}


def test_cut_with_amounts_keeps_until_budget(spark):
    rng = random.Random(1)
    rows = [(rng.random(), f"r{i}", rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "key double, tie string, amount int")
    cut = cut_smallest(df, lambda total: total // 3)
    kept = df.filter(cut.keeps(F.col("key"), F.col("tie"))).count()
    need, seen, n = sum(r[2] for r in rows) // 3, 0, 0
    for _, _, a in sorted(rows):
        if seen >= need:
            break
        seen, n = seen + a, n + 1
    assert kept == n


def test_equal_keys_are_split_by_tie(spark):
    df = spark.createDataFrame([(0.5, f"{i:03d}") for i in range(50)], "key double, tie string")
    cut = cut_smallest(df, 20)
    assert df.filter(cut.keeps(F.col("key"), F.col("tie"))).count() == 20


def _skewed(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 400)), rng.randint(0, 3)) for _ in range(900)]
    rows += [(rng.choice("abc"), round(rng.gauss(0, 5), 1), rng.randint(0, 3)) for _ in range(300)]
    return spark.createDataFrame(rows, "g string, v double, n int")


def test_bucketed_prefix_sums_equal_direct_ones(spark):
    df = _skewed(spark).groupBy("g", "v").agg(F.sum("n").alias("n"))
    direct = ordering.prefix_sums(df, ["g"], "v", ["n"])
    split = ordering.prefix_sums(df, ["g"], "v", ["n"], rows_per_bucket=40)
    assert sorted(direct.collect()) == sorted(split.select(*direct.columns).collect())
    whole = ordering.prefix_sums(df.groupBy("v").agg(F.sum("n").alias("n")), [], "v", ["n"], rows_per_bucket=40)
    last = whole.orderBy(F.desc("v")).first()
    assert last["before_n"] + last["n"] == last["total_n"]


def test_bucketed_numbering_is_dense(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("x").alias("g"), F.col("id").cast("string").alias("t"))
    df = df.withColumn("b", wide_bits(digest(1, F.col("t"))))
    direct = ordering.number_rows(df, ["g"], "b", "t")
    split = ordering.number_rows(df, ["g"], "b", "t", rows_per_bucket=16)
    assert sorted(direct.collect()) == sorted(split.select(*direct.columns).collect())
    assert {r["ordinal"] for r in split.filter("g = 'hot'").collect()} == set(range(167))


def test_grouped_quantiles_equal_percentile(spark):
    df = _skewed(spark).unionByName(spark.createDataFrame([("none", None, 1)], "g string, v double, n int"))
    probs = {"a": 0.025, "b": 0.5, "c": 0.975}
    direct = {r["g"]: r for r in ordering.grouped_quantiles(df, ["g"], "v", probs).collect()}
    split = {r["g"]: r for r in ordering.grouped_quantiles(df, ["g"], "v", probs, rows_per_bucket=25).collect()}
    assert direct.keys() == split.keys()
    for g, row in direct.items():
        for c in probs:
            assert (row[c] is None and split[g][c] is None) or split[g][c] == pytest.approx(row[c])


def test_column_quantiles_are_exact(spark):
    rng = random.Random(9)
    rows = [(rng.lognormvariate(0, 3), float(rng.randint(0, 2)), None) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.001, 0.5, 0.8, 0.999, 1.0]
    got = ordering.column_quantiles(df, ["a", "b", "c"], probs)
    want = df.agg(F.percentile("a", F.lit(probs)), F.percentile("b", F.lit(probs))).collect()[0]
    assert got["a"] == pytest.approx(want[0]) and got["b"] == pytest.approx(want[1]) and got["c"] == [None] * 6


def test_tables_on_the_way_are_deleted(spark):
    made = []

    def make():
        made.extend(staged(spark.range(5)).inputFiles())
        return spark.read.parquet(*made).selectExpr("id + 1 AS id")

    out = staged_alone(spark, make)
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3, 4, 5]
    path = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_long_methods_are_split(spark):
    before = spark.conf.get(METHOD_LIMIT)
    try:
        for limit, wanted in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(METHOD_LIMIT, limit)
            split_methods(spark)
            assert spark.conf.get(METHOD_LIMIT) == wanted
    finally:
        spark.conf.set(METHOD_LIMIT, before)
