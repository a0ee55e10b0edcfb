"""All replicates of a bootstrap under every scenario and operator, cell by cell."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.data import bits_sql, round_col, rounded, small_bits_sql, table, unit_sql
from tarnish.catalog.degradation import HIGH, LOW
from tarnish.operators import degrade, resample, scenario
from tarnish.spec import INVALID_CATEGORY, INVALID_FLAG, INVALID_TEXT, TableSpec

REPLICATES, DENSITY = 3, 0.1
SPEC = TableSpec(
    ids=["o_orderkey"],
    numeric=["price", "day", "closed", "urgent"],
    categorical=["status"],
    flags=["closed", "urgent"],
    severity="closed",
    swaps=[("price", "day")],
    noise_cv={"price": 0.03},
    additive_bias={"day": 2.0},
    multiplicative_bias={"price": 0.05},
    donor_column="price",
)


def order_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the shape of a cohort."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("day"),
        (F.col("o_orderstatus") == "F").cast("double").alias("closed"),
        (F.substring("o_orderpriority", 1, 1) <= "2").cast("double").alias("urgent"),
        F.col("o_orderstatus").alias("status"),
    )


def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_cohort(spark, sf_dir)
    split = resample.bootstrap(df, SPEC.ids, REPLICATES)
    rows = scenario.replicate_rows(df, split, SPEC.ids)
    cells = scenario.scenario_cells(scenario.degrade_replicates(rows, SPEC, DENSITY), SPEC)
    text = (F.col("operator") == "validity") | F.col("column").isin(*SPEC.categorical)
    number = round_col(F.col("after").try_cast("double"), 4)
    return cells.select(
        *cells.columns[:-1], F.when(~text, number).alias("number"), F.when(text, F.col("after")).alias("token")
    )


QUERIES = {"scenario_grid": scenario_grid}

# ------------------------------------------------------------------ oracle text

_PREDS = SPEC.predictors
_BY = "PARTITION BY replicate, side"
_ROW = "concat(seed, ':', row_id, ':{}')"
_CELL = "concat(seed, ':', row_id, ':', col)"
_NOISE = "concat(seed, ':', row_id, ':', col, ':noise')"


def _cells(columns) -> str:
    parts = []
    for c in columns:
        num, txt = ("NULL::DOUBLE", c) if c in SPEC.categorical else (c, "NULL::VARCHAR")
        parts.append(f"SELECT replicate, side, seed, row_id, closed AS severe, n_rows, '{c}' AS col, {num} AS num, {txt} AS txt FROM r")
    return " UNION ALL ".join(parts)


def _choice(values, bits: str) -> str:
    return f"(ARRAY[{', '.join(chr(39) + v + chr(39) for v in values)}])[({bits} % {len(values)}) + 1]"


def _swap(a: str, b: str) -> str:
    """One row per possible swap; two flags alone make one pair, so every rule has the rate one."""
    u = unit_sql(_ROW.format(f"{a}~{b}"))
    return f"SELECT replicate, side, n_rows, row_id, '{a}' AS a, '{b}' AS b, {a} AS va, {b} AS vb, -ln({u}) AS k FROM r WHERE {a} <> {b}"


def _order(key: str, tie: str) -> str:
    return f"row_number() OVER ({_BY} ORDER BY {key}, {tie})"


_D, _N, _P = f"{DENSITY!r}::DOUBLE", len(SPEC.numeric), len(_PREDS)
_TIE = "concat(row_id, ':', col)"
_TOKEN = f"""CASE WHEN col = 'status' THEN {_choice(INVALID_CATEGORY, small_bits_sql(_CELL))}
    WHEN col IN ('closed', 'urgent') AND {unit_sql(_CELL, 1)} >= 0.6 THEN {_choice(INVALID_FLAG, small_bits_sql(_CELL))}
    ELSE {_choice(INVALID_TEXT, small_bits_sql(_CELL))} END"""
_CHANGED = " + ".join(f"(t.{c} IS DISTINCT FROM d.{c})::INT" for c in _PREDS)
_BOTH = ", ".join(f"t.{c} AS o_{c}, d.{c} AS n_{c}" for c in _PREDS)


def _copied(c: str) -> str:
    shown = f"NULL, n_{c}" if c in SPEC.categorical else f"{rounded('n_' + c, 4)}, NULL"
    return f"SELECT 'uniqueness', replicate, side, row_id, '{c}', {shown} FROM overwritten WHERE o_{c} IS DISTINCT FROM n_{c}"


_SQL = f"""WITH RECURSIVE base AS (
  SELECT o_orderkey::VARCHAR AS id, o_totalprice AS price, (o_orderdate::DATE - DATE '1992-01-01')::DOUBLE AS day,
    (o_orderstatus = 'F')::INT::DOUBLE AS closed, (substr(o_orderpriority, 1, 1) <= '2')::INT::DOUBLE AS urgent, o_orderstatus AS status FROM orders),
numbered AS (SELECT id, row_number() OVER (ORDER BY {bits_sql("concat('10000:', id, ':order')")}, id) - 1 AS ordinal, count(*) OVER () AS n FROM base),
bag AS (
  SELECT b AS replicate, {bits_sql("concat(10000 + b, ':all:', ordinal)")} % n AS ordinal, count(*) AS draws FROM numbered, range({REPLICATES}) t(b) GROUP BY ALL),
sides AS (
  SELECT id, b AS replicate, coalesce(draws, 0) AS draws FROM numbered n CROSS JOIN range({REPLICATES}) t(b)
  LEFT JOIN bag ON bag.replicate = b AND bag.ordinal = n.ordinal),
copies AS (
  SELECT id, replicate, 'test' AS side, 0 AS copy FROM sides WHERE draws = 0
  UNION ALL SELECT id, replicate, 'train', unnest(range(1, draws + 1)) FROM sides WHERE draws > 0),
r AS (
  SELECT replicate, side, concat(id, '-', copy) AS row_id, replicate + CASE side WHEN 'train' THEN 40000 ELSE 50000 END AS seed,
    count(*) OVER ({_BY}) AS n_rows, price, day, closed, urgent, status FROM copies JOIN base USING (id)),
c AS ({_cells(_PREDS)}),
missing AS (
  SELECT * FROM c WHERE num IS NOT NULL OR txt IS NOT NULL
  QUALIFY {_order(f"-ln({unit_sql(_CELL)}) / CASE WHEN severe = 1 THEN {HIGH} ELSE {LOW} END", _TIE)} <= floor({_D} * n_rows * {_P})),
invalid AS (
  SELECT *, {_TOKEN} AS token FROM c QUALIFY {_order(bits_sql(_CELL), _TIE)} <= greatest(1, round_even({_D} * (n_rows * {_P}), 0))),
rated AS (
  SELECT *, CASE WHEN col = 'day' OR (col = 'price' AND num <> 0) THEN 0.3 ELSE 0.0 END::DOUBLE AS bias,
    CASE WHEN col IN ('closed', 'urgent') OR num <> 0 THEN 0.1 ELSE 0.0 END::DOUBLE AS impulse, count(*) OVER ({_BY}) AS total FROM c WHERE num IS NOT NULL),
modes AS (
  SELECT *, {unit_sql(_CELL, 1)} * (0.6::DOUBLE + bias + impulse) AS mode, CASE WHEN col = 'price' THEN 0.03 ELSE 0.05 END::DOUBLE AS cv,
    sqrt(-2.0::DOUBLE * ln({unit_sql(_NOISE)})) * cos(2.0::DOUBLE * pi() * {unit_sql(_NOISE, 1)}) AS z FROM rated
  QUALIFY {_order(f"-ln({unit_sql(_CELL)}) / (0.6::DOUBLE + bias + impulse)", _TIE)} <= greatest(1, round_even({_D} * total, 0))),
noisy AS (
  SELECT *, CASE WHEN mode < 0.6 THEN num + cv * (CASE WHEN num <> 0 THEN abs(num) ELSE 1.0 END) * (CASE WHEN z < 0 THEN -1 ELSE 1 END) * greatest(abs(z), 1e-6)
    WHEN mode < 0.6::DOUBLE + bias THEN CASE WHEN col = 'day' THEN num + 2.0 ELSE num * 1.05 END
    WHEN col IN ('closed', 'urgent') THEN CASE WHEN num <> 0 THEN 0.0 ELSE 1.0 END
    WHEN {small_bits_sql(_NOISE)} % 2 = 0 THEN num * 0.1 ELSE num * 10.0 END AS new FROM modes),
fired AS (
  SELECT * FROM ({_swap('price', 'day')} UNION ALL {_swap('closed', 'urgent')})
  QUALIFY {_order('k', "concat(row_id, ':', a, '~', b)")} <= ceil(greatest(1, round_even({_D} * (n_rows * {_N}), 0)) / 2.0)),
edges AS (SELECT replicate, side, quantile_cont(price, 0.8) AS q FROM r GROUP BY ALL),
pool AS (SELECT *, 'all' AS pool FROM r UNION ALL SELECT r.*, 'upper' FROM r JOIN edges USING (replicate, side) WHERE price >= q),
donors AS (
  SELECT replicate, side, pool, row_id, row_number() OVER w - 1 AS ordinal, count(*) OVER (PARTITION BY replicate, side, pool) AS size FROM pool
  WINDOW w AS (PARTITION BY replicate, side, pool ORDER BY {bits_sql(_ROW.format('donor-order'))}, row_id)),
sizes AS (SELECT replicate, side, pool, any_value(size) AS size FROM donors GROUP BY ALL),
targets AS (
  SELECT replicate, side, row_id, {unit_sql(_ROW.format('copy'))} AS k, {bits_sql(_ROW.format('donor'))} AS draw,
    CASE WHEN {unit_sql(_ROW.format('copy'), 1)} < 1.0::DOUBLE / 3.0 THEN 'upper' ELSE 'all' END AS pool FROM r),
placed AS (SELECT t.*, draw % size AS ordinal FROM targets t JOIN sizes USING (replicate, side, pool)),
drawn AS (
  SELECT t.replicate, t.side, t.row_id, d.row_id AS donor_id, t.k FROM placed t JOIN donors d USING (replicate, side, pool, ordinal) WHERE t.row_id <> d.row_id),
ends_chain AS (
  SELECT replicate, side, row_id, donor_id AS end_id, k, row_id AS last, 0 AS hops FROM drawn
  UNION ALL
  SELECT c.replicate, c.side, c.row_id, n.donor_id, n.k, n.row_id, c.hops + 1 FROM ends_chain c
  JOIN drawn n ON n.replicate = c.replicate AND n.side = c.side AND n.row_id = c.end_id AND (n.k < c.k OR (n.k = c.k AND n.row_id < c.last))),
ends AS (SELECT replicate, side, row_id, arg_max(end_id, hops) AS end_id FROM ends_chain GROUP BY ALL),
ended AS (SELECT w.replicate, w.side, w.row_id, w.k, e.end_id FROM drawn w JOIN ends e USING (replicate, side, row_id)),
got AS (SELECT e.replicate, e.side, e.row_id AS target, e.k, d.* EXCLUDE (replicate, side, row_id) FROM r d JOIN ended e ON d.replicate = e.replicate AND d.side = e.side AND d.row_id = e.end_id),
weighed AS (
  SELECT t.replicate, t.side, t.row_id, t.n_rows, d.k, {_CHANGED} AS n_changed, {_BOTH}
  FROM got d JOIN r t ON t.replicate = d.replicate AND t.side = d.side AND t.row_id = d.target),
summed AS (SELECT *, sum(n_changed) OVER ({_BY} ORDER BY k, row_id) - n_changed AS earlier FROM weighed WHERE n_changed > 0),
overwritten AS (SELECT * FROM summed WHERE earlier < greatest(1, round_even({_D} * (n_rows * {_P}), 0))),
cells AS (
  SELECT 'completeness' AS operator, replicate, side, row_id, col AS "column", NULL::DOUBLE AS number, NULL::VARCHAR AS token FROM missing
  UNION ALL SELECT 'validity', replicate, side, row_id, col, NULL, token FROM invalid
  UNION ALL SELECT 'precision', replicate, side, row_id, col, {rounded('new', 4)}, NULL FROM noisy
  UNION ALL SELECT 'coherence', replicate, side, row_id, a, {rounded('vb', 4)}, NULL FROM fired
  UNION ALL SELECT 'coherence', replicate, side, row_id, b, {rounded('va', 4)}, NULL FROM fired
  UNION ALL {' UNION ALL '.join(_copied(c) for c in _PREDS)})
SELECT scenario, operator, replicate::INT AS replicate, cells.side, row_id, "column", number, token
FROM cells JOIN (VALUES ('S1', 'train'), ('S2', 'test'), ('S3', 'train'), ('S3', 'test')) s(scenario, side) ON s.side = cells.side"""

#: Every plain CTE is computed once, however often it is read.
ORACLES = {"scenario_grid": re.sub(r"\b(?!\w*_chain\b)(\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", _SQL)}
