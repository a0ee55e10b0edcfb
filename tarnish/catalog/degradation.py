"""Degradation operators on the order-line cohort."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.data import (
    COHORT,
    COHORT_SQL,
    bits_sql,
    cohort,
    round_col,
    rounded,
    small_bits_sql,
    unit_sql,
)
from tarnish.operators import degrade
from tarnish.operators.cells import row_id
from tarnish.spec import INVALID_CATEGORY, INVALID_FLAG, INVALID_TEXT

DENSITY = 0.2
SEED = 7
NUMERIC, PREDICTORS = COHORT.numeric, COHORT.predictors


def _with_row_id(df: DataFrame, digits: int | None = None) -> DataFrame:
    if digits is None:
        return df.select(row_id(COHORT).alias("row_id"), *PREDICTORS)
    numeric = [round_col(F.col(c), digits).alias(c) for c in NUMERIC]
    return df.select(row_id(COHORT).alias("row_id"), *numeric, *COHORT.categorical)


def degrade_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_row_id(degrade.completeness(cohort(spark, sf_dir), COHORT, DENSITY, SEED).df)


def degrade_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written token of every touched cell; the rest of the table is unchanged."""
    return degrade.validity(cohort(spark, sf_dir), COHORT, DENSITY, SEED).touched.select(
        "row_id", "column", "dimension", F.col("after").alias("token")
    )


def degrade_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_row_id(degrade.precision(cohort(spark, sf_dir), COHORT, DENSITY, SEED).df, 4)


def degrade_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_row_id(degrade.coherence(cohort(spark, sf_dir), COHORT, DENSITY, SEED).df)


def degrade_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_row_id(degrade.uniqueness(cohort(spark, sf_dir), COHORT, DENSITY, SEED).df)


# ------------------------------------------------------------------ oracle text


def cells_sql(columns: list[str], source: str = "cohort") -> str:
    """Long form of the cohort: one row per cell, numeric value or text."""
    parts = []
    for c in columns:
        num, txt = ("NULL::DOUBLE", c) if c in COHORT.categorical else (c, "NULL::VARCHAR")
        parts.append(f"SELECT row_id, '{c}' AS col, {num} AS num, {txt} AS txt, filled AS severe FROM {source}")
    return " UNION ALL ".join(parts)


def wide_sql(cells: str) -> str:
    """Back to one row per row id from (row_id, col, num, txt)."""
    picks = [
        f"max(CASE WHEN col = '{c}' THEN {'txt' if c in COHORT.categorical else 'num'} END) AS {c}"
        for c in PREDICTORS
    ]
    return f"SELECT row_id, {', '.join(picks)} FROM {cells} GROUP BY row_id"


def cell_text(seed: int, purpose: str = "") -> str:
    """What the draw of a cell hashes."""
    return f"concat('{seed}:', row_id, ':', col{f", ':{purpose}'" if purpose else ''})"


CELL_TEXT = cell_text(SEED)


def _in(columns) -> str:
    return "(" + ", ".join(f"'{c}'" for c in columns) + ")"


def _choice(values, bits: str) -> str:
    return f"(ARRAY[{', '.join(chr(39) + v + chr(39) for v in values)}])[({bits} % {len(values)}) + 1]"


HIGH, LOW = "(1.0 / (1.0 + exp(-2.5)))", "(1.0 / (1.0 + exp(2.5)))"

COMPLETENESS_SQL = f"""WITH {COHORT_SQL},
cells AS ({cells_sql(PREDICTORS)}),
keyed AS (SELECT *, -ln({unit_sql(CELL_TEXT)}) / (CASE WHEN severe = 1 THEN {HIGH} ELSE {LOW} END) AS k FROM cells),
ranked AS (SELECT *, row_number() OVER (ORDER BY k, concat(row_id, ':', col)) AS rn FROM keyed),
hit AS (SELECT row_id, col,
          CASE WHEN rn > (SELECT floor({DENSITY}::DOUBLE * count(*) * {len(PREDICTORS)}) FROM cohort) THEN num END AS num,
          CASE WHEN rn > (SELECT floor({DENSITY}::DOUBLE * count(*) * {len(PREDICTORS)}) FROM cohort) THEN txt END AS txt
        FROM ranked)
{wide_sql('hit')}"""


def token_sql(seed: int) -> str:
    """The token that a drawn cell gets."""
    text = cell_text(seed)
    return f"""CASE WHEN col IN {_in(COHORT.categorical)} THEN {_choice(INVALID_CATEGORY, small_bits_sql(text))}
       WHEN col IN {_in(COHORT.flags)} AND {unit_sql(text, 1)} >= 0.6 THEN {_choice(INVALID_FLAG, small_bits_sql(text))}
       ELSE {_choice(INVALID_TEXT, small_bits_sql(text))} END"""


VALIDITY_SQL = f"""WITH {COHORT_SQL},
cells AS ({cells_sql(PREDICTORS)}),
ranked AS (SELECT *, row_number() OVER (ORDER BY {bits_sql(CELL_TEXT)}, concat(row_id, ':', col)) AS rn FROM cells)
SELECT row_id, col AS "column", 'validity' AS dimension, {token_sql(SEED)} AS token
FROM ranked
WHERE rn <= (SELECT round_even({DENSITY}::DOUBLE * count(*) * {len(PREDICTORS)}, 0) FROM cohort)"""


def disturbed_sql(cells: str, seed: int) -> str:
    """CTEs over long ``cells``: ``rated`` with the shares of the modes, ``keyed`` with the order of
    the draw ``k`` and the value ``new`` that a drawn cell gets."""
    text, noise = cell_text(seed), cell_text(seed, "noise")
    return f"""rated AS (SELECT *,
    CASE WHEN col = 'quantity' THEN 0.3 WHEN col = 'price' AND num <> 0 THEN 0.3 ELSE 0.0 END::DOUBLE AS bias,
    CASE WHEN col IN {_in(COHORT.flags)} OR num <> 0 THEN 0.1 ELSE 0.0 END::DOUBLE AS impulse
  FROM {cells}),
drawn_modes AS (SELECT *, -ln({unit_sql(text)}) / (0.6::DOUBLE + bias + impulse) AS k,
    {unit_sql(text, 1)} * (0.6::DOUBLE + bias + impulse) AS mode,
    sqrt(-2.0::DOUBLE * ln({unit_sql(noise)})) * cos(2.0::DOUBLE * pi() * {unit_sql(noise, 1)}) AS z,
    CASE WHEN col = 'price' THEN 0.03 WHEN col IN {_in(COHORT.flags)} THEN 0.10 ELSE 0.05 END::DOUBLE AS cv
  FROM rated),
keyed AS (SELECT *, CASE
    WHEN mode < 0.6 THEN num + cv * (CASE WHEN num <> 0 THEN abs(num) ELSE 1.0 END)
                              * (CASE WHEN z < 0 THEN -1 ELSE 1 END) * greatest(abs(z), 1e-6)
    WHEN mode < 0.6::DOUBLE + bias THEN CASE WHEN col = 'quantity' THEN num + 1.0 ELSE num * 1.05 END
    WHEN col IN {_in(COHORT.flags)} THEN CASE WHEN num <> 0 THEN 0.0 ELSE 1.0 END
    WHEN {small_bits_sql(noise)} % 2 = 0 THEN num * 0.1 ELSE num * 10.0 END AS new
  FROM drawn_modes)"""


def precision_sql(digits: int | None) -> str:
    """The disturbed cohort, numbers rounded to ``digits`` if given."""
    shown = [f"{rounded('flat.' + c, digits)} AS {c}" if digits else f"flat.{c}" for c in NUMERIC]
    return f"""WITH {COHORT_SQL},
cells AS ({cells_sql(NUMERIC)}),
{disturbed_sql('cells', SEED)},
ranked AS (SELECT *, row_number() OVER (ORDER BY k, concat(row_id, ':', col)) AS rn FROM keyed),
hit AS (SELECT row_id, col, txt, CASE WHEN rn > (SELECT round_even({DENSITY}::DOUBLE * count(*), 0) FROM cells) THEN num ELSE new END AS num FROM ranked),
flat AS ({wide_sql('hit')})
SELECT row_id, {', '.join(shown)}, cohort.status
FROM flat JOIN cohort USING (row_id)"""


def swap_ctes(source: str, budget: str, seed: int) -> str:
    """CTEs ending in ``swapped``: ``source`` with exchanged values and ``mate_c``, the column that a
    swapped cell's value comes from."""
    flag_pairs = list(combinations(COHORT.flags, 2))
    options = []
    for a, b in COHORT.swaps:
        u = unit_sql(f"concat('{seed}:', row_id, ':{a}~{b}')")
        options.append(f"SELECT row_id, '{a}' AS a, '{b}' AS b, -ln({u}) AS k FROM {source} WHERE {a} <> {b}")
    flags = []
    for a, b in flag_pairs:
        u = unit_sql(f"concat('{seed}:', row_id, ':{a}~{b}')")
        rate = f"{1.0 / len(flag_pairs)!r}::DOUBLE"
        flags.append(f"SELECT row_id, '{a}' AS a, '{b}' AS b, -ln({u}) / {rate} AS k FROM {source} WHERE {a} <> {b}")
    picks = []
    for c in NUMERIC:
        mates = [m for p in [*COHORT.swaps, *flag_pairs] if c in p for m in p if m != c]
        cases = " ".join(f"WHEN mate_{c} = '{m}' THEN s.{m}" for m in mates)
        picks.append(f"CASE {cases} ELSE s.{c} END AS {c}, mate_{c}")
    mates = ", ".join(
        f"max(CASE WHEN a = '{c}' THEN b WHEN b = '{c}' THEN a END) AS mate_{c}" for c in NUMERIC
    )
    return f"""flag_options AS ({' UNION ALL '.join(flags)}),
flag_first AS (SELECT * FROM flag_options QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY k, a, b) = 1),
flag_second AS (
  SELECT o.* FROM flag_options o JOIN flag_first f USING (row_id)
  WHERE o.a NOT IN (f.a, f.b) AND o.b NOT IN (f.a, f.b)),
options AS ({' UNION ALL '.join(options)} UNION ALL SELECT * FROM flag_first UNION ALL SELECT * FROM flag_second),
fired AS (SELECT * FROM options QUALIFY row_number() OVER (ORDER BY k, row_id, a, b) <= {budget}),
mates AS (SELECT row_id, {mates} FROM fired GROUP BY row_id),
swapped AS (SELECT s.row_id, {', '.join(picks)}, s.status FROM {source} s LEFT JOIN mates ON s.row_id = mates.row_id)"""


def _swap_sql() -> str:
    budget = f"(SELECT ceil(round_even({DENSITY}::DOUBLE * count(*) * {len(NUMERIC)}, 0) / 2.0) FROM cohort)"
    return f"WITH {COHORT_SQL}, {swap_ctes('cohort', budget, SEED)} SELECT row_id, {', '.join(NUMERIC)}, status FROM swapped"


def chain_sql(pairs: str, name: str) -> str:
    """CTEs ending in ``name(row_id, end_id)``: from donor to donor, as long as each was a target earlier."""
    return f"""{name}_chain AS (
  SELECT row_id, donor_id AS end_id, k, row_id AS last, 0 AS hops FROM {pairs}
  UNION ALL
  SELECT c.row_id, n.donor_id, n.k, n.row_id, c.hops + 1 FROM {name}_chain c
  JOIN {pairs} n ON n.row_id = c.end_id AND (n.k < c.k OR (n.k = c.k AND n.row_id < c.last))),
{name} AS (SELECT row_id, arg_max(end_id, hops) AS end_id FROM {name}_chain GROUP BY row_id)"""


def copies_sql(source: str, budget: str, seed: int, predictors: list[str], donor: str) -> str:
    """CTEs ending in ``pairs(row_id, donor_id, k, end_id)`` for record copies over ``source``; they
    need WITH RECURSIVE. A donor that was overwritten earlier hands on what it then holds."""

    def text(tag: str) -> str:
        return f"concat('{seed}:', row_id, ':{tag}')"

    changed = " + ".join(f"(CASE WHEN t.{c} IS NOT DISTINCT FROM d.{c} THEN 0 ELSE 1 END)" for c in predictors)
    return f"""edge AS (SELECT quantile_cont({donor}, 0.8) AS q, count(*) AS n FROM {source}),
pool AS (
  SELECT *, 'all' AS pool FROM {source}
  UNION ALL SELECT s.*, 'upper' AS pool FROM {source} s, edge WHERE {donor} >= q),
donors AS (
  SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {bits_sql(text('donor-order'))}, row_id) - 1 AS ordinal,
         count(*) OVER (PARTITION BY pool) AS size FROM pool),
sizes AS (SELECT pool, any_value(size) AS size FROM donors GROUP BY pool),
targets AS (
  SELECT *, {unit_sql(text('copy'))} AS k, {bits_sql(text('donor'))} AS draw,
         CASE WHEN {unit_sql(text('copy'), 1)} < 1.0::DOUBLE / 3.0 THEN 'upper' ELSE 'all' END AS tpool
  FROM {source}),
drawn AS (
  SELECT t.row_id, d.row_id AS donor_id, t.k
  FROM targets t JOIN sizes s ON s.pool = t.tpool
  JOIN donors d ON d.pool = t.tpool AND d.ordinal = t.draw % s.size
  WHERE t.row_id <> d.row_id),
{chain_sql('drawn', 'ends')},
paired AS (
  SELECT w.*, e.end_id, {changed} AS n_changed
  FROM drawn w JOIN ends e USING (row_id) JOIN {source} t USING (row_id) JOIN {source} d ON d.row_id = e.end_id),
running AS (
  SELECT *, sum(n_changed) OVER (ORDER BY k, row_id) - n_changed AS earlier FROM paired WHERE n_changed > 0),
pairs AS (SELECT row_id, donor_id, k, end_id FROM running WHERE earlier < {budget})"""


UNIQUENESS_SQL = f"""WITH RECURSIVE {COHORT_SQL},
{copies_sql('cohort', f'(SELECT round_even({DENSITY}::DOUBLE * count(*) * {len(PREDICTORS)}, 0) FROM cohort)', SEED, PREDICTORS, 'price')}
SELECT c.row_id, {', '.join(f'CASE WHEN p.end_id IS NULL THEN c.{x} ELSE d.{x} END AS {x}' for x in PREDICTORS)}
FROM cohort c LEFT JOIN pairs p ON c.row_id = p.row_id LEFT JOIN cohort d ON d.row_id = p.end_id"""

QUERIES = {
    "degrade_completeness": degrade_completeness,
    "degrade_validity": degrade_validity,
    "degrade_precision": degrade_precision,
    "degrade_coherence": degrade_coherence,
    "degrade_uniqueness": degrade_uniqueness,
}
ORACLES = {
    "degrade_completeness": COMPLETENESS_SQL,
    "degrade_validity": VALIDITY_SQL,
    "degrade_precision": precision_sql(4),
    "degrade_coherence": _swap_sql(),
    "degrade_uniqueness": UNIQUENESS_SQL,
}
