"""Metrics of prediction tables and survival metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.catalog.data import round_col, rounded, table
from tarnish.catalog.grid import grid, grid_sql
from tarnish.plans import metrics as M
from tarnish.plans import survival as S

# -------------------------------------------------------------- classification


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned or not (y) against a score from the price; groups of lines and statuses."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_linenumber").alias("bootstrap"),
        F.when(F.col("l_linestatus") == "F", "in_bag").otherwise("oob").alias("split"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.least(F.lit(1.0), F.col("l_extendedprice") / 100000).alias("score"),
    )


SCORES_SQL = """pred AS (
  SELECT l_linenumber AS bootstrap, CASE WHEN l_linestatus = 'F' THEN 'in_bag' ELSE 'oob' END AS split,
         (l_returnflag = 'R')::INT AS y, least(1.0::DOUBLE, l_extendedprice / 100000) AS score
  FROM lineitem)"""

DOCUMENTS_SQL = """pred AS (
  SELECT lang AS bootstrap, source AS split, toxic AS y, n_chars / (n_chars + 2000.0::DOUBLE) AS score
  FROM labels JOIN documents USING (doc_id))"""


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    joined = docs.select("doc_id", "lang", "source", "n_chars").join(labels.select("doc_id", "toxic"), "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))
    return joined.select(
        F.col("lang").alias("bootstrap"), F.col("source").alias("split"), F.col("toxic").alias("y"), score.alias("score")
    )


GROUPS = ["bootstrap", "split"]


def _rounded(df: DataFrame, keys: list[str], digits: int = 8) -> DataFrame:
    return df.select(*keys, *[round_col(F.col(c), digits).alias(c) for c in df.columns if c not in keys])


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = line_scores(spark, sf_dir)
    return _rounded(M.ranking_metrics(pred, GROUPS).select(*GROUPS, "auc"), GROUPS)


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = line_scores(spark, sf_dir)
    return _rounded(M.ranking_metrics(pred, GROUPS).select(*GROUPS, "auprc"), GROUPS)


def f1_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.threshold_metrics(line_scores(spark, sf_dir), GROUPS), GROUPS)


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = document_scores(spark, sf_dir)
    return _rounded(M.classification_metrics(pred, GROUPS), GROUPS)


def prediction_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = M.with_prior(line_scores(spark, sf_dir), ["bootstrap"])
    return _rounded(M.prediction_diagnostics(pred, GROUPS), GROUPS)


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 2).alias("score")
    )
    keys = ["l_returnflag", "l_linestatus"]
    return _rounded(M.regression_metrics(pred, keys), keys, 6)


def _order_sql(body: str) -> str:
    return f"WITH {SCORES_SQL},\n{body}"


def _ranking_sql(source: str) -> str:
    return f"""{source},
tied AS (SELECT bootstrap, split, score, count(*) AS n, sum(y) AS pos FROM pred GROUP BY ALL),
run AS (
  SELECT *, sum(n - pos) OVER (PARTITION BY bootstrap, split ORDER BY score) - (n - pos) AS neg_below,
    sum(pos) OVER (PARTITION BY bootstrap, split ORDER BY score DESC) AS tp,
    sum(n) OVER (PARTITION BY bootstrap, split ORDER BY score DESC) AS said
  FROM tied),
ranking AS (
  SELECT bootstrap, split,
    CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum(pos * (neg_below + (n - pos) / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(n - pos)) END AS auc,
    CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum(pos * tp::DOUBLE / said) / sum(pos) END AS auprc
  FROM run GROUP BY bootstrap, split)"""


_THRESHOLD_SQL = """counts AS (
  SELECT bootstrap, split, count(*) AS n, avg((score - y) * (score - y)) AS brier,
    count(*) FILTER (y = 1 AND score > 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND score > 0.5)::DOUBLE AS fp,
    count(*) FILTER (y = 1 AND score <= 0.5)::DOUBLE AS fn, count(*) FILTER (y = 0 AND score <= 0.5)::DOUBLE AS tn
  FROM pred GROUP BY bootstrap, split),
threshold AS (
  SELECT bootstrap, split, brier, (tp + tn) / n AS accuracy,
    (CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END)
      / ((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT) AS f1_macro
  FROM counts)"""

# ------------------------------------------------------------------ estimators


def _split_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of both arms as in-bag and out-of-bag values of two metrics."""
    rows = grid(spark, sf_dir, "arm")
    cells = F.array(
        F.struct(F.lit("auc").alias("metric"), (F.col("price") / 100000).alias("value")),
        F.struct(F.lit("brier").alias("metric"), (F.col("qty") / 500).alias("value")),
    )
    split = F.when(F.col("arm") == "F", "in_bag").otherwise("oob")
    keys = ["dimension", "model", "level", "replicate"]
    return rows.select(*keys, split.alias("split"), F.explode(cells).alias("m")).select(*keys, "split", "m.*")


KEYS632 = ["dimension", "model", "level", "replicate", "metric"]


def point632(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.point632(_split_values(spark, sf_dir), KEYS632), KEYS632, 9)


def _plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.point632plus(_split_values(spark, sf_dir), KEYS632)


def point632plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_plus(spark, sf_dir), KEYS632, 9)


def estimator_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 2 against level 3 under both estimators, per (model, dimension)."""
    cond = F.when(F.col("level") == 0, "clean").otherwise(F.concat(F.lit("c"), F.col("level").cast("string")))
    parts = _plus(spark, sf_dir).select(
        cond.alias("cond"), F.concat_ws("/", "model", "dimension").alias("model"), "metric", "replicate", "v632", "vplus"
    )
    return _rounded(M.estimator_contrast(parts, "c2", "c3"), ["metric", "model"])


def stage_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels 1 and 2 as the two stages, against the clean mean over dimensions."""
    parts = M.point632(_split_values(spark, sf_dir), KEYS632)
    clean = parts.filter(F.col("level") == 0).groupBy("model", "metric", "replicate").agg(
        F.avg("v632").alias("v632"), F.avg("oob").alias("oob")
    ).select(F.lit("clean").alias("stage"), F.lit(None).cast("string").alias("dimension"), "*")
    staged = parts.filter(F.col("level").isin(1, 2)).select(
        F.concat(F.lit("S"), F.col("level").cast("string")).alias("stage"), "dimension", "model", "metric", "replicate", "v632", "oob"
    )
    out = M.stage_comparison(clean.unionByName(staged))
    keys = ["metric", "model", "flips"]
    return _rounded(out, keys)


PARTS_SQL = f"""{grid_sql('arm')},
long AS (
  SELECT dimension, model, level, replicate, arm, 'auc' AS metric, price / 100000 AS v FROM grid
  UNION ALL SELECT dimension, model, level, replicate, arm, 'brier', qty / 500 FROM grid),
sides AS (
  SELECT dimension, model, level, replicate, metric, max(v) FILTER (arm = 'F') AS inbag, max(v) FILTER (arm <> 'F') AS oob
  FROM long GROUP BY ALL),
parts AS (SELECT *, 0.368::DOUBLE * inbag + 0.632::DOUBLE * oob AS v632 FROM sides),
errs AS (
  SELECT *, CASE WHEN metric = 'auc' THEN 1 - inbag ELSE inbag END AS ei, CASE WHEN metric = 'auc' THEN 1 - oob ELSE oob END AS eo,
    CASE WHEN metric = 'auc' THEN 0.5::DOUBLE ELSE 0.098::DOUBLE END AS gamma FROM parts),
weights AS (
  SELECT *, CASE WHEN v632 IS NOT NULL THEN
    0.632::DOUBLE / (1 - 0.368::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN gamma - ei <= 0 THEN 0 ELSE (eo - ei) / (gamma - ei) END))) END AS w
  FROM errs),
plus AS (SELECT *, CASE WHEN metric = 'auc' THEN 1 - ((1 - w) * ei + w * eo) ELSE (1 - w) * ei + w * eo END AS vplus FROM weights)"""

# ------------------------------------------------------------------- survival


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as subjects: days between order and first shipment, closed or not, price as risk.

    The shipment may lie on either side of the order; the distance in days, folded into
    a horizon of 90, is the duration and 0 is dropped.
    """
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    orders = table(spark, sf_dir, "orders")
    days = F.abs(F.datediff("first_ship", "o_orderdate")) % 181
    return (
        orders.join(line, orders["o_orderkey"] == line["l_orderkey"])
        .select(
            F.substring("o_orderpriority", 1, 1).alias("bootstrap"),
            F.least(days, F.lit(90)).cast("double").alias("time"),
            ((F.col("o_orderstatus") == "F") & (days < 90)).alias("event"),
            (F.col("o_totalprice") / 100000).alias("risk"),
        )
        .filter(F.col("time") > 0)
    )


DURATIONS_SQL = """first_ship AS (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey),
folded AS (
  SELECT substr(o_orderpriority, 1, 1) AS bootstrap, abs(date_diff('day', o_orderdate::DATE, ship::DATE)) % 181 AS days,
         o_orderstatus, o_totalprice / 100000 AS risk
  FROM orders JOIN first_ship ON o_orderkey = l_orderkey),
subj AS (
  SELECT bootstrap, least(days, 90)::DOUBLE AS time, o_orderstatus = 'F' AND days < 90 AS event, risk FROM folded WHERE days > 0)"""


def c_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = durations(spark, sf_dir)
    out = S.c_index(pred, ["bootstrap"])
    return out.select("bootstrap", "concordant", "comparable", F.round("c_index", 9).alias("c_index"))


def km_censoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = durations(spark, sf_dir)
    return S.censoring_law(pred).select("time", F.round("uncensored", 9).alias("uncensored"))


def _baseline(pred: DataFrame) -> DataFrame:
    return S.breslow(pred.withColumn("eta", F.col("risk")), ["bootstrap"])


def breslow(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = durations(spark, sf_dir)
    return _rounded(_baseline(pred), ["bootstrap", "time"])


def hazard_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = durations(spark, sf_dir)
    out = S.hazard_at(_baseline(pred), ["bootstrap"], [0.5, 7.25, 14.0, 30.5, 89.5, 200.0])
    return _rounded(out.drop("center"), ["bootstrap", "point"])


def brier_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = durations(spark, sf_dir)
    scored = pred.withColumn("eta", F.col("risk"))
    out = S.brier_scores(scored, ["bootstrap"], pred, _baseline(pred), S.HORIZONS)
    return _rounded(out, ["bootstrap", "point"])


def ibs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = durations(spark, sf_dir)
    scored = pred.withColumn("eta", F.col("risk"))
    curve = S.brier_scores(scored, ["bootstrap"], pred, _baseline(pred), S.integration_grid(pred))
    return _rounded(S.integrated(curve, ["bootstrap"]), ["bootstrap"])


def survival_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = durations(spark, sf_dir)
    return _rounded(M.survival_diagnostics(pred, ["bootstrap"]), ["bootstrap"])


BASELINE_SQL = f"""{DURATIONS_SQL},
centers AS (SELECT bootstrap, avg(risk) AS center FROM subj GROUP BY bootstrap),
rel AS (SELECT s.*, center, exp(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, risk - center))) AS r FROM subj s JOIN centers USING (bootstrap)),
by_time AS (SELECT bootstrap, time, sum(r) AS r, count(*) FILTER (event) AS d FROM rel GROUP BY bootstrap, time),
steps AS (
  SELECT bootstrap, time, d, d / sum(r) OVER (PARTITION BY bootstrap ORDER BY time DESC) AS step FROM by_time),
baseline AS (
  SELECT bootstrap, time, center, sum(step) OVER (PARTITION BY bootstrap ORDER BY time) AS hazard
  FROM steps JOIN centers USING (bootstrap) WHERE d > 0)"""

KM_SQL = f"""km_time AS (SELECT time, count(*) AS n, count(*) FILTER (NOT event) AS c FROM subj GROUP BY time),
km_step AS (SELECT time, CASE WHEN c > 0 THEN 1 - c::DOUBLE / (sum(n) OVER (ORDER BY time DESC) - (n - c)) ELSE 1.0::DOUBLE END AS f FROM km_time),
km AS (
  SELECT time, CASE WHEN bool_or(f <= 0) OVER w THEN 0.0::DOUBLE ELSE exp(sum(CASE WHEN f > 0 THEN ln(f) ELSE 0 END) OVER w) END AS uncensored
  FROM km_step WINDOW w AS (ORDER BY time))"""


def _points_sql(points: str) -> str:
    """Hazards and censoring law at ``points`` (a table expression with column point)."""
    return f"""near AS (
  SELECT b.bootstrap, p.point, max(CASE WHEN time <= point THEN time END) AS t0, min(CASE WHEN time > point THEN time END) AS t1
  FROM baseline b, ({points}) p GROUP BY b.bootstrap, p.point),
at_point AS (
  SELECT n.bootstrap, n.point, CASE WHEN t0 IS NULL THEN 0.0::DOUBLE WHEN t1 IS NULL THEN lo.hazard
      ELSE lo.hazard + (point - t0) * (hi.hazard - lo.hazard) / (t1 - t0) END AS hazard
  FROM near n LEFT JOIN baseline lo ON lo.bootstrap = n.bootstrap AND lo.time = t0
  LEFT JOIN baseline hi ON hi.bootstrap = n.bootstrap AND hi.time = t1)"""


_BRIER_SQL = """g_point AS (
  SELECT point, coalesce((SELECT uncensored FROM km WHERE time <= point ORDER BY time DESC LIMIT 1), 1.0::DOUBLE) AS gp
  FROM (SELECT DISTINCT point FROM at_point)),
terms AS (
  SELECT s.bootstrap, a.point, exp(-a.hazard * s.r) AS surv, s.time, s.event, k.uncensored AS gt, g.gp
  FROM rel s JOIN at_point a USING (bootstrap) JOIN km k ON k.time = s.time JOIN g_point g USING (point)),
brier AS (
  SELECT bootstrap, point, avg(CASE WHEN event AND time <= point AND gt > 0 THEN surv * surv / gt
      WHEN time > point AND gp > 0 THEN (1 - surv) * (1 - surv) / gp ELSE 0 END) AS brier
  FROM terms GROUP BY bootstrap, point)"""

HORIZON_POINTS = "SELECT unnest([7.0, 14.0, 30.0, 60.0])::DOUBLE AS point"
GRID_SQL_POINTS = """SELECT lo + i * (hi - lo) / 49 AS point FROM (
    SELECT greatest(quantile_cont(time, 0.05), 1e-3) AS lo, least(quantile_cont(time, 0.90), (SELECT max(time) FROM subj) * (1 - 1e-9)) AS hi
    FROM subj WHERE event), range(50) t(i)"""

QUERIES = {
    "auc": auc,
    "average_precision": average_precision,
    "f1_brier": f1_brier,
    "document_metrics": document_metrics,
    "prediction_diagnostics": prediction_diagnostics,
    "regression_metrics": regression_metrics,
    "point632": point632,
    "point632plus": point632plus,
    "estimator_contrast": estimator_contrast,
    "stage_comparison": stage_comparison,
    "c_index": c_index,
    "km_censoring": km_censoring,
    "breslow": breslow,
    "hazard_at": hazard_at,
    "brier_horizons": brier_horizons,
    "ibs": ibs,
    "survival_diagnostics": survival_diagnostics,
}

ORACLES = {
    "auc": f"WITH {_ranking_sql(SCORES_SQL)} SELECT bootstrap, split, {rounded('auc', 8)} AS auc FROM ranking",
    "average_precision": f"WITH {_ranking_sql(SCORES_SQL)} SELECT bootstrap, split, {rounded('auprc', 8)} AS auprc FROM ranking",
    "f1_brier": f"""WITH {SCORES_SQL}, {_THRESHOLD_SQL} SELECT bootstrap, split, {rounded('accuracy', 8)} AS accuracy,
  {rounded('f1_macro', 8)} AS f1_macro, {rounded('brier', 8)} AS brier FROM threshold""",
    "document_metrics": f"""WITH {_ranking_sql(DOCUMENTS_SQL)}, {_THRESHOLD_SQL} SELECT bootstrap, split, {rounded('accuracy', 8)} AS accuracy,
  {rounded('f1_macro', 8)} AS f1_macro, {rounded('brier', 8)} AS brier, {rounded('auc', 8)} AS auc, {rounded('auprc', 8)} AS auprc
  FROM threshold JOIN ranking USING (bootstrap, split)""",
    "prediction_diagnostics": f"""WITH {SCORES_SQL},
priors AS (SELECT bootstrap, avg(y) AS prior FROM pred WHERE split = 'in_bag' GROUP BY bootstrap),
safe AS (SELECT *, greatest(1e-12, least(1 - 1e-12, score)) AS p FROM pred JOIN priors USING (bootstrap))
SELECT bootstrap, split, {rounded('avg(score)', 8)} AS p_mean, {rounded('var_pop(score)', 8)} AS p_var,
  {rounded('avg(-p * ln(p) - (1 - p) * ln(1 - p))', 8)} AS p_entropy, {rounded('avg(abs(score - prior))', 8)} AS p_abs_dist_prior
FROM safe GROUP BY bootstrap, split""",
    "regression_metrics": f"""WITH pred AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 1000 AS y, l_quantity * 2 AS score FROM lineitem)
SELECT l_returnflag, l_linestatus, {rounded('sqrt(avg((score - y) * (score - y)))')} AS rmse, {rounded('avg(abs(score - y))')} AS mae,
  {rounded('1 - avg((score - y) * (score - y)) / var_pop(y)')} AS r2, {rounded('avg(score)')} AS yhat_mean,
  {rounded('var_pop(score)')} AS yhat_var, {rounded('avg(y)')} AS y_mean, {rounded('var_pop(y)')} AS y_var, {rounded('avg(score - y)')} AS bias
FROM pred GROUP BY l_returnflag, l_linestatus""",
    "point632": f"WITH {PARTS_SQL} SELECT dimension, model, level, replicate, metric, {rounded('inbag', 9)} AS inbag, {rounded('oob', 9)} AS oob, {rounded('v632', 9)} AS v632 FROM parts",
    "point632plus": f"""WITH {PARTS_SQL} SELECT dimension, model, level, replicate, metric, {rounded('inbag', 9)} AS inbag, {rounded('oob', 9)} AS oob,
  {rounded('v632', 9)} AS v632, {rounded('w', 9)} AS w, {rounded('vplus', 9)} AS vplus FROM plus""",
    "estimator_contrast": f"""WITH {PARTS_SQL},
wide AS (
  SELECT metric, concat(model, '/', dimension) AS model, replicate, CASE WHEN metric = 'auc' THEN 1 ELSE -1 END AS sgn,
    max(v632) FILTER (level = 0) AS a0, max(v632) FILTER (level = 2) AS a2, max(v632) FILTER (level = 3) AS a3,
    max(vplus) FILTER (level = 0) AS b0, max(vplus) FILTER (level = 2) AS b2, max(vplus) FILTER (level = 3) AS b3
  FROM plus GROUP BY ALL)
SELECT metric, model, {rounded('quantile_cont(sgn * ((a0 - a2) - (a0 - a3)), 0.5)', 8)} AS v632,
  {rounded('quantile_cont(sgn * ((b0 - b2) - (b0 - b3)), 0.5)', 8)} AS vplus FROM wide GROUP BY metric, model""",
    "stage_comparison": f"""WITH {PARTS_SQL},
clean AS (SELECT model, metric, replicate, avg(v632) AS c632, avg(oob) AS coob FROM parts WHERE level = 0 GROUP BY ALL),
med AS (
  SELECT level, dimension, model, metric,
    quantile_cont((c632 - v632) * CASE WHEN metric = 'auc' THEN 1 ELSE -1 END, 0.5) AS l632,
    quantile_cont((coob - oob) * CASE WHEN metric = 'auc' THEN 1 ELSE -1 END, 0.5) AS loob
  FROM parts JOIN clean USING (model, metric, replicate) WHERE level IN (1, 2) GROUP BY ALL),
st AS (
  SELECT metric, model, avg(l632) FILTER (level = 1) AS s1_632, avg(loob) FILTER (level = 1) AS s1_oob,
    avg(l632) FILTER (level = 2) AS s2_632, avg(loob) FILTER (level = 2) AS s2_oob FROM med GROUP BY metric, model)
SELECT metric, model, (s2_632 - s1_632 > 0) <> (s2_oob - s1_oob > 0) AS flips, {rounded('s1_632', 8)} AS s1_632, {rounded('s1_oob', 8)} AS s1_oob,
  {rounded('s2_632', 8)} AS s2_632, {rounded('s2_oob', 8)} AS s2_oob, {rounded('s2_632 - s1_632', 8)} AS gap_632, {rounded('s2_oob - s1_oob', 8)} AS gap_oob FROM st""",
    "c_index": f"""WITH {DURATIONS_SQL},
pairs AS (
  SELECT a.bootstrap, sum(CASE WHEN a.risk > b.risk THEN 1.0::DOUBLE WHEN a.risk = b.risk THEN 0.5::DOUBLE ELSE 0 END) AS concordant,
    count(*)::DOUBLE AS comparable
  FROM subj a JOIN subj b ON a.bootstrap = b.bootstrap AND a.event AND (a.time < b.time OR (a.time = b.time AND NOT b.event)) GROUP BY a.bootstrap)
SELECT bootstrap, concordant, comparable, round(concordant / comparable, 9) AS c_index FROM pairs""",
    "km_censoring": f"WITH {DURATIONS_SQL}, {KM_SQL} SELECT time, round(uncensored, 9) AS uncensored FROM km",
    "breslow": f"WITH {BASELINE_SQL} SELECT bootstrap, time, {rounded('hazard', 8)} AS hazard, {rounded('center', 8)} AS center FROM baseline",
    "hazard_at": f"""WITH {BASELINE_SQL}, {_points_sql("SELECT unnest([0.5, 7.25, 14.0, 30.5, 89.5, 200.0])::DOUBLE AS point")}
SELECT bootstrap, point, {rounded('hazard', 8)} AS hazard FROM at_point""",
    "brier_horizons": f"WITH {BASELINE_SQL}, {KM_SQL}, {_points_sql(HORIZON_POINTS)}, {_BRIER_SQL} SELECT bootstrap, point, {rounded('brier', 8)} AS brier FROM brier",
    "ibs": f"""WITH {BASELINE_SQL}, {KM_SQL}, {_points_sql(GRID_SQL_POINTS)}, {_BRIER_SQL},
areas AS (
  SELECT *, (lead(point) OVER w - point) * (lead(brier) OVER w + brier) / 2 AS area FROM brier WINDOW w AS (PARTITION BY bootstrap ORDER BY point))
SELECT bootstrap, {rounded('sum(area) / (max(point) - min(point))', 8)} AS ibs FROM areas GROUP BY bootstrap""",
    "survival_diagnostics": f"""WITH {DURATIONS_SQL} SELECT bootstrap, {rounded('avg(risk)', 8)} AS risk_mean, {rounded('var_pop(risk)', 8)} AS risk_var,
  {rounded('avg(event::INT)', 8)} AS event_rate, quantile_cont(time, 0.5) AS median_time FROM subj GROUP BY bootstrap""",
}
