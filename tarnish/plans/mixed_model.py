"""Random-intercept model of the loss table from distributed sufficient statistics.

    loss ~ dimension * model + level + dimension:level + (1 | replicate)

Spark reduces the loss table to cell totals and to cross products of per-replicate
design sums, grouped by replicate size; what reaches the driver is bounded by the
design (about 35 columns), not by the data. The driver then searches one variance ratio.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.operators.ordering import prefix_sums


@dataclass(frozen=True)
class Fit:
    """Estimates: fitted mean per cell, residual and between-replicate variance."""

    cells: dict[tuple[str, str, int], float]
    sigma_e2: float
    sigma_u2: float
    n_rows: int
    n_fixed: int

    @property
    def ratio(self) -> float:
        return self.sigma_u2 / self.sigma_e2

    @property
    def icc(self) -> float:
        return self.sigma_u2 / (self.sigma_u2 + self.sigma_e2)


def design(dims: Sequence[str], models: Sequence[str], levels: Sequence[int]) -> dict[tuple[str, str, int], np.ndarray]:
    """Treatment-coded design row of every cell; first entries are the references."""
    out = {}
    for d in dims:
        for m in models:
            for lv in levels:
                is_d = [float(d == x) for x in dims[1:]]
                is_m = [float(m == x) for x in models[1:]]
                is_l = [float(lv == x) for x in levels[1:]]
                row = [1.0, *is_d, *is_m, *is_l]
                row += [a * b for a in is_d for b in is_m] + [a * b for a in is_d for b in is_l]
                out[d, m, lv] = np.array(row)
    return out


def _cross_products(width: int):
    """Per batch of replicates: sum of outer products of their (design, y) sums by size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            sums = np.array(pdf["sums"].tolist(), dtype=float)
            for size, index in pdf.groupby("n").indices.items():
                block = sums[index]
                gram = block.T @ block
                i, j = np.triu_indices(width)
                yield pd.DataFrame({"n": int(size), "i": i, "j": j, "v": gram[i, j], "r": len(index)})

    return run


def fit(loss: DataFrame, dims: Sequence[str], models: Sequence[str], levels: Sequence[int]) -> Fit:
    """Restricted maximum likelihood fit of the random-intercept model."""
    rows = loss.filter(
        F.col("loss").isNotNull() & F.col("dimension").isin(list(dims)) & F.col("model").isin(list(models))
        & F.col("level").isin(list(levels))
    )
    x = design(dims, models, levels)
    p = len(next(iter(x.values())))
    totals = rows.groupBy("dimension", "model", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("s"), F.sum(F.col("loss") * F.col("loss")).alias("q")
    ).collect()
    xtx, xty, yty, n_rows = np.zeros((p, p)), np.zeros(p), 0.0, 0
    for t in totals:
        row = x[t["dimension"], t["model"], t["level"]]
        xtx += t["n"] * np.outer(row, row)
        xty += t["s"] * row
        yty += t["q"]
        n_rows += t["n"]
    # one row per replicate: cell counts in a fixed order, turned into design sums
    order = list(x)
    number = {c: i for i, c in enumerate(order)}
    cell = F.create_map(*[v for (d, m, lv), i in number.items() for v in (F.lit(f"{d}|{m}|{lv}"), F.lit(i))])
    cell_of = F.try_element_at(cell, F.concat_ws("|", "dimension", "model", F.col("level").cast("string")))
    per_cell = rows.withColumn("cell", cell_of)
    counts = [F.count_if(F.col("cell") == i).cast("double") for i in range(len(order))]
    per_replicate = per_cell.groupBy("replicate").agg(
        F.count(F.lit(1)).alias("n"), F.array(*counts).alias("counts"), F.sum("loss").alias("t")
    )
    matrix = np.array([x[c] for c in order])

    def to_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            sums = np.array(pdf["counts"].tolist(), dtype=float) @ matrix
            both = np.column_stack([sums, pdf["t"].to_numpy()])
            yield pd.DataFrame({"n": pdf["n"], "sums": list(both)})

    products = (
        per_replicate.mapInPandas(to_sums, "n long, sums array<double>")
        .mapInPandas(_cross_products(p + 1), "n long, i int, j int, v double, r long")
        .groupBy("n", "i", "j")
        .agg(F.sum("v").alias("v"), F.sum("r").alias("r"))
        .collect()
    )
    grams: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}
    for r in products:
        g = grams.setdefault(r["n"], np.zeros((p + 1, p + 1)))
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
        sizes[r["n"]] = r["r"]
    full = np.zeros((p + 1, p + 1))
    full[:p, :p], full[:p, p], full[p, :p], full[p, p] = xtx, xty, xty, yty
    rank = int(np.linalg.matrix_rank(xtx))

    def solve(ratio: float):
        a = full - sum(ratio / (1 + n * ratio) * g for n, g in grams.items())
        beta = np.linalg.pinv(a[:p, :p], hermitian=True) @ a[:p, p]
        rss = a[p, p] - beta @ a[:p, p]
        values = np.linalg.eigvalsh(a[:p, :p])[-rank:]
        log_v = sum(sizes[n] * np.log1p(n * ratio) for n in grams)
        return (n_rows - rank) * np.log(rss) + log_v + np.log(values).sum(), beta, rss

    grid = np.concatenate([[0.0], np.logspace(-8, 4, 121)])
    best = int(np.argmin([solve(r)[0] for r in grid]))
    lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    inv = (np.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - inv * (hi - lo), lo + inv * (hi - lo)
        if solve(a)[0] <= solve(b)[0]:
            hi = b
        else:
            lo = a
    ratio = min([(lo + hi) / 2, 0.0], key=lambda r: solve(r)[0])
    _, beta, rss = solve(ratio)
    sigma_e2 = rss / (n_rows - rank)
    return Fit({c: float(x[c] @ beta) for c in order}, float(sigma_e2), float(ratio * sigma_e2), n_rows, rank)


def icc_row(spark, model: Fit) -> DataFrame:
    row = [(model.icc, model.sigma_u2, model.sigma_e2, model.n_rows, model.n_fixed)]
    return spark.createDataFrame(row, "icc double, sigma_u2 double, sigma_e2 double, n_rows long, n_fixed int")


def residuals(loss: DataFrame, model: Fit) -> DataFrame:
    """Loss rows with ``resid``: what neither the cell nor the replicate's shift explains."""
    spark = loss.sparkSession
    cells = spark.createDataFrame(
        [(d, m, lv, v) for (d, m, lv), v in model.cells.items()], "dimension string, model string, level int, fitted double"
    )
    # the cell table has one row per design cell, a few dozen at most
    joined = loss.join(F.broadcast(cells), ["dimension", "model", "level"]).withColumn(
        "__e", F.col("loss") - F.col("fitted")
    )
    shift = F.lit(model.ratio) * F.sum("__e") / (1 + F.count("__e") * F.lit(model.ratio))
    shifts = joined.groupBy("replicate").agg(shift.alias("__shift"))
    return joined.join(shifts, "replicate").withColumn("resid", F.col("__e") - F.col("__shift")).drop("__e", "__shift")


def skewness(residual: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Population skewness of the residuals and their number."""
    return residual.groupBy(*keys).agg(F.count("resid").alias("n"), F.skewness("resid").alias("skew"))


def skew_ranking(skews: DataFrame, keys: Sequence[str], top: int = 7) -> DataFrame:
    """The most skewed fits in order; a report of ``top`` rows."""
    return skews.orderBy(F.abs("skew").desc(), *keys).limit(top)


def rest_range(skews: DataFrame, ranking: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest and largest skew among the fits that are not in the ranking."""
    rest = skews.join(ranking, list(keys), "left_anti")
    return rest.agg(
        F.count(F.lit(1)).alias("n_rest"),
        F.min("skew").alias("min_skew"),
        F.max("skew").alias("max_skew"),
        F.min_by(F.concat_ws("/", *keys), F.struct(F.col("skew"), F.concat_ws("/", *keys))).alias("min_at"),
        F.max_by(F.concat_ws("/", *keys), F.struct(F.col("skew"), F.concat_ws("/", *keys))).alias("max_at"),
    )


def histogram(residual: DataFrame, bins: int = 60) -> DataFrame:
    """Equal-width histogram of the residuals: bin number (1..bins), edges and count."""
    edge = residual.agg(F.min("resid").alias("lo"), F.max("resid").alias("hi")).collect()[0]
    lo, hi = edge["lo"], edge["hi"]
    width = (hi - lo) / bins
    number = F.least(F.floor((F.col("resid") - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins))
    return residual.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * width).alias("low"), "n"
    )


def plotting_positions(residual: DataFrame, **size) -> DataFrame:
    """Quantile-plot coordinates: each distinct residual with its cumulative probability."""
    tied = residual.groupBy("resid").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(tied, [], "resid", ["n"], **size)
    return placed.select("resid", "n", ((F.col("before_n") + F.col("n") / 2) / F.col("total_n")).alias("prob"))
