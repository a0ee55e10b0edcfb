"""The five degradation operators, each a function (df, spec, density, seed) -> Degraded.

Cell-level operators write the working table once with a uniform per cell, count key intervals
to find the exact-budget boundary, and rewrite cells with a literal predicate. No shuffle
carries the table itself. Only record copies need a join.

With ``groups`` an operator works on every group of rows by itself, all groups in one plan: the
seed may then be a column, and boundaries are a table with a row per group.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from itertools import combinations
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions.hashing import (
    digest,
    exponential_rank,
    gaussian,
    pick,
    small_bits,
    unit,
    wide_bits,
)
from tarnish.operators.cells import (
    Degraded,
    Scope,
    Share,
    as_text,
    base_cells,
    candidates,
    close_cells,
    free,
    nothing_touched,
    open_cells,
    untouched,
    write_cells,
)
from tarnish.operators.ordering import column_quantiles, grouped_quantiles, number_rows
from tarnish.operators.selection import Cut, GroupedCut
from tarnish.session import staged, staged_alone
from tarnish.spec import INVALID_FLAG, INVALID_TEXT, TableSpec

SEVERITY_SLOPE = 5.0
SEVERE = 1.0 / (1.0 + math.exp(-SEVERITY_SLOPE / 2))
MILD = 1.0 / (1.0 + math.exp(SEVERITY_SLOPE / 2))
VALIDITY_KINDS = {"typing": 0.6, "bool_ood": 0.4}
MODE_SHARES = {"noise": 0.6, "bias": 0.3, "impulse": 0.1}
#: Most of the keys of :func:`exponential_rank` lie below.
EXPONENTIAL = 1.0 / 64.0
#: How many times the share of rows that copies would take, did they change every cell, are paired at first.
COPY_SLACK = 2.0


class DegradationOp(Protocol):
    """Anything with this signature can be used where an operator is expected."""

    def __call__(self, df: DataFrame, spec: TableSpec, density: float, seed: int) -> Degraded: ...


def check_density(density: float) -> None:
    if not 0.0 <= density <= 1.0:
        raise ValueError("density must lie in [0, 1]")


def draws(columns: Sequence[str], seed: int | Column, *purpose: str) -> dict[str, Column]:
    """One uniform per cell."""
    return {c: unit(wide_bits(digest(seed, F.col("__row"), c, *purpose))) for c in columns}


def holding(df: DataFrame, spec: TableSpec, **uniforms: Mapping[str, Column]) -> DataFrame:
    """The working table with columns ``__u_name_c``, written once: boundaries are found and cells
    written from stored uniforms, and no cell is hashed twice. What is the same for every row of an
    untouched table is not written."""
    drawn = {f"__u_{name}_{c}": u for name, cells in uniforms.items() for c, u in cells.items()}
    return untouched(staged(base_cells(df, spec).withColumns(drawn)), spec)


def held(columns: Sequence[str], name: str) -> dict[str, Column]:
    return {c: F.col(f"__u_{name}_{c}") for c in columns}


def scope_of(work: DataFrame, groups: Sequence[str] = ()) -> Scope:
    if not groups:
        return Scope(work.count())
    return Scope(None, tuple(groups), staged(work.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"))))


# ---------------------------------------------------------------- completeness


def severity_weight(spec: TableSpec) -> Column:
    """Logistic weight of a row: severe rows lose cells about twelve times as often."""
    if spec.severity is None:
        return F.lit(1.0)
    return F.when(F.col(f"__was_{spec.severity}") == 1, F.lit(SEVERE)).otherwise(F.lit(MILD))


def missing_keys(spec: TableSpec, uniforms: Mapping[str, Column]) -> dict[str, Column]:
    weight = severity_weight(spec)
    return {c: F.when(free(c) & F.col(c).isNotNull(), exponential_rank(uniforms[c], weight, MILD)) for c in spec.predictors}


def mark_missing(work: DataFrame, spec: TableSpec, share: Share | int, uniforms: Mapping[str, Column], scope: Scope) -> DataFrame:
    keys = missing_keys(spec, uniforms)
    cut = scope.cut(candidates(work, keys, scope.groups), share, EXPONENTIAL)
    return write_cells(work, cut, keys, {c: F.lit(None) for c in keys}, "completeness")


def completeness(df: DataFrame, spec: TableSpec, density: float, seed: int | Column = 0, groups: Sequence[str] = ()) -> Degraded:
    """Null out a share of the cells, severe rows first in line.

    The budget is ``int(density * rows * predictors)`` and is capped at the cells that
    hold a value; already missing cells are never drawn.
    """
    check_density(density)
    if density == 0.0:
        return nothing_touched(df)
    preds = spec.predictors
    work = holding(df, spec, own=draws(preds, seed))
    share = Share(density, len(preds), whole=True)
    return close_cells(mark_missing(work, spec, share, held(preds, "own"), scope_of(work, groups)), spec, df.columns)


# -------------------------------------------------------------------- validity


def validity_token(spec: TableSpec, c: str, seed: int, kinds: Mapping[str, float]) -> Column:
    hexed = digest(seed, F.col("__row"), c)
    if c in spec.categorical:
        return pick(small_bits(hexed), list(spec.invalid_category))
    text = pick(small_bits(hexed), INVALID_TEXT)
    if c not in spec.flags:
        return text
    typing_share = kinds["typing"] / sum(kinds.values())
    is_typing = unit(wide_bits(hexed, 1)) < F.lit(typing_share)
    return F.when(is_typing, text).otherwise(pick(small_bits(hexed), INVALID_FLAG))


def mark_invalid(
    work: DataFrame,
    spec: TableSpec,
    share: Share | int,
    uniforms: Mapping[str, Column],
    scope: Scope,
    seed: int | Column,
    kinds: Mapping[str, float] = VALIDITY_KINDS,
) -> DataFrame:
    keys = {c: F.when(free(c), uniforms[c]) for c in spec.predictors}
    cut = scope.cut(candidates(work, keys, scope.groups), share)
    values = {c: validity_token(spec, c, seed, kinds) for c in keys}
    return write_cells(as_text(work, spec.predictors), cut, keys, values, "validity")


def validity(
    df: DataFrame,
    spec: TableSpec,
    density: float,
    seed: int | Column = 42,
    groups: Sequence[str] = (),
    kinds: Mapping[str, float] = VALIDITY_KINDS,
) -> Degraded:
    """Overwrite a share of the cells with tokens outside their column's domain.

    Predictors come back as strings. ``kinds`` weighs unparsable text against
    out-of-range codes; the latter exist for 0/1 flags only, other columns get text.
    """
    check_density(density)
    if density == 0.0:
        return nothing_touched(df)
    preds = spec.predictors
    work = holding(df, spec, own=draws(preds, seed))
    marked = mark_invalid(work, spec, Share(density, len(preds)), held(preds, "own"), scope_of(work, groups), seed, kinds)
    return close_cells(marked, spec, df.columns)


# ------------------------------------------------------------------- precision


def _stays_finite(c: str) -> Column:
    """Whether the cell is finite and an impulse, the largest change there is, keeps it so."""
    return F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(sys.float_info.max / 10))


def _mode_shares(spec: TableSpec, c: str) -> tuple[Column, Column]:
    """Shares of bias and impulse that would change this cell (noise always does)."""
    x = F.col(c)
    moved = F.when(x != 0, F.lit(1.0)).otherwise(F.lit(0.0))
    if c in spec.additive_bias:
        bias = F.lit(MODE_SHARES["bias"])
    elif c in spec.multiplicative_bias:
        bias = F.lit(MODE_SHARES["bias"]) * moved
    else:
        bias = F.lit(0.0)
    impulse = F.lit(MODE_SHARES["impulse"]) * (F.lit(1.0) if c in spec.flags else moved)
    return bias, impulse


def precision_keys(spec: TableSpec, uniforms: Mapping[str, Column]) -> dict[str, Column]:
    """A draw that would leave its cell unchanged is redrawn elsewhere, so cells are
    taken in proportion to the share of modes that do change them."""
    keys = {}
    for c in spec.numeric:
        bias, impulse = _mode_shares(spec, c)
        weight = F.lit(MODE_SHARES["noise"]) + bias + impulse
        keys[c] = F.when(free(c) & _stays_finite(c), exponential_rank(uniforms[c], weight, MODE_SHARES["noise"]))
    return keys


def precision_value(spec: TableSpec, c: str, seed: int | Column) -> Column:
    """New value of a chosen cell; the mode is drawn among those that change it."""
    x = F.col(c)
    bias_share, impulse_share = _mode_shares(spec, c)
    noise_share = F.lit(MODE_SHARES["noise"])
    mode = unit(wide_bits(digest(seed, F.col("__row"), c), 1)) * (noise_share + bias_share + impulse_share)
    noise = digest(seed, F.col("__row"), c, "noise")
    cv = spec.noise_cv.get(c, spec.default_cv)
    sigma = F.when(x != 0, F.lit(cv) * F.abs(x)).otherwise(F.lit(cv))
    noisy = x + sigma * gaussian(unit(wide_bits(noise, 0)), unit(wide_bits(noise, 1)))
    if c in spec.additive_bias:
        biased = x + F.lit(spec.additive_bias[c])
    else:
        biased = x * F.lit(1.0 + spec.multiplicative_bias.get(c, 0.0))
    if c in spec.flags:
        jolted = F.when(x != 0, F.lit(0.0)).otherwise(F.lit(1.0))
    else:
        jolted = x * F.when(F.pmod(small_bits(noise), F.lit(2)) == 0, F.lit(0.1)).otherwise(F.lit(10.0))
    return F.when(mode < noise_share, noisy).when(mode < noise_share + bias_share, biased).otherwise(jolted)


def mark_imprecise(
    work: DataFrame, spec: TableSpec, share: Share | int, uniforms: Mapping[str, Column], scope: Scope, seed: int | Column
) -> DataFrame:
    keys = precision_keys(spec, uniforms)
    cut = scope.cut(candidates(work, keys, scope.groups), share, EXPONENTIAL)
    return write_cells(work, cut, keys, {c: precision_value(spec, c, seed) for c in keys}, "precision")


def precision(df: DataFrame, spec: TableSpec, density: float, seed: int | Column = 42, groups: Sequence[str] = ()) -> Degraded:
    """Disturb a share of the finite numeric cells by noise, bias or an impulse."""
    check_density(density)
    if density == 0.0:
        return nothing_touched(df)
    work = holding(df, spec, own=draws(spec.numeric, seed))
    marked = mark_imprecise(work, spec, Share(density), held(spec.numeric, "own"), scope_of(work, groups), seed)
    return close_cells(marked, spec, df.columns)


# ------------------------------------------------------------------- coherence


def _swap_options(spec: TableSpec) -> list[tuple[str, str, float]]:
    """The pairs of cells that may be exchanged and their rates: the rules, then any two flags."""
    flag_pairs = list(combinations(spec.flags, 2))
    return [(a, b, 1.0) for a, b in spec.swaps] + [(a, b, 1.0 / len(flag_pairs)) for a, b in flag_pairs]


def _clashes(options: Sequence[tuple[str, str, float]]) -> list[list[int]]:
    """The options by connected component: two options clash where they share a cell."""
    parts: list[tuple[set[str], list[int]]] = []
    for i, (a, b, _) in enumerate(options):
        joined = [p for p in parts if p[0] & {a, b}]
        parts = [p for p in parts if not p[0] & {a, b}]
        parts.append(({a, b}.union(*[p[0] for p in joined]), sorted([i, *[j for p in joined for j in p[1]]])))
    return [members for _, members in parts]


def swap_columns(spec: TableSpec) -> list[str]:
    """The columns of :func:`with_swaps`, one per option."""
    return [f"__swap_{i}" for i in range(len(_swap_options(spec)))]


def with_swaps(work: DataFrame, spec: TableSpec, seed: int | Column) -> DataFrame:
    """Add ``__swap_i``: the key of the row's swap number i, null where it cannot fire.

    A rule is possible when both cells are free, present and different. Any two flags
    may be exchanged too; their pairs share the rate of one rule. A pair that meets a
    cell of an earlier pair drops out: of the options that share cells the smallest key is
    taken, then the smallest among those that it leaves, and so on, by plain comparisons.
    """
    rated, names = _swap_options(spec), swap_columns(spec)
    lightest = min(rate for _, _, rate in rated)
    keys = {}
    for name, (a, b, rate) in zip(names, rated):
        u = unit(wide_bits(digest(seed, F.col("__row"), f"{a}~{b}")))
        possible = free(a) & free(b) & (F.col(a) != F.col(b))
        keys[name] = F.when(possible, exponential_rank(u, F.lit(rate), lightest))
    work = work.withColumns(keys)
    for members in _clashes(rated):
        if len(members) == 1:
            continue
        members = sorted(members, key=lambda i: (f":{rated[i][0]}~{rated[i][1]}".encode(), rated[i][:2]))
        cells = {i: set(rated[i][:2]) for i in members}
        rounds = min(len(members), len(set().union(*cells.values())) // 2)
        picked: list[Column] = []
        for k in range(rounds):
            left = {}
            for i in members:
                clash = [j for j in members if cells[i] & cells[j]]
                still = F.lit(True)
                for p in picked:
                    still = still & ~p.isin(clash)
                left[i] = F.when(still, F.col(names[i]))
            # one expression a round, as every projection copies the row; equal keys go by their ties
            ranked = [F.when(left[i].isNotNull(), F.struct(left[i].alias("key"), F.lit(r), F.lit(i).alias("i"))) for r, i in enumerate(members)]
            work = work.withColumn(f"__pick_{k}", F.least(*ranked)["i"])
            picked.append(F.col(f"__pick_{k}"))
        kept = {}
        for i in members:
            mine = F.lit(False)
            for p in picked:
                mine = mine | F.coalesce(p == i, F.lit(False))
            kept[names[i]] = F.when(mine, F.col(names[i]))
        work = work.withColumns(kept).drop(*[f"__pick_{k}" for k in range(rounds)])
    return work


def mark_swapped(listed: DataFrame, spec: TableSpec, share: Share | int, scope: Scope) -> DataFrame:
    """Exchange the cells of the drawn swaps; ``listed`` comes from :func:`with_swaps`."""
    return fire_swaps(listed, spec, scope.cut(swap_keys(listed, spec, scope.groups), share, EXPONENTIAL))


def swap_keys(listed: DataFrame, spec: TableSpec, groups: Sequence[str] = ()) -> DataFrame:
    """Long form (groups, key, tie) of the possible swaps."""
    return candidates(listed, {f"{a}~{b}": F.col(n) for n, (a, b, _) in zip(swap_columns(spec), _swap_options(spec))}, groups)


def fire_swaps(listed: DataFrame, spec: TableSpec, cut: Cut | GroupedCut) -> DataFrame:
    """Exchange the cells of the swaps that a boundary selects."""
    names, partners, fired = swap_columns(spec), {}, {}
    for i, (a, b, _) in enumerate(_swap_options(spec)):
        fired[f"__fired_{i}"] = cut.keeps(F.col(names[i]), F.concat(F.col("__row"), F.lit(f":{a}~{b}")))
        partners.setdefault(a, []).append((i, b))
        partners.setdefault(b, []).append((i, a))
    marked = cut.detach(cut.attach(listed).withColumns(fired))
    changed: dict[str, Column] = {}
    for c, mates in partners.items():
        value, hit = F.col(c), F.lit(False)
        for i, m in mates:
            value = F.when(F.col(f"__fired_{i}"), F.col(m)).otherwise(value)
            hit = hit | F.col(f"__fired_{i}")
        changed[c] = value
        changed[f"__dim_{c}"] = F.when(hit, F.lit("coherence")).otherwise(F.col(f"__dim_{c}"))
    return marked.withColumns(changed).drop(*names, *fired)


def coherence(df: DataFrame, spec: TableSpec, density: float, seed: int | Column = 42, groups: Sequence[str] = ()) -> Degraded:
    """Exchange values between related columns of a row until the budget is used.

    Each cell moves at most once and always into a column with a compatible range; the
    reachable share is limited by the rules.
    """
    check_density(density)
    if density == 0.0:
        return nothing_touched(df)
    listed = staged(with_swaps(open_cells(df, spec), spec, seed).select(*df.columns, "__row", *swap_columns(spec)))
    listed = untouched(listed, spec)
    share = Share(density, len(spec.numeric), pairs=True)
    return close_cells(mark_swapped(listed, spec, share, scope_of(listed, groups)), spec, df.columns)


# ------------------------------------------------------------------ uniqueness


def follow_donors(pairs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Add ``__end`` to (target ``__row``, ``__donor``, ``key``): the record whose values a target gets.

    Targets are overwritten in the order of their keys. A donor that is a target with a smaller
    key holds what it got itself, so the chain goes on from there; otherwise it still holds its
    own values. Every round lets each open target jump as far as the one it points to does, so
    the rounds are the logarithm of the longest chain.
    """
    g = list(groups)
    base = pairs.select(*g, "__row", "__donor", "key")
    met = base.select(*g, F.col("__row").alias("__donor"), F.col("key").alias("__when"))
    earlier = (F.col("__when") < F.col("key")) | ((F.col("__when") == F.col("key")) & (F.col("__donor") < F.col("__row")))
    at = base.join(met, [*g, "__donor"], "left").select(
        *g, "__row", F.col("__donor").alias("__end"), F.coalesce(earlier, F.lit(False)).alias("__open")
    )
    at = staged(at)
    while not at.filter("__open").isEmpty():
        ahead = at.select(*g, F.col("__row").alias("__end"), F.col("__end").alias("__to"), F.col("__open").alias("__on"))
        moved = at.filter("__open").join(ahead, [*g, "__end"]).select(*g, "__row", F.col("__to").alias("__end"), F.col("__on").alias("__open"))
        at = staged(at.filter("not __open").unionByName(moved))
    return pairs.join(at.drop("__open"), [*g, "__row"])


def copy_key(seed: int | Column) -> Column:
    """The key by which a row is drawn as the target of a copy."""
    return unit(wide_bits(digest(seed, F.col("__row"), "copy")))


def draw_copies(work: DataFrame, spec: TableSpec, share: Share | int, seed: int | Column, groups: Sequence[str] = ()) -> DataFrame:
    """Pairs (groups, target ``__row``, ``__donor``, ``key``, ``__end``, ``n_changed``) whose changed
    cells use up the budget, with the values ``__d_c`` that the target gets.

    Every row is a possible target with one drawn donor: one time in three from the
    records at or above the donor column's quantile, else from all records. Donors are
    found by their number in a hash order, numbered without their values. A donor that was
    overwritten earlier hands on what it then holds (:func:`follow_donors`). A row that would not
    change is no target. Rows that share an id are drawn once and overwritten together.

    What a target gets depends on targets with smaller keys only, so first just the rows are paired
    that the budget will hardly exceed; should their changes not use it up, more rows are.
    """
    preds, g = spec.predictors, list(groups)
    pooled = spec.donor_column is not None
    value = F.col(spec.donor_column).alias("__value") if pooled else F.lit(None).cast("double").alias("__value")
    # a seed that is a column lies in the table; it is the same for all rows of a group
    seeded = [seed.alias("__seed")] if isinstance(seed, Column) else []
    own = F.col("__seed") if seeded else seed
    rows = work.select(*g, "__row", value, *seeded).dropDuplicates([*g, "__row"])
    rows = staged(rows.withColumn("__bits", wide_bits(digest(own, F.col("__row"), "donor-order"))))
    if g:
        edges = grouped_quantiles(rows, g, "__value", {"__edge": spec.donor_quantile}) if pooled else None
        marked = rows.join(edges, g) if pooled else rows.withColumn("__edge", F.lit(None).cast("double"))
    else:
        edge = column_quantiles(rows, ["__value"], [spec.donor_quantile])["__value"][0] if pooled else None
        marked = rows.withColumn("__edge", F.lit(edge).cast("double"))
    is_upper = F.col("__value") >= F.col("__edge")
    marked = marked.withColumn("__upper", F.coalesce(is_upper, F.lit(False)))
    sizes = marked.groupBy(*g).agg(F.count(F.lit(1)).alias("n_rows"), F.nullif(F.count_if("__upper"), F.lit(0)).alias("__n_upper"))
    donors = marked.select(
        *g,
        F.explode(F.when(F.col("__upper"), F.array(F.lit("all"), F.lit("upper"))).otherwise(F.array(F.lit("all")))).alias("__pool"),
        "__bits",
        F.col("__row").alias("__donor"),
    )
    numbered = number_rows(donors, [*g, "__pool"], "__bits", "__donor").drop("__bits")
    if g:
        sizes = staged(sizes)
        scope, sized = Scope(None, tuple(g), sizes.drop("__n_upper")), rows.join(sizes, g)
        part = share.density
    else:
        counts = sizes.first()
        n_rows = counts["n_rows"] if counts else 0
        scope = Scope(n_rows)
        sized = rows.withColumns({"n_rows": F.lit(n_rows or 1), "__n_upper": F.lit(counts["__n_upper"] if counts else None).cast("long")})
        part = share.density if isinstance(share, Share) else share / max(1, n_rows * len(preds))
    drawn = digest(own, F.col("__row"), "copy")
    from_upper = (unit(wide_bits(drawn, 1)) < F.lit(1.0 / 3.0)) & F.col("__n_upper").isNotNull()
    size = F.when(from_upper, F.col("__n_upper")).otherwise(F.col("n_rows"))
    reach = min(1.0, COPY_SLACK * part)
    while True:
        targets = sized.filter(copy_key(own) <= F.lit(reach)).select(
            *g,
            "__row",
            copy_key(own).alias("key"),
            F.when(from_upper, F.lit("upper")).otherwise(F.lit("all")).alias("__pool"),
            F.pmod(wide_bits(digest(own, F.col("__row"), "donor")), size).alias("ordinal"),
        )
        paired = targets.join(numbered, [*g, "__pool", "ordinal"]).filter(F.col("__row") != F.col("__donor"))
        paired = follow_donors(staged(paired.select(*g, "__row", "__donor", "key")), g)
        got = work.select(*g, F.col("__row").alias("__end"), *[F.col(c).alias(f"__d_{c}") for c in preds])
        mine = work.filter(copy_key(seed) <= F.lit(reach)).select(*g, "__row", *[F.col(c).alias(f"__o_{c}") for c in preds])
        n_changed = sum(F.when(F.col(f"__o_{c}").eqNullSafe(F.col(f"__d_{c}")), 0).otherwise(1) for c in preds)
        weighed = paired.join(got, [*g, "__end"]).join(mine, [*g, "__row"]).dropDuplicates([*g, "__row"])
        weighed = weighed.withColumn("n_changed", n_changed.cast("long")).filter("n_changed > 0")
        pairs = staged(weighed.select(*g, "__row", "__donor", "key", "__end", "n_changed", *[f"__d_{c}" for c in preds]))
        ranked = pairs.select(*g, "key", F.col("__row").alias("tie"), F.col("n_changed").alias("amount"))
        cut = scope.cut(ranked, share)
        # a group without pairs has no boundary
        enough = cut.table.filter("not __edge_all").count() == sizes.count() if g else not cut.everything
        if enough or reach == 1.0:
            return cut.detach(cut.attach(pairs).filter(cut.keeps(F.col("key"), F.col("__row"))))
        reach = min(1.0, 2 * reach)


def apply_copies(work: DataFrame, spec: TableSpec, pairs: DataFrame, seed: int | Column, groups: Sequence[str] = ()) -> DataFrame:
    """Overwrite each target's predictors with those of the record at the end of its donor chain, which
    are in ``pairs``. Only rows with a key as small as that of a target are joined."""
    preds, g = spec.predictors, list(groups)
    reach = pairs.agg(F.max("key")).first()[0]
    if reach is None:
        return work
    types = dict(work.dtypes)
    near = copy_key(seed) <= F.lit(reach)
    fetched = pairs.select(*g, "__row", F.col("__donor").alias("__from"), *[f"__d_{c}" for c in preds])
    joined = work.filter(near).join(fetched, [*g, "__row"], "left")
    hit = F.col("__from").isNotNull()
    changed = {c: F.when(hit, F.col(f"__d_{c}").cast(types[c])).otherwise(F.col(c)) for c in preds}
    for c in preds:
        changed[f"__cpy_{c}"] = hit & ~F.col(f"__was_{c}").cast("string").eqNullSafe(
            F.col(f"__d_{c}").cast("string")
        )
    changed["__donor"] = F.col("__from")
    copied = joined.withColumns(changed).drop("__from", *[f"__d_{c}" for c in preds])
    return copied.unionByName(work.filter(~near))


def uniqueness(df: DataFrame, spec: TableSpec, density: float, seed: int | Column = 42, groups: Sequence[str] = ()) -> Degraded:
    """Overwrite records, in the order of their keys, with copies of other records as these then
    stand, until the budget of changed cells."""
    check_density(density)
    if density == 0.0:
        return nothing_touched(df)
    work = untouched(staged(base_cells(df, spec)), spec)
    share = Share(density, len(spec.predictors))
    pairs = staged_alone(df.sparkSession, lambda: draw_copies(work, spec, share, seed, groups))
    return close_cells(apply_copies(work, spec, pairs, seed, groups), spec, df.columns)


OPERATORS: dict[str, DegradationOp] = {
    "completeness": completeness,
    "coherence": coherence,
    "validity": validity,
    "precision": precision,
    "uniqueness": uniqueness,
}
# realised rate is only approximately the requested one, or cells stop parsing
APPROXIMATE_RATE = {"coherence", "validity", "uniqueness"}
INTRODUCES_INVALID = {"validity"}
