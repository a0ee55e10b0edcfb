"""Seeded, order-free uniforms.

Every random choice is a pure function of (seed, row id, purpose), so the same draw
comes back whatever the partitioning, on a retried task, or on a second scan of the
table. ``spark.tarnish.hash`` picks the hash behind it: ``md5`` (default) can be
reproduced by any SQL engine, ``xxhash64`` costs about a tenth and suits large runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPAN = 1 << 48
HASH_SETTING = "spark.tarnish.hash"


@dataclass(frozen=True)
class Digest:
    """Hash of a seed and some parts: two 48-bit integers and one of 32 bits."""

    parts: tuple[Column, ...]
    portable: bool

    def wide(self, slot: int) -> Column:
        if not self.portable:
            return F.shiftrightunsigned(F.xxhash64(*self.parts, F.lit(slot)), 16)
        hexed = F.md5(F.concat_ws(":", *self.parts))
        return F.conv(F.substring(hexed, 1 + 12 * slot, 12), 16, 10).cast("long")

    def small(self) -> Column:
        if not self.portable:
            return F.shiftrightunsigned(F.xxhash64(*self.parts, F.lit(2)), 32)
        hexed = F.md5(F.concat_ws(":", *self.parts))
        return F.conv(F.substring(hexed, 25, 8), 16, 10).cast("long")


def digest(seed: int | Column, *parts: Column | str) -> Digest:
    """Hash of the seed and the parts; plain strings are taken as literals. A column as
    seed gives every row (every replicate, say) a seed of its own."""
    name = SparkSession.active().conf.get(HASH_SETTING, "md5")
    if name not in ("md5", "xxhash64"):
        raise ValueError(f"{HASH_SETTING} must be md5 or xxhash64, not {name}")
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(int(seed)))
    return Digest((first, *cols), name == "md5")


def wide_bits(d: Digest, slot: int = 0) -> Column:
    """48-bit integer from slot 0 or 1 of a digest."""
    return d.wide(slot)


def small_bits(d: Digest) -> Column:
    """32-bit integer, independent of both wide slots."""
    return d.small()


def unit(bits: Column) -> Column:
    """A 48-bit integer as a double strictly inside (0, 1)."""
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(SPAN))


def pick(bits: Column, values: list[str]) -> Column:
    """One of ``values`` with equal probability."""
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (F.pmod(bits, F.lit(len(values))) + 1).cast("int"))


def gaussian(u1: Column, u2: Column) -> Column:
    """Standard normal deviate from two uniforms (Box-Muller).

    The magnitude is kept at 1e-6 or more, so scaled noise never rounds away to
    nothing when it is added to the value it disturbs.
    """
    turn = F.cos(F.lit(2.0 * math.pi) * u2)
    size = F.greatest(F.abs(F.sqrt(F.lit(-2.0) * F.ln(u1)) * turn), F.lit(1e-6))
    # the root is positive, so the cosine has the sign; one factor, so that no uniform is hashed twice for the size
    return size * F.when(turn < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def exponential_rank(u: Column, weight: Column, lightest: float = 1.0) -> Column:
    """Sort key of a weighted draw without replacement, scaled into (0, 1).

    Rows with the ``k`` smallest ``-ln(u)/weight`` are a weighted sample of size k
    (Efraimidis and Spirakis). ``lightest`` is a lower bound of the weights; with 49-bit
    uniforms -ln(u) stays below 64.
    """
    return -F.ln(u) / weight * F.lit(lightest / 64.0)
