"""Normal tail probability as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 0.5
TERMS = 13


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0.

    Trapezoidal rule on the integral form of erfc with the residue of its pole at x
    added back; the step makes the truncation error smaller than a double can hold.
    Close to zero the pole term cancels badly, so a short Taylor series takes over.
    """
    x2 = x * x
    total = F.lit(0.5) / x2
    for n in range(1, TERMS + 1):
        nh2 = (n * STEP) ** 2
        total = total + F.lit(math.exp(-nh2)) / (F.lit(nh2) + x2)
    body = F.lit(2.0 * STEP / math.pi) * x * F.exp(-x2) * total
    # exp() of a large argument would overflow: the pole only matters below pi/step
    pole = F.lit(2.0) / (F.lit(1.0) - F.exp(F.least(x, F.lit(7.0)) * F.lit(2.0 * math.pi / STEP)))
    series = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * (x - x * x2 / 3.0 + x * x2 * x2 / 10.0)
    return (
        F.when(x < 1e-3, series)
        .when(x < math.pi / STEP, body + pole)
        .otherwise(body)
    )


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))
