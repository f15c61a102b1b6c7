"""Normal tail probability as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun, formula 26.2.17.
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z), absolute error below 7.5e-8."""
    size = F.abs(z)
    t = 1.0 / (1.0 + AS_P * size)
    poly = F.lit(0.0)
    for b in reversed(AS_B):
        poly = (poly + b) * t
    tail = F.exp(-size * size / 2.0) / math.sqrt(2.0 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)
