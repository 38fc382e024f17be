"""Two-sided normal tail as a column expression, for one-row test results.

Spark has no erf; the two classical expansions need only ``exp`` and a short fold, so no Python worker is started.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 80
_SWITCH = 2.5


def two_sided_p(z: Column) -> Column:
    """P(|N(0,1)| >= |z|), at most 1; pass z < 0 through unchanged to get a clipped 1 from a continuity-corrected score."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    down = F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1))
    square = x * x
    power_series = F.aggregate(down, F.lit(1.0), lambda acc, k: acc * (square * 2.0) / (k * 2.0 + 1.0) + 1.0)
    below = 1.0 - F.exp(-square) * x * power_series * F.lit(2.0 / math.sqrt(math.pi))
    continued = F.aggregate(down, x, lambda acc, k: x + (k / 2.0) / acc)
    above = F.exp(-square) / continued / F.lit(math.sqrt(math.pi))
    return F.when(x < _SWITCH, below).when(x >= _SWITCH, above)
