"""Special functions that Spark lacks, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lgamma(x: Column) -> Column:
    """Natural log of the gamma function for x > 0, to about 1e-11: Stirling's series eight up, less the steps between."""
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.ln(x + float(k))
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def bernoulli_bits(positive: Column, negative: Column) -> Column:
    """Bits to code outcomes under the Jeffreys mixture: -log2 of B(p + 1/2, n + 1/2) / B(1/2, 1/2)."""
    nats = lgamma(positive + 0.5) + lgamma(negative + 0.5) - lgamma(positive + negative + 1.0) - math.log(math.pi)
    return -nats / math.log(2)
