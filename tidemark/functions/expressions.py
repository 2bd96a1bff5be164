"""Column expressions: safe arithmetic, calendar cycles, probability and confidence formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value as double, null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or either is null or the result is not finite."""
    return F.coalesce(finite(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softmax(scores: list[Column]) -> list[Column]:
    """Probabilities of a row's scores, shifted by the largest."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    shifted = [F.exp(s - top) for s in scores]
    total = sum(shifted[1:], shifted[0])
    return [x / total for x in shifted]


def cycle(position: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of position on a circle of the given period."""
    angle = position * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def day_hour(ts: Column) -> Column:
    """Hour of the day with its fraction."""
    return F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0 + F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)) / 3_600_000_000.0


def calendar(ts: Column) -> dict[str, Column]:
    """Annual, weekly and daily sine and cosine of a timestamp."""
    hour = day_hour(ts)
    out: dict[str, Column] = {}
    for name, position, period in (("annual", F.dayofyear(ts) - 1 + hour / 24.0, 365.2425), ("weekly", F.weekday(ts) + hour / 24.0, 7.0), ("daily", hour, 24.0)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(position, period)
    return out


def wilson_lower(hits: Column, n: Column, z: float = 1.64) -> Column:
    """Lower bound of a proportion; 0 for n = 0."""
    p = hits / F.when(n > 0, n)
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.coalesce(F.greatest(low, F.lit(0.0)), F.lit(0.0))


def hoeffding(n: Column, delta: float) -> Column:
    """Two-sided slack of a mean of n values in [0, 1] at confidence 1 - delta."""
    return F.sqrt(F.lit(math.log(2 / delta)) / (2 * n))


def prior_shift(p: list[Column], train: list[float], deploy: list[float], strength: float = 1.0, eps: float = 1e-12) -> list[Column]:
    """Class probabilities p * (deploy / train) ** strength, renormalized."""
    weighted = [c * (max(d, eps) / max(t, eps)) ** strength for c, t, d in zip(p, train, deploy, strict=True)]
    total = sum(weighted[1:], weighted[0])
    return [w / total for w in weighted]


def test_posterior(prior: Column, sensitivity: Column, specificity: Column, positive: Column) -> Column:
    """Probability of the condition after one test result."""
    if_true = F.when(positive, sensitivity).otherwise(1 - sensitivity)
    if_false = F.when(positive, 1 - specificity).otherwise(specificity)
    return prior * if_true / (prior * if_true + (1 - prior) * if_false)


def fair_strike(reward: Column, penalty: Column, abstain: Column) -> Column:
    """The confidence from which answering pays: clip((penalty - abstain) / (reward + penalty), 0, 1)."""
    return clip((penalty - abstain) / (reward + penalty), 0.0, 1.0)


def expected_value(p: Column, reward: Column, penalty: Column, abstain: Column) -> Column:
    """p * reward - (1 - p) * penalty where answering, -abstain else."""
    return F.when(p >= fair_strike(reward, penalty, abstain), p * reward - (1 - p) * penalty).otherwise(-abstain)


def normalized_name(c: Column) -> Column:
    """Lower case, other characters than letters and digits as one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def bin_left(x: Column, edges: list[float]) -> Column:
    """Number of edges < x, so that bin <= k exactly if x <= edges[k]."""
    return sum((F.when(x > e, 1).otherwise(0) for e in edges[1:]), F.when(x > edges[0], 1).otherwise(0)) if edges else F.lit(0)


def bin_right(x: Column, cuts: list[float]) -> Column:
    """Number of cuts <= x."""
    return sum((F.when(x >= c, 1).otherwise(0) for c in cuts[1:]), F.when(x >= cuts[0], 1).otherwise(0)) if cuts else F.lit(0)


def huber_gradient(residual: Column, limit: Column) -> Column:
    """The residual clipped to +-limit."""
    return F.least(F.greatest(residual, -limit), limit)
