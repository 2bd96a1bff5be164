"""Exact quantiles of whole columns without gathering their values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import bin_right
from tidemark.operators.prefix import prior_totals

#: Blocks that running counts are dealt out to; their bounds come from an approximate sketch, the result does not.
BLOCKS = 64


def at_ranks(df: DataFrame, column: str, ranks: list[int] | None = None, shares: list[float] | None = None) -> tuple[int, list]:
    """(n, values at 0-based ranks of the sorted non-null values); shares p stand for the ranks floor and ceil of p (n - 1).

    NaN is left out. Values past either end are those of the end; without values all are None.
    """
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    if dict(values.dtypes)["v"] in ("double", "float"):
        values = values.where(~F.isnan("v"))
    sketch = values.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [(k + 1) / BLOCKS for k in range(BLOCKS - 1)], 1000).alias("cuts")).first()
    n = sketch["n"]
    wanted = list(ranks or [])
    for p in shares or []:
        low = int(p * (n - 1) + 1e-12)
        wanted += [low, low + 1]
    if not n:
        return 0, [None] * len(wanted)
    counts = prior_totals(values, "v", bin_right(F.col("v"), sorted(set(sketch["cuts"]))), n=F.count(F.lit(1)))
    found = counts.agg(*(F.max(F.when(F.col("prior_n") <= min(max(r, 0), n - 1), F.col("v"))).alias(f"r{k}") for k, r in enumerate(wanted))).first()
    return n, [found[f"r{k}"] for k in range(len(wanted))]


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles of the non-null values; None without any."""
    n, found = at_ranks(df, column, shares=shares)
    out: list[float | None] = []
    for k, p in enumerate(shares):
        low, high = found[2 * k], found[2 * k + 1]
        place = p * (n - 1)
        out.append(None if low is None else float(low) + (float(high) - float(low)) * (place - int(place + 1e-12)))
    return out
