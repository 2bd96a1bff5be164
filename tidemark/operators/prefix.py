"""Running totals over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prior_totals(df: DataFrame, order: str, block: Column, keys: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """keys, order and prior_<name>: totals of additive aggregates over all rows (of the keys) with a strictly smaller order value.

    One row for each (keys, order). block is a coarse, monotone function of order: totals by block are summed up in one
    small window, those within a block in a window for each block.
    """
    keys = list(keys)
    rows = df.groupBy(*keys, order).agg(*(c.alias(n) for n, c in sums.items())).withColumn("__block", block)
    blocks = rows.groupBy(*keys, "__block").agg(*(F.sum(n).alias(f"__{n}") for n in sums))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(*keys, "__block", *(F.sum(f"__{n}").over(before).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    total = lambda n: F.coalesce(F.sum(n).over(inside), zero) + F.coalesce(F.col(f"__{n}"), zero)
    return rows.join(base, [*keys, "__block"]).select(*keys, order, *(total(n).alias(f"prior_{n}") for n in sums))


def numbered(df: DataFrame, order: list[Column], block: Column, name: str = "row") -> DataFrame:
    """df with a row number from 0 by order; block is a coarse function of the order's first column, monotone in it."""
    dealt = df.withColumn("__block", block)
    sizes = dealt.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    named = base.select(F.col("__block").alias("__of"), "__base")
    joined = dealt.join(named, F.col("__block").eqNullSafe(F.col("__of"))).drop("__of")
    return joined.withColumn(name, F.col("__base") + F.row_number().over(Window.partitionBy("__block").orderBy(*order)) - 1).drop("__block", "__base")
