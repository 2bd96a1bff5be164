"""Nearest rows by Euclidean distance: a stated query set against all rows, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_AT_ONCE, QUERIES_AT_ONCE = 8192, 1024


def nearest(df: DataFrame, row: str, vector: str, asks: Column, k: int) -> DataFrame:
    """query, row, d: for every row that asks, its k nearest others; ties (to nine digits) go to the smaller row.

    Vectors are of one length and without nulls. Each block of queries meets each block of rows once, as two matrices, and
    only its k best of them leave the task.
    """
    rows = df.select(F.col(row).cast("long").alias("row"), F.transform(vector, lambda x: x.cast("double")).alias("v"), asks.alias("asks"))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, groups = -(-n // ROWS_AT_ONCE) or 1, -(-n_queries // QUERIES_AT_ONCE) or 1
    dealt = lambda salt, of, name: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(of)).alias(name)
    every = lambda of, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long"))).alias(name)
    left = rows.where("asks").select("row", "v", dealt(1, groups, "g"), every(blocks, "b"))
    right = rows.select(F.col("row").alias("other"), F.col("v").alias("w"), dealt(0, blocks, "to_b"), every(groups, "to_g"))

    def best(queries: pa.Table, others: pa.Table) -> pa.Table:
        read = lambda t, row, v: (t.column(row).to_numpy(), t.column(v).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
        parts: list[tuple] = []
        if queries.num_rows and others.num_rows:
            (asking, q), (known, x) = read(queries, "row", "v"), read(others, "other", "w")
            for i in range(len(asking)):
                d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                near = np.round(d, 9)
                near[known == asking[i]] = np.inf
                some = np.flatnonzero(near <= np.partition(near, min(k, len(near)) - 1)[min(k, len(near)) - 1])
                some = some[np.lexsort((known[some], near[some]))][:k]
                some = some[np.isfinite(near[some])]
                parts.append((np.full(len(some), asking[i]), known[some], d[some]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[], [], []]
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query", "row", "d"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    found = left.groupBy("g", "b").cogroup(right.groupBy("to_g", "to_b")).applyInArrow(best, "query long, row long, d double")
    ranked = found.withColumn("__rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("d", 9), "row")))
    return ranked.where(F.col("__rank") <= k).drop("__rank")
