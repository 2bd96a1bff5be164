"""Rows that share most facts: against all pairs, and on facts that nearly all rows share."""

import math
import random
from collections import Counter
from threading import Timer

import pytest

from tidemark.operators.evidence import overlap_scores

COLUMNS = ["a", "b", "c"]


def plain(queries, rows, k):
    facts = {r[0]: {(c, x) for c, x in zip(COLUMNS, r[1:], strict=True) if x is not None} for r in rows}
    df = Counter(f for x in facts.values() for f in x)
    out = set()
    for q in queries:
        mine = {(c, x) for c, x in zip(COLUMNS, q[1:], strict=True) if x is not None}
        scores = [(-round(sum(math.log1p(len(rows) / df[f]) for f in mine & x), 9), row) for row, x in facts.items() if row != q[0] and mine & x]
        out |= {(q[0], row, rank) for rank, (_, row) in enumerate(sorted(scores)[:k], 1)}
    return out


def ended(spark, df, seconds):
    """df's rows; its jobs are cancelled after so many seconds."""
    spark.sparkContext.setJobGroup("ended", "", True)
    timer = Timer(seconds, lambda: spark.sparkContext.cancelJobGroup("ended"))
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("k", [1, 3])
def test_same_as_all_pairs(spark, k):
    deal = random.Random(5)
    rows = [(i, deal.choice(["x", "x", "y", "", None]), deal.choice([1, 1, 2, 3, 4, None]), deal.choice(["p", "q", "=", None])) for i in range(120)]
    queries = [r for r in rows if r[0] % 4 == 0] + [(1000, "x", 9, "p"), (1001, None, None, None), (1002, "z", 9, "z")]
    frame = lambda x: spark.createDataFrame(x, "id long, a string, b int, c string")
    got = {(r["query"], r["row"], r["rank"]) for r in overlap_scores(frame(queries), frame(rows), COLUMNS, k).collect()}
    assert got == plain(queries, rows, k)


def test_levels_that_all_rows_share(spark):
    rows = spark.range(200_000).selectExpr("id", "'x' AS a", "id % 2 AS b", "id % 6 AS c")
    got = ended(spark, overlap_scores(rows.where("id % 10 = 0"), rows, COLUMNS, 2), 60)
    assert len(got) == 40_000
    assert {(r["row"], r["rank"]) for r in got if r["query"] == 6000} == {(0, 1), (6, 2)}
