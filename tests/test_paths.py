"""Path counts: against plain walks, and past nodes that lead nowhere."""

import random
from collections import Counter

import pytest

from tidemark.operators import graph


def plain(triples, pairs, longest):
    out = Counter()
    for head, tail in pairs:
        now = Counter({(head, ()): 1})
        for _ in range(longest):
            step = Counter()
            for (node, chain), n in now.items():
                for rel, a, b in triples:
                    if a == node:
                        step[b, (*chain, rel)] += n
            now = step
            for (node, chain), n in now.items():
                if node == tail:
                    out[graph.name(chain)] += n
    return out


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_same_as_plain_walks(spark, longest):
    deal = random.Random(3)
    triples = sorted({(deal.choice("rst"), deal.choice("abcdefg"), deal.choice("abcdefg")) for _ in range(16)})
    pairs = [("a", "b"), ("b", "b"), ("c", "f"), ("g", "none")]
    got = graph.path_counts(spark.createDataFrame(triples, "rel string, head string, tail string"), spark.createDataFrame(pairs, "head string, tail string"), longest)
    assert {r["chain"]: r["paths"] for r in got.collect()} == plain(triples, pairs, longest)


def test_steps_that_lead_nowhere_are_not_written(spark, monkeypatch):
    many = spark.range(5000).selectExpr("'has' AS rel", "'hub' AS head", "concat('x', id) AS tail")
    triples = many.unionByName(spark.createDataFrame([("at", "a", "hub"), ("in", "hub", "z")], "rel string, head string, tail string"))
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = graph.path_counts(triples, spark.createDataFrame([("a", "z")], "head string, tail string"), 2)
    assert [tuple(r) for r in got.collect()] == [("at→in", 1)]
    assert sum(df.count() for df in written) < 10
