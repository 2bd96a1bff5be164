"""Queries of predicates, interval algebra, trees and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import predicates as P
from tidemark.plans.registry import load, query

_BITS_SQL = "b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_quantity > 25)::INT AS b0, (l_discount > 0.05)::INT AS b1, (l_returnflag = 'R')::INT AS b2, (l_linestatus = 'O')::INT AS b3, l_quantity AS q, l_extendedprice AS p FROM lineitem)"
_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

PROGRAMS = {
    "state": P.Predicate("state", ("b0", "b1"), 2),
    "any": P.Predicate("or", ("b0", "b1")),
    "odd": P.Predicate("xor", ("b0", "b1")),
    "two": P.Predicate("count", ("b0", "b1", "b2", "b3"), 2),
    "both": P.Predicate("and", branches=((("b0", 1), ("b2", 0)),)),
    "dnf": P.Predicate("dnf", branches=((("b0", 1), ("b1", 1)), (("b2", 1), ("b3", 0)))),
    "but": P.Predicate("exception", branches=((("b0", 1),), (("b1", 1), ("b2", 1)), (("b3", 1),))),
    "low": P.Predicate("threshold_and", branches=((("q", "<=", 20.0), ("p", ">", 10000.0)),)),
    "far": P.Predicate("threshold_or", branches=((("q", ">", 45.0), ("p", "<=", 2000.0)),)),
    "mid": P.Predicate("interval", branches=((("q", 10.0, 30.0),),)),
    "gap": P.Predicate("union", branches=((("q", None, 5.0),), (("q", 40.0, 45.0), ("p", 20000.0, None)))),
}


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    return load(spark, sf_dir, "lineitem").select(*_KEYS, flag(F.col("l_quantity") > 25).alias("b0"), flag(F.col("l_discount") > 0.05).alias("b1"), flag(F.col("l_returnflag") == "R").alias("b2"), flag(F.col("l_linestatus") == "O").alias("b3"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))


@query(f"""WITH {_BITS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (b0 = 1 AND b1 = 0)::INT AS state, (b0 = 1 OR b1 = 1)::INT AS any, (b0 <> b1)::INT AS odd, (b0 + b1 + b2 + b3 = 2)::INT AS two, (b0 = 1 AND b2 = 0)::INT AS both,
((b0 = 1 AND b1 = 1) OR (b2 = 1 AND b3 = 0))::INT AS dnf, (b0 = 1 AND NOT ((b1 = 1 AND b2 = 1) OR b3 = 1))::INT AS but, (q <= 20 AND p > 10000)::INT AS low, (q > 45 OR p <= 2000)::INT AS far, (q > 10 AND q <= 30)::INT AS mid, (q <= 5 OR (q > 40 AND q <= 45 AND p > 20000))::INT AS gap FROM b""")
def predicate_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF14-PF25: every kind of predicate from its frozen program."""
    return P.append(_bits(spark, sf_dir), PROGRAMS).select(*_KEYS, *PROGRAMS)


@query("""
WITH i AS (SELECT o_custkey, floor(o_totalprice / 20000) AS low, floor(o_totalprice / 20000) + 1 + o_orderkey % 2 AS high FROM orders),
s AS (SELECT *, max(high) OVER (PARTITION BY o_custkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR low > before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT o_custkey, min(low) AS low, max(high) AS high FROM g GROUP BY o_custkey, island""")
def interval_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF26, PF27: canonical unions of half-open intervals."""
    at = F.floor(F.col("o_totalprice") / 20000).cast("double")
    i = load(spark, sf_dir, "orders").select("o_custkey", at.alias("low"), (at + 1 + F.col("o_orderkey") % 2).alias("high"))
    return P.merged_intervals(i, ["o_custkey"], "low", "high")


@query("""
WITH l AS (SELECT l_suppkey AS region, 'f' || (l_linenumber % 3) AS feature, CASE WHEN l_orderkey % 2 = 0 THEN l_quantity / 10 END AS lo, CASE WHEN l_orderkey % 2 = 1 THEN 2.0 + l_suppkey % 7 + l_quantity / 10 END AS hi FROM lineitem),
c AS (SELECT region, feature, max(lo) AS lo, min(hi) AS hi FROM l GROUP BY ALL) SELECT region, feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM c WHERE region NOT IN (SELECT region FROM c WHERE lo >= hi)""")
def region_conjunction_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF29: repeated literals of a region collapsed, empty regions gone."""
    line = load(spark, sf_dir, "lineitem")
    odd = F.col("l_orderkey") % 2 == 1
    l = line.select(F.col("l_suppkey").alias("region"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("feature"), F.when(~odd, F.col("l_quantity") / 10).alias("lo"), F.when(odd, 2.0 + F.col("l_suppkey") % 7 + F.col("l_quantity") / 10).alias("hi"))  # noqa: E741
    return P.conjunctions(l, ["region"]).select("region", "feature", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""
WITH a AS (SELECT p_brand, list_sort(list_distinct(list(p_type))) AS x, list_sort(list_distinct(list(p_type) FILTER (p_size > 45))) AS y FROM part GROUP BY p_brand)
SELECT p_brand, array_to_string(list_sort(list_intersect(x, coalesce(y, []))), '|') AS both, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(coalesce(y, []), v))), '|') AS rest, CASE WHEN len(coalesce(y, [])) * 2 <= len(x) THEN 'in' ELSE 'not in' END AS literal FROM a""")
def category_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF28: set operations on category levels and the shorter literal."""
    a = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("x"), F.sort_array(F.collect_set(F.when(F.col("p_size") > 45, F.col("p_type")))).alias("y"))
    return a.select("p_brand", F.array_join(F.sort_array(F.array_intersect("x", "y")), "|").alias("both"), F.array_join(F.sort_array(F.array_except("x", "y")), "|").alias("rest"), F.when(F.size("y") * 2 <= F.size("x"), "in").otherwise("not in").alias("literal"))


TREES = [
    ("node", "q", 25.0, ("node", "p", 20000.0, ("leaf", -1.0), ("leaf", 0.5)), ("leaf", 1.0)),
    ("node", "p", 35000.0, ("node", "q", 10.0, ("leaf", 0.25), ("leaf", -0.5)), ("node", "q", 40.0, ("leaf", 0.75), ("leaf", 2.0))),
    ("node", "q", 45.0, ("leaf", 0.0), ("leaf", -0.25)),
]
_BASE, _RATE = 0.1, 0.3
_T = ["CASE WHEN q <= 25 THEN CASE WHEN p <= 20000 THEN -1.0 ELSE 0.5 END ELSE 1.0 END", "CASE WHEN p <= 35000 THEN CASE WHEN q <= 10 THEN 0.25 ELSE -0.5 END ELSE CASE WHEN q <= 40 THEN 0.75 ELSE 2.0 END END", "CASE WHEN q <= 45 THEN 0.0 ELSE -0.25 END"]
_SCORE = f"0.1::DOUBLE + 0.3::DOUBLE * ({' + '.join(_T)})"
_QP_SQL = "t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS q, l_extendedprice AS p FROM lineitem)"


def _qp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(*_KEYS, F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))


@query(f"WITH {_QP_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round({_SCORE}, 6) AS score FROM t")
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML10: the additive score of several trees as one projection."""
    return _qp(spark, sf_dir).select(*_KEYS, F.round(P.additive_score(TREES, _BASE, _RATE), 6).alias("score"))


@query(f"WITH {_QP_SQL} SELECT 0 AS tree, CASE WHEN q <= 25 THEN CASE WHEN p <= 20000 THEN 0 ELSE 1 END ELSE 2 END AS leaf, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 1, CASE WHEN p <= 35000 THEN CASE WHEN q <= 10 THEN 0 ELSE 1 END ELSE CASE WHEN q <= 40 THEN 2 ELSE 3 END END, count(*) FROM t GROUP BY ALL UNION ALL SELECT 2, CASE WHEN q <= 45 THEN 0 ELSE 1 END, count(*) FROM t GROUP BY ALL")
def leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, JN15, ML37, ML38: rows of each tree leaf by joining the region table."""
    return P.region_join(_qp(spark, sf_dir), P.region_frame(spark, TREES, ["q", "p"]), ["q", "p"]).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS different, count(*) AS n FROM lineitem")
def case_vs_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC22, DL19: two independent plans of one model agree on every row."""
    rows = _qp(spark, sf_dir).withColumn("case_score", P.additive_score(TREES, _BASE, _RATE))
    joined = P.region_join(rows, P.region_frame(spark, TREES, ["q", "p"]), ["q", "p"]).groupBy(*_KEYS, "case_score").agg((_BASE + _RATE * F.sum("value")).alias("region_score"))
    return joined.agg(F.sum((F.abs(F.col("case_score") - F.col("region_score")) > 1e-9).cast("long")).alias("different"), F.count(F.lit(1)).alias("n"))


_REGIONS_SQL = "r AS (SELECT tree, leaf, value::DOUBLE AS value, q_lo::DOUBLE AS q_lo, q_hi::DOUBLE AS q_hi, p_lo::DOUBLE AS p_lo, p_hi::DOUBLE AS p_hi FROM (VALUES (0, 0, '-1', '-inf', '25', '-inf', '20000'), (0, 1, '0.5', '-inf', '25', '20000', 'inf'), (0, 2, '1', '25', 'inf', '-inf', 'inf'), (1, 0, '0.25', '-inf', '10', '-inf', '35000'), (1, 1, '-0.5', '10', 'inf', '-inf', '35000'), (1, 2, '0.75', '-inf', '40', '35000', 'inf'), (1, 3, '2', '40', 'inf', '35000', 'inf'), (2, 0, '0', '-inf', '45', '-inf', 'inf'), (2, 1, '-0.25', '45', 'inf', '-inf', 'inf')) x(tree, leaf, value, q_lo, q_hi, p_lo, p_hi))"


@query(f"""WITH {_REGIONS_SQL}, b AS (SELECT l_orderkey AS id, min(l_quantity) - 1 AS q_from, max(l_quantity) AS q_to, min(l_extendedprice) - 1 AS p_from, max(l_extendedprice) AS p_to FROM lineitem GROUP BY 1),
m AS (SELECT id, tree, min(value) AS a, max(value) AS b FROM b JOIN r ON greatest(q_lo, q_from) < least(q_hi, q_to) AND greatest(p_lo, p_from) < least(p_hi, p_to) GROUP BY ALL) SELECT id, round(0.1 + 0.3 * sum(a), 6) AS lower, round(0.1 + 0.3 * sum(b), 6) AS upper FROM m GROUP BY id""")
def box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC16, DC20: bounds of the score over each order's box of quantities and prices."""
    b = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.min("l_quantity") - 1).alias("q_from"), F.max("l_quantity").alias("q_to"), (F.min("l_extendedprice") - 1).alias("p_from"), F.max("l_extendedprice").alias("p_to"))
    return P.box_bounds(b, P.region_frame(spark, TREES, ["q", "p"]), ["q", "p"], _BASE, _RATE).select("id", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query(f"WITH {_REGIONS_SQL}, {_QP_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(q_lo) AS q_lo, min(q_hi) AS q_hi, max(p_lo) AS p_lo, min(p_hi) AS p_hi FROM t JOIN r ON q > q_lo AND q <= q_hi AND p > p_lo AND p <= p_hi GROUP BY ALL")
def stability_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC18, DC29: the box around each row in which no tree changes its leaf."""
    rows = _qp(spark, sf_dir).withColumn("id", F.struct(*_KEYS))
    return P.stability_boxes(rows, "id", P.region_frame(spark, TREES, ["q", "p"]), ["q", "p"]).select("id.*", "q_lo", "q_hi", "p_lo", "p_hi")


@query(f"""WITH {_QP_SQL}, s AS (SELECT *, {_SCORE} AS now FROM t), c AS (SELECT * FROM (VALUES ('q', 10.0), ('q', 25.0), ('q', 40.0), ('q', 45.0), ('p', 20000.0), ('p', 35000.0)) v(col, v)), m AS (SELECT col, v + d AS t FROM c, (SELECT unnest([0.0, 1e-6]) AS d)),
o AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, col, t, CASE WHEN col = 'q' THEN abs(t - q) / 10 ELSE abs(t - p) / 10000 END AS cost, CASE WHEN col = 'q' THEN t ELSE q END AS q, CASE WHEN col = 'p' THEN t ELSE p END AS p FROM s, m WHERE now < 0.5),
g AS (SELECT *, {_SCORE} AS score FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY round(cost, 9), col, t) AS k FROM g WHERE score >= 0.5)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, col AS "column", t::DOUBLE AS "to", round(cost, 5) AS cost, round(score, 6) AS score FROM k WHERE k = 1""")
def recourse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC21: the cheapest single move that reaches the goal."""
    rows = _qp(spark, sf_dir).withColumn("id", F.struct(*_KEYS))
    out = P.recourse(rows, "id", TREES, ["q", "p"], {"q": 10.0, "p": 10000.0}, _BASE, _RATE, 0.5)
    return out.select("id.*", "column", "to", F.round("cost", 5).alias("cost"), F.round("score", 6).alias("score"))
