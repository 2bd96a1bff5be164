"""Queries of evidence members, gates, searches and proof records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import members as M
from tidemark.operators import proofs
from tidemark.plans.predicates import TREES
from tidemark.plans.registry import load, query

_BITS = {f"v{t}": f"value > {t}" for t in (10, 20, 30, 40, 60, 90)} | {f"u{k}": f"user_id % {k} = 0" for k in (2, 3, 5)} | {f"t_{t}": f"event_type = '{t}'" for t in ("view", "click", "purchase")}
_P_SQL = "p AS (SELECT event_id, user_id, (value > 40)::INT AS y, round(1 / (1 + exp(-(value - 50) / 50)), 3) AS b, round(1 / (1 + exp(-(value - 40 + user_id % 11) / 20)), 3) AS c FROM events)"


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return load(spark, sf_dir, "events").select("event_id", "user_id", (v > 40).cast("int").alias("y"), F.round(X.logistic((v - 50) / 50), 3).alias("b"), F.round(X.logistic((v - 40 + F.col("user_id") % 11) / 20), 3).alias("c"))


@query(f"WITH {_P_SQL} SELECT event_id, round(CASE WHEN b <= 0.5 AND c >= 0.5 THEN least(b, 0.5) + (0.5 - least(b, 0.5)) * (2 * c - 1) WHEN b > 0.5 AND c <= 0.5 THEN 0.5 + (b - 0.5) * 2 * c ELSE c END, 6) AS projected FROM p")
def class_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN21: a candidate probability kept on the base's side."""
    return _p(spark, sf_dir).select("event_id", F.round(M.preserve_class(F.col("b"), F.col("c")), 6).alias("projected"))


_GATE_SQL = f"""
WITH {_P_SQL}, q AS (SELECT *, event_id % 3 AS fold, CASE WHEN b <= 0.5 AND c >= 0.5 THEN least(b, 0.5) + (0.5 - least(b, 0.5)) * (2 * c - 1) WHEN b > 0.5 AND c <= 0.5 THEN 0.5 + (b - 0.5) * 2 * c ELSE c END AS j FROM p),
l AS (SELECT 'b' AS which, fold, y, b AS s FROM q UNION ALL SELECT 'c', fold, y, c FROM q UNION ALL SELECT 'j', fold, y, j FROM q), m AS (SELECT which, fold, y, s FROM l UNION ALL SELECT which, -1, y, s FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY which, fold ORDER BY s) + (count(*) OVER (PARTITION BY which, fold, s) - 1) / 2.0 AS rank FROM m),
a AS (SELECT which, fold, (sum(rank) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY ALL),
w AS (SELECT fold, sum(((c >= 0.5)::INT = y AND (b >= 0.5)::INT <> y)::INT) AS wins, sum(((b >= 0.5)::INT = y AND (c >= 0.5)::INT <> y)::INT) AS losses, count(*) AS n FROM q GROUP BY fold),
t AS (SELECT sum(wins) AS wins, sum(losses) AS losses, sum(n) AS n, bool_and(wins >= losses) AS every, 2 * sum((wins > losses)::INT) >= count(*) AS half FROM w),
x AS (SELECT avg(-ln(greatest(CASE WHEN y = 1 THEN b ELSE 1 - b END, 1e-300))) AS lb, avg(-ln(greatest(CASE WHEN y = 1 THEN c ELSE 1 - c END, 1e-300))) AS lc FROM p),
g AS (SELECT max(auc) FILTER (which = 'j' AND fold = -1) AS j, max(auc) FILTER (which = 'b' AND fold = -1) AS b, max(auc) FILTER (which = 'c' AND fold = -1) AS c FROM a),
f AS (SELECT bool_and(x.auc >= z.auc) AS every FROM a x JOIN a z ON x.fold = z.fold AND x.which = 'j' AND z.which = 'b' AND x.fold >= 0)
SELECT t.wins::BIGINT AS wins, t.losses::BIGINT AS losses, round((t.wins - t.losses) / sqrt(greatest(t.wins + t.losses, 1)), 6) AS z, round(g.j - g.b, 6) AS auc_gain, g.j - g.b >= 0.003 AND f.every AS rank,
(t.wins - t.losses) / t.n >= 0.005 AND (t.wins - t.losses) / sqrt(greatest(t.wins + t.losses, 1)) >= 2 AND t.every AND t.half AND g.c >= g.b - 0.001 AND x.lc <= x.lb + 1 / sqrt(t.n) AS decision FROM t, x, g, f"""


@query(_GATE_SQL)
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML23: whether a candidate may replace a base for ranks and for decisions, with paired wins and losses."""
    found = M.probability_gate(_p(spark, sf_dir).withColumn("fold", F.pmod("event_id", F.lit(3))), "y", "b", "c", "fold")
    row = (found["wins"], found["losses"], round(found["z"], 6), round(found["auc_gain"], 6), found["rank"], found["decision"])
    return spark.createDataFrame([row], "wins long, losses long, z double, auc_gain double, rank boolean, decision boolean")


@query("""
WITH t AS (SELECT l_quantity AS q, l_tax AS t, l_extendedprice + 3000 * l_quantity AS price FROM lineitem), l AS (SELECT 'q' AS feature, q AS x, price FROM t UNION ALL SELECT 't', t, price FROM t),
c AS (SELECT DISTINCT feature, cut FROM (SELECT feature, unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cut FROM l GROUP BY feature)),
v AS (SELECT d.feature, d.x, count(c.cut) AS bin FROM (SELECT DISTINCT feature, x FROM l) d LEFT JOIN c ON c.feature = d.feature AND c.cut <= d.x GROUP BY ALL),
m AS (SELECT feature, bin, avg(price) AS m FROM l JOIN v USING (feature, x) GROUP BY ALL), d AS (SELECT *, m - lag(m) OVER (PARTITION BY feature ORDER BY bin) AS d FROM m),
s AS (SELECT feature, sum((d > 0)::INT) AS up, sum((d < 0)::INT) AS down, count(d) AS k, max(m) - min(m) AS r FROM d GROUP BY feature)
SELECT CASE WHEN up > down THEN 1 ELSE -1 END AS direction, feature FROM s WHERE greatest(up, down) / k >= 0.8 AND r / (SELECT stddev_pop(price) FROM t) >= 0.15""")
def monotone_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML9: features along which the price runs one way."""
    t = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), (F.col("l_extendedprice") + 3000 * F.col("l_quantity")).alias("price"))
    return M.monotone_trends(t, ["q", "t"], "price").select("direction", "feature")


@query("SELECT l_returnflag AS leaf, round(regr_slope(l_extendedprice, l_quantity) * count(*) / (count(*) + 100.0), 2) AS slope FROM lineitem GROUP BY l_returnflag")
def ridge_leaf_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8: a ridge line in each leaf from moment sums; over a standardized feature the penalty shrinks by n / (n + 100)."""
    found = M.ridge_leaves(load(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity"], "l_extendedprice", F.lit(1.0), 100.0, 1.0)
    return spark.createDataFrame([(k, round(c["l_quantity"], 2)) for k, (_, c, _) in found.items()], "leaf string, slope double")


@query("SELECT l_returnflag AS leaf, round(-sum(20 - l_quantity) / (count(*) + 1), 6) AS value FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_returnflag")
def honest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML40: leaf values from rows that did not shape the tree."""
    out = M.honest_leaves(load(spark, sf_dir, "lineitem"), "l_returnflag", 20 - F.col("l_quantity"), F.lit(1.0), F.col("l_orderkey") % 5 != 0)
    return out.select(F.col("l_returnflag").alias("leaf"), F.round("value", 6).alias("value"))


@query(f"WITH {_P_SQL} SELECT event_id, round((b - y) - ((1 - b) * c - (1 - y) * (user_id % 2)), 6) AS g, round(greatest(b + (1 - b) * c - (b - (1 - b) * c) ** 2, 0), 6) AS h FROM p")
def pair_newton_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML41: gradient and curvature along the difference of two class scores."""
    rest = (1 - F.col("b")) * F.col("c")
    g, h = M.pair_newton(F.col("b"), rest, F.col("y"), (1 - F.col("y")) * (F.col("user_id") % 2), F.lit(1.0))
    return _p(spark, sf_dir).select("event_id", F.round(g, 6).alias("g"), F.round(h, 6).alias("h"))


@query("""
WITH e AS (SELECT (value > 30)::INT AS b0, (user_id % 2)::INT AS b1, (event_type = 'view')::INT AS b2, (event_id % 3 = 0)::INT AS b3 FROM events), r AS (SELECT *, b0 * b2 AS y, count(*) AS n FROM e GROUP BY ALL),
v AS (SELECT unnest([1, 0, NULL]) AS v), c AS (SELECT a.v AS c0, b.v AS c1, c.v AS c2, d.v AS c3 FROM v a, v b, v c, v d WHERE coalesce(a.v, b.v, c.v, d.v) IS NOT NULL),
s AS (SELECT c0, c1, c2, c3, (c0 IS NOT NULL)::INT + (c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT AS width, coalesce(c0 = b0, true) AND coalesce(c1 = b1, true) AND coalesce(c2 = b2, true) AND coalesce(c3 = b3, true) AS hit, y, n FROM c, r),
k AS (SELECT c0, c1, c2, c3, width, coalesce(sum(n) FILTER (hit AND y = 1), 0) AS p, coalesce(sum(n) FILTER (hit AND y = 0), 0) AS q, sum(n) FILTER (y = 1) AS pt, sum(n) FILTER (y = 0) AS qt FROM s GROUP BY ALL),
g AS (SELECT *, 1 + log2(5) + 3 * width AS bits, [(pt, qt), (p, q), (pt - p, qt - q)] AS parts FROM k),
h AS (SELECT *, list_transform(parts, lambda x: -(lgamma(x[1]::DOUBLE + 0.5) + lgamma(x[2]::DOUBLE + 0.5) - lgamma(x[1]::DOUBLE + x[2]::DOUBLE + 1) - ln(pi())) / ln(2)) AS code FROM g),
o AS (SELECT concat_ws(' ', 'b0=' || c0, 'b1=' || c1, 'b2=' || c2, 'b3=' || c3) AS program, code[1] - code[2] - code[3] - bits AS saved FROM h)
SELECT row_number() OVER (ORDER BY round(saved, 6) DESC, program)::INT AS rank, program, round(saved, 3) AS saved FROM o WHERE saved >= 2 QUALIFY rank <= 3""")
def program_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML43: the conjunctions of bits that shorten a planted target's code most: a beam over plain ANDs, no other program."""
    e = load(spark, sf_dir, "events")
    flag = lambda c: c.cast("int")
    bits = e.select(flag(F.col("value") > 30).alias("b0"), flag(F.col("user_id") % 2).alias("b1"), flag(F.col("event_type") == "view").alias("b2"), flag(F.col("event_id") % 3 == 0).alias("b3"))
    found = M.conjunction_search(bits.withColumn("y", F.col("b0") * F.col("b2")), ["b0", "b1", "b2", "b3"], "y", most=3)
    return spark.createDataFrame([(k + 1, " ".join(f"{b}={v}" for b, v in c), round(saved, 3)) for k, (c, saved) in enumerate(found)], "rank int, program string, saved double")


@query("WITH v AS (SELECT DISTINCT l_tax AS v FROM lineitem), m AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS cut FROM v) SELECT round(cut, 6) AS cut FROM m WHERE cut IS NOT NULL")
def rare_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML45: thresholds between a column's few values."""
    t = load(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(round(c, 6),) for c in M.rare_grid(t, "l_tax", F.col("l_returnflag") == "R")], "cut double")


@query(f"WITH {_P_SQL}, o AS (SELECT event_id, greatest(1 - greatest(b, c), 0) AS a0, greatest(greatest(b, c) - least(b, c), 0) AS a1, least(b, c) AS a2 FROM p) SELECT event_id, round(a0 / (a0 + a1 + a2), 6) AS p0, round(a1 / (a0 + a1 + a2), 6) AS p1, round(a2 / (a0 + a1 + a2), 6) AS p2 FROM o")
def ordinal_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML34: class probabilities from cumulative ones."""
    parts = M.ordinal_probabilities([F.greatest("b", "c"), F.least("b", "c")])
    return _p(spark, sf_dir).select("event_id", *(F.round(p, 6).alias(f"p{k}") for k, p in enumerate(parts)))


@query()
def logit_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML20: a standardized L2 logistic read, folded back to raw coefficients."""
    e = load(spark, sf_dir, "events").select((F.col("value") > 60).cast("int").alias("y"), "value", (F.col("user_id") % 10).cast("double").alias("u"))
    intercept, coefficients = M.logit_member(e, ["value", "u"], "y")
    return spark.createDataFrame([("intercept", round(intercept, 6)), *((k, round(v, 6)) for k, v in coefficients.items())], "term string, weight double")


@query("SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS sha FROM orders")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN22: hashes of canonical rows."""
    return load(spark, sf_dir, "orders").select("o_orderkey", proofs.digest_column(["o_orderstatus", "o_orderkey", "o_orderpriority"]).alias("sha"))


@query()
def proof_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC19, DC23, DC25: for orders' largest lines a record of the score, its check, and a sufficient reason in words."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for k, q, p in f.itertuples(index=False):
                record = proofs.artifact(TREES, 0.1, 0.3, {"q": float(q), "p": float(p)})
                reason = proofs.words(proofs.sufficient_reason(TREES, 0.1, 0.3, record["row"], 0.5))
                out.append((k, record["score"], record["sha256"], proofs.check(record, TREES), reason))
            yield pd.DataFrame(out, columns=["l_orderkey", "score", "sha256", "verified", "reason"])

    return rows.mapInPandas(run, "l_orderkey long, score double, sha256 string, verified boolean, reason string")


_SCREEN_SQL = " UNION ALL ".join(f"SELECT '{name}' AS bit, md5('{name}') AS h, coalesce(abs(avg(y) FILTER (b) - avg(y) FILTER (NOT b)) / 2, 0) AS a FROM (SELECT ({test}) AS b, (value > 50 AND user_id % 2 = 0)::INT::DOUBLE AS y FROM events)" for name, test in _BITS.items())


@query(f"WITH a AS ({_SCREEN_SQL}), r AS (SELECT *, row_number() OVER (ORDER BY round(a, 12) DESC, bit) AS k FROM a), o AS (SELECT bit, row_number() OVER (ORDER BY h) AS k FROM r WHERE k > 6) SELECT bit FROM r WHERE k <= 6 UNION ALL SELECT bit FROM o WHERE k <= 2")
def bit_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL6: which binary columns a search looks at, strongest ones and some by hash."""
    e = load(spark, sf_dir, "events")
    bits = e.select(*(F.expr(test).cast("int").alias(name) for name, test in _BITS.items()), F.expr("value > 50 and user_id % 2 = 0").cast("int").alias("y"))
    return spark.createDataFrame([(b,) for b in M.screened_bits(bits, list(_BITS), "y", 8)], "bit string")
