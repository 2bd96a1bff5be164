"""Queries of joins, set operations, relation chains, rules and Datalog over the star schema as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import datalog as D
from tidemark.operators import graph as G
from tidemark.plans.registry import load, query

_TRIPLES_SQL = """t AS (SELECT DISTINCT * FROM (
  SELECT 'in_region' AS rel, 'n' || n_nationkey AS head, 'r' || n_regionkey AS tail FROM nation UNION ALL SELECT 'lives_in', 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'placed', 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'supplied_by', 'o' || l_orderkey, 's' || l_suppkey FROM lineitem UNION ALL SELECT 'located_in', 's' || s_suppkey, 'n' || s_nationkey FROM supplier))"""


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, rel: str, h: str, head: str, t: str, tail: str) -> DataFrame:
        return load(spark, sf_dir, table).select(F.lit(rel).alias("rel"), F.concat(F.lit(h), F.col(head).cast("string")).alias("head"), F.concat(F.lit(t), F.col(tail).cast("string")).alias("tail"))

    parts = [part("nation", "in_region", "n", "n_nationkey", "r", "n_regionkey"), part("customer", "lives_in", "c", "c_custkey", "n", "c_nationkey"), part("orders", "placed", "c", "o_custkey", "o", "o_orderkey"), part("lineitem", "supplied_by", "o", "l_orderkey", "s", "l_suppkey"), part("supplier", "located_in", "s", "s_suppkey", "n", "s_nationkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return G.edges(out)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"))


@query("SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def left_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1: many-to-one left join; fails if the right keys repeat."""
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    if customers.groupBy("c_custkey").count().where("count > 1").limit(1).count():
        raise ValueError("customer keys repeat")
    return load(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: one-to-one left join of aggregates."""
    counts = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return load(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: rows whose key occurs elsewhere."""
    big = load(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return load(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4: rows whose key does not occur elsewhere."""
    big = load(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return load(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey, n_name, c_custkey, round(s_acctbal - c_acctbal, 2) AS difference FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN customer ON c_nationkey = s_nationkey WHERE s_acctbal > c_acctbal AND s_suppkey <> c_custkey")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5-JN7: an n-ary equi-join with side conditions and a computed term."""
    s, n, c = (load(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, parts // 4)  # a nation's customers are dealt out over so many, its suppliers go to each
    named = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "s_acctbal", "n_name", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("sb"))
    dealt = c.select("c_custkey", "c_nationkey", "c_acctbal", F.coalesce(F.pmod(F.xxhash64("c_custkey"), F.lit(blocks)), F.lit(0)).cast("int").alias("cb"))
    left, right = named.repartition(parts, "s_nationkey", "sb").hint("shuffle_hash"), dealt.repartition(parts, "c_nationkey", "cb")
    joined = right.join(left, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("cb") == F.col("sb")) & (F.col("s_acctbal") > F.col("c_acctbal")) & (F.col("s_suppkey") != F.col("c_custkey")))
    gap = F.col("s_acctbal") - F.col("c_acctbal")  # positive, or not a number
    rounded = F.when(gap < 1e13, F.floor(gap * 100 + 0.5) / 100).otherwise(F.round(gap, 2))  # like SQL's, and without decimals
    return joined.select("s_suppkey", "n_name", "c_custkey", rounded.alias("difference"))


@query(f"WITH {_TRIPLES_SQL} SELECT rel, count(*) AS n, count(DISTINCT head) AS heads FROM (SELECT * FROM t UNION ALL SELECT rel || '_inv', tail, head FROM t) GROUP BY rel")
def edge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, AG8, SO1, DL6, DL7, DL13: distinct edges with their inverses, by relation."""
    return G.with_inverses(_triples(spark, sf_dir)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("head").alias("heads"))


_CHAINS = [("lives_in",), ("lives_in", "in_region"), ("placed",), ("placed", "supplied_by"), ("placed", "supplied_by", "located_in"), ("placed", "supplied_by", "located_in", "in_region")]


def _chain_sql(chain: tuple[str, ...]) -> str:
    joins = " ".join(f"JOIN t h{k} ON h{k}.rel = '{r}' AND h{k}.head = h{k - 1}.tail" for k, r in enumerate(chain) if k)
    return f"SELECT h0.head AS source, '{G.name(chain)}' AS chain, count(DISTINCT h{len(chain) - 1}.tail) AS n FROM t h0 {joins} WHERE h0.rel = '{chain[0]}' AND h0.head LIKE 'c%' GROUP BY h0.head"


_REACH_SQL = f"WITH {_TRIPLES_SQL}, k AS ({' UNION ALL '.join(_chain_sql(c) for c in _CHAINS)})"


@query(_REACH_SQL + " SELECT * FROM k")
def chain_reach_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8-JN10, AG9: distinct nodes that a customer's relation chains reach."""
    return G.reach_counts(_triples(spark, sf_dir), _customers(spark, sf_dir), _CHAINS)


@query(_REACH_SQL + " SELECT source, n FROM k WHERE chain = 'placed→supplied_by→located_in→in_region'")
def chain_meet_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: a long chain from its two halves."""
    return G.meet_in_the_middle(_triples(spark, sf_dir), _customers(spark, sf_dir), _CHAINS[-1])


_SCORES_SQL = _REACH_SQL + ", s AS (SELECT chain, count(DISTINCT n) + (count(*) < (SELECT count(*) FROM customer))::INT AS d, count(*) AS non_zero FROM k GROUP BY chain), r AS (SELECT chain, d AS distinct_counts, non_zero, row_number() OVER (ORDER BY d DESC, non_zero DESC, chain)::INT AS rank FROM s WHERE d > 1)"


@query(_SCORES_SQL + " SELECT * FROM r WHERE rank <= 4")
def chain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10, SL3, DL9, DL10: chains mined level by level, scored and ranked."""
    customers = _customers(spark, sf_dir)
    return G.scored_chains(G.observed_chains(_triples(spark, sf_dir), customers, 4), customers, 4)


@query(_REACH_SQL + " SELECT 'c' || c_custkey AS source, coalesce(max(n) FILTER (chain = 'placed'), 0) AS placed, coalesce(max(n) FILTER (chain = 'placed→supplied_by'), 0) AS suppliers, (count(*) FILTER (chain = 'lives_in→in_region') > 0)::INT::BIGINT AS has_region FROM customer LEFT JOIN k ON k.source = 'c' || c_custkey GROUP BY 1")
def chain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL11: a column a chain for every customer, 0 without reach."""
    wide = G.features(_triples(spark, sf_dir), _customers(spark, sf_dir), [("placed",), ("placed", "supplied_by"), ("lives_in", "in_region")])
    return wide.select("source", "placed", F.col("placed→supplied_by").alias("suppliers"), F.col("lives_in→in_region").alias("has_region"))


@query(f"WITH {_TRIPLES_SQL}, p AS (SELECT DISTINCT a.head, b.tail FROM t a JOIN t b ON b.head = a.tail WHERE a.rel = 'placed' AND b.rel = 'supplied_by'), q AS (SELECT DISTINCT p.head AS source, t.tail AS node FROM p JOIN t ON t.rel = 'located_in' AND t.head = p.tail) SELECT source, count(*) AS n FROM q GROUP BY source")
def chain_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL12: a chain made a relation, then used in a deeper one."""
    wider = G.promoted(_triples(spark, sf_dir), ("placed", "supplied_by"))
    return G.reach_counts(wider, _customers(spark, sf_dir), [("@placed→supplied_by", "located_in")]).select("source", "n")


_FROM_SQL = f"WITH {_TRIPLES_SQL}, p AS (SELECT DISTINCT c.head, b.tail FROM t c JOIN t a ON a.rel = 'lives_in' AND a.head = c.head JOIN t b ON b.rel = 'in_region' AND b.head = a.tail WHERE c.rel = 'lives_in'), d AS (SELECT DISTINCT a.head, d.tail FROM t a JOIN t b ON b.rel = 'supplied_by' AND b.head = a.tail JOIN t c ON c.rel = 'located_in' AND c.head = b.tail JOIN t d ON d.rel = 'in_region' AND d.head = c.tail WHERE a.rel = 'placed')"


@query(_FROM_SQL + " SELECT 'placed→supplied_by→located_in→in_region' AS chain, count(*) AS derived, count(p.head) AS hits, round(count(p.head) / count(*)::DOUBLE, 6) AS precision, round(count(p.head) / (SELECT count(*) FROM p)::DOUBLE, 6) AS recall FROM d LEFT JOIN p USING (head, tail)")
def rule_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11, SO3, DL15: how well a chain derives a relation (customers' own region)."""
    t = _triples(spark, sf_dir)
    positives = G.reach(t, _customers(spark, sf_dir), [("lives_in", "in_region")])[("lives_in", "in_region")].select(F.col("source").alias("head"), F.col("node").alias("tail"))
    out = G.chain_quality(t, [_CHAINS[-1]], positives)
    return out.select("chain", "derived", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_INDUCE_SQL = f"""WITH {_TRIPLES_SQL}, p AS (SELECT DISTINCT c.head, b.tail FROM t c JOIN t b ON b.rel = 'in_region' AND b.head = c.tail WHERE c.rel = 'located_in'),
i AS (SELECT rel, head, tail FROM t UNION ALL SELECT rel || '_inv', tail, head FROM t), two AS (SELECT DISTINCT a.rel || '→' || b.rel AS chain, a.head, b.tail FROM i a JOIN i b ON b.head = a.tail WHERE a.head LIKE 's%' AND b.tail LIKE 'r%')"""


@query(_INDUCE_SQL + " SELECT 1 AS rank, chain, count(*) AS derived, count(p.head) AS hits, round(count(p.head) / count(*)::DOUBLE, 6) AS precision, round(count(p.head) / (SELECT count(*) FROM p)::DOUBLE, 6) AS recall FROM two LEFT JOIN p USING (head, tail) GROUP BY chain")
def induced_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, DL14, DL18: rules for a planted relation (a supplier's region), with their re-counted quality."""
    t = _triples(spark, sf_dir)
    planted = G.reach(t, t.where("rel = 'located_in'").select(F.col("head").alias("source")), [("located_in", "in_region")])[("located_in", "in_region")]
    known = G.with_inverses(t).unionByName(planted.select(F.lit("sells_in").alias("rel"), F.col("source").alias("head"), F.col("node").alias("tail")))
    out = G.induced_rules(known, "sells_in")
    return out.select("rank", "chain", "derived", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(_REACH_SQL + """, a AS (SELECT DISTINCT h0.head AS source, h1.tail FROM t h0 JOIN t h1 ON h1.rel = 'in_region' AND h1.head = h0.tail WHERE h0.rel = 'lives_in'),
w AS (SELECT 9.0 / 10 AS p1, 10.0 AS n1, 40.0 / 100 AS p2, 100.0 AS n2), b AS (SELECT source, tail, 'lives_in→in_region' AS chain, greatest((p1 + 1.64 ** 2 / (2 * n1) - 1.64 * sqrt(p1 * (1 - p1) / n1 + 1.64 ** 2 / (4 * n1 * n1))) / (1 + 1.64 ** 2 / n1), 0) AS confidence FROM a, w
UNION ALL SELECT DISTINCT a.head, d.tail, 'placed→supplied_by→located_in→in_region', greatest((p2 + 1.64 ** 2 / (2 * n2) - 1.64 * sqrt(p2 * (1 - p2) / n2 + 1.64 ** 2 / (4 * n2 * n2))) / (1 + 1.64 ** 2 / n2), 0) FROM t a JOIN t b ON b.rel = 'supplied_by' AND b.head = a.tail JOIN t c ON c.rel = 'located_in' AND c.head = b.tail JOIN t d ON d.rel = 'in_region' AND d.head = c.tail, w WHERE a.rel = 'placed'),
r AS (SELECT *, row_number() OVER (PARTITION BY source, tail ORDER BY confidence DESC, chain) AS k FROM b) SELECT source, tail, chain, round(confidence, 6) AS confidence FROM r WHERE k = 1""")
def derive_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO2, DL16, DL17: derived regions with the surest rule for each."""
    out = G.derive_certified(_triples(spark, sf_dir), [(("lives_in", "in_region"), 9, 10), (_CHAINS[-1], 40, 100)], _customers(spark, sf_dir))
    return out.select("source", "tail", "chain", F.round("confidence", 6).alias("confidence"))


@query(f"WITH RECURSIVE {_TRIPLES_SQL}, n AS (SELECT 'c0' AS node, 0 AS depth UNION SELECT t.tail, depth + 1 FROM n JOIN t ON t.head = n.node WHERE depth < 3 AND rel IN ('placed', 'supplied_by', 'located_in')) SELECT node, min(depth)::INT AS depth FROM n GROUP BY node")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL8, SO4: what lies within three steps of a customer, with its depth."""
    start = spark.createDataFrame([("c0",)], "source string")
    return G.neighbourhood(_triples(spark, sf_dir), start, ["placed", "supplied_by", "located_in"], 3)


@query(f"WITH {_TRIPLES_SQL}, n AS (SELECT head AS node FROM t UNION SELECT tail FROM t) SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM n")
def node_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL6: dense node ids."""
    return G.dictionary(_triples(spark, sf_dir))


def _nations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    n = load(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    link = n.where("n_regionkey <> 4").select(key.alias("a0"), F.pmod(F.col("n_nationkey") * 2 + 1, F.lit(25)).cast("string").alias("a1"))
    return {"link": link, "of": n.select(key.alias("a0"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("a1"))}


REACH_RULES = [
    (("path", "X", "Y"), [("link", "X", "Y")]),
    (("path", "X", "Z"), [("path", "X", "Y"), ("link", "Y", "Z")]),
    (("apart", "X", "Y"), [("of", "X", "R"), ("of", "Y", "R"), ("cmp", "<", "X", "Y"), ("not", ("path", "X", "Y"))]),
    (("gap", "X", "D"), [("link", "X", "Y"), ("is", "D", ("-", "Y", "X")), ("cmp", ">", "D", "3")]),
]

_LINK_SQL = "link AS (SELECT n_nationkey AS x, (n_nationkey * 2 + 1) % 25 AS y FROM nation WHERE n_regionkey <> 4), path AS (SELECT x, y FROM link UNION SELECT path.x, link.y FROM path JOIN link ON link.x = path.y)"


@query(f"WITH RECURSIVE {_LINK_SQL} SELECT 'path' AS pred, x::VARCHAR AS a0, y::VARCHAR AS a1 FROM path UNION ALL SELECT 'apart', a.n_nationkey::VARCHAR, b.n_nationkey::VARCHAR FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE NOT EXISTS (SELECT 1 FROM path WHERE x = a.n_nationkey AND y = b.n_nationkey) UNION ALL SELECT 'gap', x::VARCHAR, (y - x)::VARCHAR FROM link WHERE y - x > 3")
def datalog_not_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL1, DL2: a stratified program with recursion, negation, comparison and arithmetic."""
    known = D.closure(REACH_RULES, _nations(spark, sf_dir))
    out = None
    for p in ("path", "apart", "gap"):
        part = known[p].select(F.lit(p).alias("pred"), "a0", "a1")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT source, o_orderkey FROM (SELECT 'open' AS source, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'big', o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 400000)")
def tagged_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO5: concatenation with the source's name."""
    o = load(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'O'").select(F.lit("open").alias("source"), "o_orderkey").unionByName(o.where("o_totalprice > 400000").select(F.lit("big").alias("source"), "o_orderkey"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO6: one row a key, the last by date."""
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("WITH b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS n FROM b GROUP BY s), i AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM b x JOIN b y ON x.p = y.p AND x.s < y.s GROUP BY ALL) SELECT a, b, round(k / (p.n + q.n - k)::DOUBLE, 6) AS jaccard FROM i JOIN n p ON p.s = a JOIN n q ON q.s = b")
def jaccard_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO7: overlap of suppliers' parts, over pairs that share one."""
    b = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    sized = b.join(b.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s")
    x, y = sized.select(F.col("s").alias("a"), "p", F.col("n").alias("na")), sized.select(F.col("s").alias("b"), "p", F.col("n").alias("nb"))
    shared = x.join(y, "p").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    return shared.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL1, SL2, SL4, SL13: the three dearest orders of each customer, ties to the smaller key."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey")
