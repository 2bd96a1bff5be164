"""Queries of schema roles, time-safe splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import schema as R
from tidemark.operators import splits as S
from tidemark.operators.history import micros
from tidemark.plans.registry import load, query

MONTH = 2_592_000_000_000
_O_SQL = "o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, epoch_us(o_orderdate) AS us FROM orders), b AS (SELECT us, count(*) AS n, sum((o_totalprice > 450000)::INT) AS c FROM o GROUP BY us), r AS (SELECT us, n, coalesce(sum(n) OVER w, 0) AS before, coalesce(sum(c) OVER w, 0) AS cb, sum(n) OVER () AS total, sum(c) OVER () AS ct FROM b WINDOW w AS (ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", micros(F.col("o_orderdate")).alias("us"))


@query("""
WITH e AS (SELECT user_id, count(*) AS n, max(ts) > min(ts) AS moves FROM events GROUP BY 1), t AS (SELECT sum(n) AS rows, count(*) AS entities, sum((n >= 3 AND moves)::INT) AS ee, sum(CASE WHEN n >= 3 AND moves THEN n ELSE 0 END) AS er FROM e)
SELECT rows::BIGINT AS rows, entities, ee::BIGINT AS eligible_entities, er::BIGINT AS eligible_rows, round(4 * er / rows + 2 * ln(1 + ee) / ln(1 + rows) + least(1.0, rows / greatest(3.0 * entities, 1.0)) + 2, 6) AS score FROM t""")
def entity_role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF31: how well a column names the entities of an event table."""
    return R.entity_score(load(spark, sf_dir, "events"), "user_id", "ts").withColumn("score", F.round("score", 6))


@query("SELECT 'ts' AS role_column, 'timestamp' AS role, 5.0::DOUBLE AS score UNION ALL SELECT 'user_id', 'entity', round((SELECT 4 * 1.0 + 2 * ln(1 + count(DISTINCT user_id)) / ln(1 + count(*)) + 1.0 + 2 FROM events), 6) + 5 UNION ALL SELECT 'value', 'value', 0.0")
def discovered_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF9, PF30, PF32, PF33, SC8: the proposed roles of the event table's columns."""
    events = load(spark, sf_dir, "events")
    best = R.discover(events)[0]
    score = dict(R.timestamp_roles(events))[best.timestamp]
    rows = [(best.timestamp, "timestamp", score), (best.entity, "entity", round(best.score, 6)), *((v, "value", 0.0) for v in best.values)]
    return spark.createDataFrame(rows, "role_column string, role string, score double")


@query(f"WITH {_O_SQL} SELECT us AS cut, before::BIGINT AS train, (total - before)::BIGINT AS valid FROM r WHERE before >= 100 AND total - before >= 40 AND cb > 0 AND cb < before AND ct - cb > 0 AND ct - cb < total - before ORDER BY abs(before - round_even(0.75 * total, 0)), before LIMIT 1")
def future_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2: the strict past/future cut nearest a quarter held out, with both classes on either side."""
    return S.future_cut(_orders(spark, sf_dir), "us", F.floor(F.col("us") / MONTH), positive=F.col("o_totalprice") > 450000)


@query(f"WITH {_O_SQL}, p AS (SELECT k AS fold, 0.4 + 0.6 * k / 3.0 AS share FROM range(3) t(k)) SELECT fold::INT AS fold, min(us) AS start FROM p JOIN r ON before >= share * total GROUP BY fold")
def expanding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, ST5: starts of disjoint future blocks after a warm-up."""
    return S.expanding_cuts(_orders(spark, sf_dir), "us", F.floor(F.col("us") / MONTH))


@query(f"WITH {_O_SQL} SELECT o_orderkey FROM o JOIN r USING (us) WHERE total - before <= 1000")
def recent_atomic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF35, SL11, ST10: the most recent rows within a cap, times never cut apart."""
    return S.recent_atomic(_orders(spark, sf_dir), "us", 1000, F.floor(F.col("us") / MONTH)).select("o_orderkey")


@query(f"WITH {_O_SQL} SELECT us, least(floor(before * 4 / total), 3)::INT AS part FROM r")
def atomic_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: balanced runs of whole times."""
    return S.atomic_parts(_orders(spark, sf_dir), "us", 4, F.floor(F.col("us") / MONTH))


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM n WHERE r = 0 OR floor(r * 99 / (n - 1)::DOUBLE + 1e-9) > floor((r - 1) * 99 / (n - 1)::DOUBLE + 1e-9)")
def evenly_spaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF34, SL8: a hundred evenly spaced rows (a sampling operator)."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return S.evenly_spaced(o, "o_orderkey", F.floor(F.col("o_orderkey") / 1000), 100)


_MD5 = "('0x' || substr(md5({id}::VARCHAR || '/0'), 1, 12))::BIGINT"


@query(f"WITH h AS (SELECT o_orderkey, o_orderstatus, {_MD5.format(id='o_orderkey')} AS h FROM orders) SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) - 1) % 5)::INT AS fold FROM h")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST14, ST16: folds with classes dealt out evenly."""
    return S.folds(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, "o_orderstatus").select("o_orderkey", "fold")


@query(f"WITH h AS (SELECT o_orderkey, o_orderpriority AS c, {_MD5.format(id='o_orderkey')} AS h FROM orders), n AS (SELECT c, count(*) AS n, least(greatest(floor(count(*) * 500 / (SELECT count(*) FROM orders)::DOUBLE), 50), count(*)) AS q FROM h GROUP BY c), k AS (SELECT h.*, row_number() OVER (PARTITION BY c ORDER BY h, o_orderkey) AS k FROM h) SELECT o_orderkey, round(n / q, 6) AS weight FROM k JOIN n USING (c) WHERE k <= q")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL9, ST15: a sample by class quotas with inverse-inclusion weights (a sampling operator)."""
    return S.stratified_sample(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 500, 50).select("o_orderkey", F.round("weight", 6).alias("weight"))


@query()
def temporal_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL10, WN22: recent rows whole, older ones thinned by bands of doubling age (a sampling operator)."""
    return S.reservoir(_orders(spark, sf_dir), "o_orderkey", "us", 2000, F.floor(F.col("us") / MONTH)).select("o_orderkey", "band")


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey FROM k WHERE k <= 8")
def recent_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL12: each entity's eight most recent rows."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 8").select("o_custkey", "o_orderkey")
