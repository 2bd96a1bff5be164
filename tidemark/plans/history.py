"""Queries of causal history over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators.elo import elo_snapshots
from tidemark.operators.quantile import at_ranks
from tidemark.plans.registry import load, query

DAY = 86_400_000_000
TAUS = {"h": 3600.0, "d": 86_400.0, "w": 604_800.0}

#: Events by day: truncation makes equal timestamps within a user, so that ties are exercised.
_EVENTS_SQL = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(date_trunc('day', ts)) AS us FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "event_type", "value", H.micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("us"))


def _decay_sql(weight: str) -> str:
    each = ", ".join(f"round(coalesce(sum({weight} * exp(-(b.us - p.us) / ({tau} * 1e6))), 0), 6) AS v_{t}" for t, tau in TAUS.items())
    return f"WITH {_EVENTS_SQL}, b AS (SELECT DISTINCT user_id, us FROM e) SELECT b.user_id, b.us, {each} FROM b LEFT JOIN e p ON p.user_id = b.user_id AND p.us < b.us GROUP BY b.user_id, b.us"


@query(_decay_sql("1.0"))
def event_decay_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1: decayed counts of strictly earlier events at an hour, a day and a week."""
    out = H.decayed(_events(spark, sf_dir), "user_id", "us", {"v": F.lit(1.0)}, TAUS)
    return out.select("user_id", "us", *(F.round(f"v_{t}", 6).alias(f"v_{t}") for t in TAUS))


_MARK = "CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0.0 ELSE least(greatest(value / (SELECT quantile_cont(abs(value), 0.5) FROM events WHERE value <> 0), -8.0), 8.0) END"


@query(_decay_sql("p.m").replace(_EVENTS_SQL, f"e AS (SELECT user_id, epoch_us(date_trunc('day', ts)) AS us, {_MARK} AS m FROM events)"))
def event_decay_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN2: decayed sums of values normalized by their median size."""
    events = _events(spark, sf_dir)
    mark = H.normalized_mark(F.col("value"), H.mark_scale(events, "value"))
    out = H.decayed(events, "user_id", "us", {"v": mark}, TAUS)
    return out.select("user_id", "us", *(F.round(f"v_{t}", 6).alias(f"v_{t}") for t in TAUS))


@query(f"WITH d AS ({_decay_sql('1.0').replace(', 6) AS v_', ', 12) AS v_')}) SELECT user_id, us, round(v_d - v_h, 6) AS day_band, round(v_w - v_d, 6) AS week_band FROM d")
def event_age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN3: differences of decayed counts at neighbouring scales."""
    out = H.bands(H.decayed(_events(spark, sf_dir), "user_id", "us", {"v": F.lit(1.0)}, TAUS), [f"v_{t}" for t in TAUS])
    return out.select("user_id", "us", F.round("v_d_band", 6).alias("day_band"), F.round("v_w_band", 6).alias("week_band"))


@query(f"""
WITH e AS (SELECT user_id, epoch_us(date_trunc('day', ts)) AS us, {_MARK} AS m FROM events),
b AS (SELECT user_id, us, avg(m) AS m FROM e GROUP BY ALL),
g AS (SELECT *, coalesce(ln(1 + (us - lag(us) OVER w) / 1e6 / 86400.0), 0) AS gap FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us)),
l AS (SELECT *, coalesce(lag(gap) OVER w, 0) AS pg, coalesce(lag(m, 1) OVER w, 0) AS l1, coalesce(lag(m, 2) OVER w, 0) AS l2 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT user_id, us, round(gap, 6) AS gap, round(pg, 6) AS previous_gap, round(l1, 6) AS lag1, round(l2, 6) AS lag2, round(l1 * l2, 6) AS transition FROM l""")
def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN4-WN6, JN19: gaps, batch-mean lags and their product."""
    events = _events(spark, sf_dir)
    out = H.context(events, "user_id", "us", H.normalized_mark(F.col("value"), H.mark_scale(events, "value")), 86_400.0)
    return out.select("user_id", "us", *(F.round(c, 6).alias(c) for c in ("gap", "previous_gap", "lag1", "lag2", "transition")))


def _suffix_sql() -> str:
    """The suffix tree's reading, with counts by correlated self-joins."""
    levels = []
    for d in range(4):
        match = "".join(f" AND p.h{k} = b.h{k}" for k in range(1, d + 1))
        counts = ", ".join(f"count(*) FILTER (p.s = {k}) AS d{d}_{k}" for k in range(3))
        levels.append(f"c{d} AS (SELECT b.user_id, b.us, {counts} FROM b LEFT JOIN b p ON p.us < b.us{match} GROUP BY b.user_id, b.us)")
    n = lambda d: f"(d{d}_0 + d{d}_1 + d{d}_2)"
    posterior = ["p0 AS (SELECT *, " + ", ".join(f"(d0_{k} + 0.5) / ({n(0)} + 1.5) AS p0_{k}" for k in range(3)) + " FROM j)"]
    for d in range(1, 4):
        posterior.append(f"p{d} AS (SELECT *, " + ", ".join(f"(d{d}_{k} + p{d - 1}_{k}) / ({n(d)} + 1.0) AS p{d}_{k}" for k in range(3)) + f" FROM p{d - 1})")
    gain = lambda d: " + ".join(f"CASE WHEN d{d}_{k} > 0 THEN d{d}_{k} * ln(d{d}_{k} / {n(d)} / greatest(p{d - 1}_{k}, 1e-15)) ELSE 0 END" for k in range(3))
    ok = lambda d: f"CASE WHEN h{d} IS NOT NULL AND {n(d)} >= 8 AND {gain(d)} > ln({n(d)}) THEN {d}"
    depth = f"greatest({', '.join(ok(d) + ' ELSE 0 END' for d in (1, 2, 3))})"
    pick = lambda stem: "CASE x " + " ".join(f"WHEN {d} THEN {stem(d)}" for d in range(4)) + " END"
    q = [pick(lambda d, k=k: f"p{d}_{k}") for k in range(3)]
    join = " ".join(f"JOIN c{d} USING (user_id, us)" for d in range(4))
    return f"""
    WITH e AS (SELECT user_id, epoch_us(date_trunc('day', ts)) AS us, {_MARK} AS m FROM events),
    a AS (SELECT user_id, us, avg(m) AS m FROM e GROUP BY ALL),
    s AS (SELECT user_id, us, CASE WHEN m < -0.25 THEN 0 WHEN m > 0.25 THEN 2 ELSE 1 END AS s FROM a),
    b AS (SELECT *, lag(s, 1) OVER w AS h1, lag(s, 2) OVER w AS h2, lag(s, 3) OVER w AS h3 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    {", ".join(levels)}, j AS (SELECT * FROM b {join}), {", ".join(posterior)}, x AS (SELECT *, {depth} AS x FROM p3),
    r AS (SELECT user_id, us, x, {pick(n)} AS support, {", ".join(f"{q[k]} AS q{k}" for k in range(3))} FROM x)
    SELECT user_id, us, round(q2 - q0, 6) AS expectation, round(-(q0 * ln(greatest(q0, 1e-15)) + q1 * ln(greatest(q1, 1e-15)) + q2 * ln(greatest(q2, 1e-15))) / ln(3.0), 6) AS entropy,
      round(support / (support + 1.0), 6) AS support, round(x / 3.0, 6) AS depth FROM r
    """


@query(_suffix_sql())
def event_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN7: variable-order prediction of the next symbol from a population suffix tree."""
    events = _events(spark, sf_dir)
    out = H.suffix_tree(events, "user_id", "us", H.normalized_mark(F.col("value"), H.mark_scale(events, "value")), F.floor(F.col("us") / (30 * DAY)))
    return out.select("user_id", "us", *(F.round(c, 6).alias(c) for c in ("expectation", "entropy", "support", "depth")))


@query("""
WITH e AS (SELECT user_id, epoch_us(date_trunc('day', ts)) AS us, (value > 50)::INT AS y FROM events),
b AS (SELECT DISTINCT user_id, us FROM e),
k AS (SELECT b.user_id, b.us, count(p.y) AS n, coalesce(sum(p.y), 0) AS s FROM b LEFT JOIN e p ON p.user_id = b.user_id AND p.us < b.us GROUP BY ALL),
t AS (SELECT us, count(*) AS n, sum(y) AS s FROM e GROUP BY us),
g AS (SELECT us, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS m FROM t WINDOW w AS (ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT k.user_id, k.us, round((k.s + 10 * coalesce(g.m, 0.5)) / (k.n + 10), 6) AS encoded FROM k JOIN g USING (us)""")
def causal_target_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN8: smoothed class rate of a user's strictly earlier events over the strictly earlier global rate."""
    events = _events(spark, sf_dir).withColumn("y", (F.col("value") > 50).cast("double"))
    out = H.causal_target(events, "user_id", "us", "y", 10.0, 0.5, F.floor(F.col("us") / (30 * DAY)))
    return out.select("user_id", "us", F.round("encoded", 6).alias("encoded"))


@query("""
WITH e AS (SELECT event_type, epoch_us(date_trunc('day', ts)) AS us, value AS y FROM events),
b AS (SELECT event_type, us, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM e GROUP BY ALL),
k AS (SELECT event_type, us, coalesce(sum(n) OVER w, 0) AS kn, coalesce(sum(s) OVER w, 0) AS ks, coalesce(sum(q) OVER w, 0) AS kq FROM b WINDOW w AS (PARTITION BY event_type ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT us, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM b GROUP BY us),
g AS (SELECT us, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(q) OVER w, 0) AS q FROM t WINDOW w AS (ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT k.*, CASE WHEN n > 0 THEN s / n ELSE 0 END AS m, CASE WHEN n > 1 THEN greatest((q - s * s / n) / (n - 1), 1e-12 * greatest(1, abs(s / n)) ** 2) ELSE 0 END AS var FROM k JOIN g USING (us)),
l AS (SELECT *, least(var * 1e3, greatest(var * 1e-3, (greatest(kq - ks * ks / nullif(kn, 0), 0) + 10 * var) / (greatest(kn - 1, 0) + 10))) AS lv FROM v)
SELECT event_type, us, round(CASE WHEN kn = 0 THEN m WHEN var = 0 THEN (ks + 10 * m) / (kn + 10) ELSE (10 / var * m + kn / lv * (ks / kn)) / (10 / var + kn / lv) END, 6) AS encoded FROM l""")
def causal_gaussian_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN9: variance-aware mean of an event type's strictly earlier values."""
    out = H.causal_gaussian(_events(spark, sf_dir), "event_type", "us", "value", 10.0, F.floor(F.col("us") / (30 * DAY)))
    return out.select("event_type", "us", F.round("encoded", 6).alias("encoded"))


@query("""
WITH b AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events),
g AS (SELECT (us - lag(us) OVER (PARTITION BY user_id ORDER BY us)) / 1e6 AS gap FROM b),
s AS (SELECT (max(us) - min(us)) / 1e6 AS span FROM b GROUP BY user_id)
SELECT round((SELECT quantile_cont(gap, 0.1) FROM g WHERE gap > 0), 6) AS gap_low, (SELECT count(*) FROM g WHERE gap > 0) AS n_gaps, round((SELECT quantile_cont(span, 0.95) FROM s WHERE span > 0), 6) AS span_high""")
def auto_scales_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN10: the quantiles between which time scales are spaced."""
    out = H.scale_range(load(spark, sf_dir, "events").select("user_id", H.micros(F.col("ts")).alias("us")), "user_id", "us")
    return out.select(F.round("gap_low", 6).alias("gap_low"), "n_gaps", F.round("span_high", 6).alias("span_high"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), cut AS (SELECT quantile_disc(us, 0.7) AS c FROM e),
t AS (SELECT * FROM e, cut WHERE us <= c), f AS (SELECT DISTINCT user_id, us FROM e, cut WHERE us > c),
all_before AS (SELECT f.user_id, f.us, coalesce(sum(exp(-(f.us - e.us) / 86400e6)), 0) AS v FROM f LEFT JOIN e ON e.user_id = f.user_id AND e.us < f.us GROUP BY ALL)
SELECT user_id, us, round(v, 6) AS v_d FROM all_before""")
def frozen_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN12, WN13, JN13, ST11: later events continue from the state of earlier ones, which stays as it was fitted."""
    events = load(spark, sf_dir, "events").select("user_id", H.micros(F.col("ts")).alias("us"))
    n = events.count()
    cut = at_ranks(events, "us", [max(0, -(-7 * n // 10) - 1)])[1][0]
    taus, weights = {"d": 86_400.0}, {"v": F.lit(1.0)}
    state = H.final_state(events.where(F.col("us") <= cut), "user_id", "us", weights, taus)
    out = H.frozen(events.where(F.col("us") > cut), state, "user_id", "us", weights, taus)
    return out.select("user_id", "us", F.round("v_d", 6).alias("v_d"))


@query("""
SELECT o_orderkey, lag(o_totalprice) OVER w AS previous_price, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days_since, date_diff('day', o_orderdate, lead(o_orderdate) OVER w) AS days_until
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN14: a customer's order before and after."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = load(spark, sf_dir, "orders")
    days = lambda a, b: F.datediff(F.to_date(a), F.to_date(b)).cast("long")
    return orders.select("o_orderkey", F.lag("o_totalprice").over(w).alias("previous_price"), days(F.col("o_orderdate"), F.lag("o_orderdate").over(w)).alias("days_since"), days(F.lead("o_orderdate").over(w), F.col("o_orderdate")).alias("days_until"))


@query("""
SELECT o_orderkey, row_number() OVER w - 1 AS n_before, round(coalesce(sum(o_totalprice) OVER p, 0), 2) AS spent_before, round(avg(o_totalprice) OVER p, 6) AS mean_before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def order_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN15: cumulative count, sum and mean before each order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = w.rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("n_before"), F.round(F.coalesce(F.sum("o_totalprice").over(p), F.lit(0.0)), 2).alias("spent_before"), F.round(F.avg("o_totalprice").over(p), 6).alias("mean_before"))


@query("""
SELECT o_orderkey, count(*) OVER c AS n_orders, round(quantile_cont(o_totalprice, 0.5) OVER c, 6) AS median_price, row_number() OVER w = 1 AS is_first, row_number() OVER w = count(*) OVER c AS is_last
FROM orders WINDOW c AS (PARTITION BY o_custkey), w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN16: a customer's totals on each order, and which is the first or last."""
    c = Window.partitionBy("o_custkey")
    number = F.row_number().over(c.orderBy("o_orderdate", "o_orderkey"))
    n = F.count(F.lit(1)).over(c)
    return load(spark, sf_dir, "orders").select("o_orderkey", n.alias("n_orders"), F.round(F.percentile("o_totalprice", F.lit(0.5)).over(c), 6).alias("median_price"), (number == 1).alias("is_first"), (number == n).alias("is_last"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0) / count(*) OVER (PARTITION BY l_suppkey), 6) AS pct FROM lineitem")
def quantity_percent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN17: percent rank with averaged ties."""
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(H.percent_rank_average("l_quantity", ["l_suppkey"]), 6).alias("pct"))


@query("""
WITH m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS period, o_totalprice FROM orders), b AS (SELECT DISTINCT o_custkey, period FROM m)
SELECT b.o_custkey, b.period, round(sum(pow(2.0, -(b.period - p.period) / 12.0) * p.o_totalprice) / sum(pow(2.0, -(b.period - p.period) / 12.0)), 6) AS value
FROM b LEFT JOIN m p ON p.o_custkey = b.o_custkey AND p.period < b.period GROUP BY ALL""")
def order_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN18: half-life weighted mean price of a customer's earlier months."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("period"), "o_totalprice")
    out = H.half_life_mean(orders, "o_custkey", "period", "o_totalprice", 12.0)
    return out.select("o_custkey", "period", F.round("value", 6).alias("value"))


@query("""
SELECT o_orderkey, lag(o_totalprice) OVER w AS last_price, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS mean3
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN19: the last value and the mean of the last three before each order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("last_price"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-3, -1)), 6).alias("mean3"))


@query()
def elo_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN20: rating snapshots after sequential pairings within a nation and market segment."""
    orders, customers = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_mktsegment", "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("o_orderdate", "o_orderkey")
    games = joined.withColumns({"rival": F.lag("o_custkey").over(w), "rival_price": F.lag("o_totalprice").over(w)}).where("rival is not null and rival <> o_custkey")
    result = F.when(F.col("o_totalprice") > F.col("rival_price"), 1.0).when(F.col("o_totalprice") < F.col("rival_price"), 0.0).otherwise(0.5)
    games = games.select(F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("league"), F.year("o_orderdate").cast("long").alias("edition"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_custkey").alias("a"), F.col("rival").alias("b"), result.alias("result"))
    return elo_snapshots(games, "league", "edition", "at", "a", "b", "result")
