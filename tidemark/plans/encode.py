"""Queries of encodings, grouped aggregates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import encode as E
from tidemark.plans.registry import load, query


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def strict_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, PF1, PF2: a table brought to its fitted columns, an entity column dropped."""
    fitted = ["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"]
    return E.strict_columns(load(spark, sf_dir, "customer").drop("c_name").select("c_acctbal", "c_nationkey", "c_mktsegment", "c_custkey"), fitted).drop("c_nationkey")


@query("SELECT p_partkey, p_retailprice, p_size, round(p_retailprice / p_size, 6) AS unit_price FROM part")
def augment_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF3: new columns appended, existing ones untouched."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return E.augment(parts, {"unit_price": F.round(F.col("p_retailprice") / F.col("p_size"), 6)})


@query("""
WITH t AS (SELECT cast(p_size AS VARCHAR) AS size_text, p_brand AS brand_text, CASE WHEN p_partkey % 3 = 0 THEN '0' || p_partkey ELSE p_partkey::VARCHAR END AS code_text FROM part),
u AS (UNPIVOT t ON size_text, brand_text, code_text INTO NAME "column" VALUE v),
s AS (SELECT "column", avg((try_cast(trim(v) AS DOUBLE) IS NOT NULL)::INT) AS parsed, avg(regexp_matches(trim(v), '^0[0-9]')::INT) AS coded FROM u GROUP BY "column")
SELECT "column", round(parsed, 6) AS parsed, round(coded, 6) AS coded, parsed > 0.9 AND coded < 0.05 AS "numeric" FROM s""")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF4, FN9: which text columns hold numbers, and which hold codes with leading zeros."""
    part = load(spark, sf_dir, "part")
    t = part.select(F.col("p_size").cast("string").alias("size_text"), F.col("p_brand").alias("brand_text"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("0"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("code_text"))
    out = E.numeric_profile(t, ["size_text", "brand_text", "code_text"])
    return out.select("column", F.round("parsed", 6).alias("parsed"), F.round("coded", 6).alias("coded"), "numeric")


@query("""
WITH q AS (SELECT event_id, CASE WHEN value > 200 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM q)), 6) AS v, (v IS NULL)::INT::DOUBLE AS v__isna FROM q""")
def impute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF5, PF6, AG28: non-finite values become the median, with a flag."""
    events = load(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 200, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    return E.impute(events, ["v"]).select("event_id", F.round("v", 6).alias("v"), "v__isna")





@query("""
WITH l AS (SELECT o_orderpriority AS level, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS code FROM orders GROUP BY o_orderpriority)
SELECT o_orderkey, (code = 0)::INT::DOUBLE AS h0, (code = 1)::INT::DOUBLE AS h1, (code = 2)::INT::DOUBLE AS h2, code::INT AS code FROM orders JOIN l ON level = o_orderpriority""")
def onehot_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF7, PF12, PF13: indicators of levels by frequency, and the level's number."""
    orders = load(spark, sf_dir, "orders")
    fitted = E.levels(orders, "o_orderpriority")
    hot = E.one_hot(orders, "o_orderpriority", fitted)
    column = lambda k: F.col(f"`o_orderpriority={fitted[k]}`") if k < len(fitted) else F.lit(0.0)
    return hot.select("o_orderkey", *(column(k).alias(f"h{k}") for k in range(3)), E.level_code("o_orderpriority", fitted).alias("code"))


@query("SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / (count(*) OVER ())::DOUBLE, 6) AS p_brand__freq FROM part")
def freq_encode_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF8, JN12: a level's share of rows."""
    part = load(spark, sf_dir, "part")
    return E.lookup(part, "p_brand", E.frequencies(part, "p_brand"), "share", 0.0, "p_brand__freq").select("p_partkey", F.round("p_brand__freq", 6).alias("p_brand__freq"))


@query("""
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS y, (l_orderkey % 5) AS f FROM lineitem),
g AS (SELECT avg(y) AS m FROM t), p AS (SELECT l_partkey, f, count(*) AS n, sum(y) AS s FROM t GROUP BY ALL), k AS (SELECT l_partkey, sum(n) AS n, sum(s) AS s FROM p GROUP BY ALL)
SELECT l_orderkey, t.l_partkey, l_suppkey, l_linenumber, round((k.s - p.s + 20 * m) / (k.n - p.n + 20), 6) AS encoded FROM t JOIN p ON p.l_partkey = t.l_partkey AND p.f = t.f JOIN k ON k.l_partkey = t.l_partkey, g""")
def oof_target_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, AG2, ST14: out-of-fold smoothed target means."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    out = E.oof_target(lines, "l_partkey", "l_quantity", F.pmod("l_orderkey", F.lit(5)), 20.0, "encoded")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("encoded", 6).alias("encoded"))


@query("""
WITH t AS (SELECT p_brand, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT avg((l_returnflag = 'N')::INT) AS pn, avg((l_returnflag = 'R')::INT) AS pr FROM t)
SELECT p_brand AS level, round((sum((l_returnflag = 'N')::INT) + 15.0 * any_value(pn)) / (count(*) + 15.0), 6) AS n_rate, round((sum((l_returnflag = 'R')::INT) + 15.0 * any_value(pr)) / (count(*) + 15.0), 6) AS r_rate FROM t, g GROUP BY p_brand""")
def class_posterior_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3: smoothed class rates by level."""
    t = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "l_returnflag")
    out = E.class_posteriors(t, "p_brand", "l_returnflag", ["A", "N", "R"], 15.0)
    return out.select("level", F.round("`target=N`", 6).alias("n_rate"), F.round("`target=R`", 6).alias("r_rate"))


@query("""
WITH g AS (SELECT avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem),
b AS (SELECT l_suppkey::VARCHAR AS level, count(*) AS n, avg(l_extendedprice) AS x, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY l_suppkey),
l AS (SELECT *, least(greatest((ss + 10 * v) / (n - 1 + 10), 1e-3 * v), 1e3 * v) AS lv FROM b, g)
SELECT level, round((10 / v * m + n / lv * x) / (10 / v + n / lv), 4) AS mean FROM l""")
def gaussian_mean_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4: conjugate category means."""
    return E.gaussian_means(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 10.0).select("level", F.round("mean", 4).alias("mean"))


@query("""
SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS items, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice) + 1e-7, 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most,
  round(sum(o_totalprice * o_totalprice) / sum(o_totalprice) ** 2, 6) AS concentration, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS signature, sum((o_totalprice > 200000)::BIGINT)::BIGINT AS flagged
FROM orders GROUP BY o_custkey""")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5: many named aggregates of a key."""
    out = E.rollup(load(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderpriority", F.col("o_totalprice") > 200000)
    return out.select("o_custkey", "n", "items", F.round("total", 2).alias("total"), F.round(F.col("mean") + 1e-7, 4).alias("mean"), "least", "most", F.round("concentration", 6).alias("concentration"), "signature", "flagged")


@query("SELECT sum((a > 1)::INT)::BIGINT AS o_orderstatus, sum((b > 1)::INT)::BIGINT AS o_orderpriority FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY o_custkey)")
def inconsistent_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: keys with more than one value."""
    return E.inconsistent(load(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_orderkey, min(l_returnflag) AS flag, min(l_returnflag) <> max(l_returnflag) AS conflicting FROM lineitem GROUP BY l_orderkey")
def resolved_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7: conflicting values resolved to the least, and marked."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), (F.min("l_returnflag") != F.max("l_returnflag")).alias("conflicting"))


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders),
o AS (SELECT epoch_us(list_sort(list(d))[(count(d) // 2) + 1]) AS us FROM t),
f AS (SELECT o_orderkey, d IS NULL AS na, coalesce(d, make_timestamp(us)) AS ts, us FROM t, o),
h AS (SELECT *, hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 AS hh FROM f)
SELECT o_orderkey, round((epoch_us(ts) - us) / 86400e6, 6) AS elapsed_days, round(sin((dayofyear(ts) - 1 + hh / 24) * 2 * pi() / 365.2425), 6) AS annual_sin, round(cos((dayofyear(ts) - 1 + hh / 24) * 2 * pi() / 365.2425), 6) AS annual_cos,
  round(sin((isodow(ts) - 1 + hh / 24) * 2 * pi() / 7), 6) AS weekly_sin, round(cos((isodow(ts) - 1 + hh / 24) * 2 * pi() / 7), 6) AS weekly_cos, na::INT::DOUBLE AS isna FROM h""")
def datetime_cycles_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1-FN4: elapsed days from the upper median and calendar cycles, missing times flagged."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("d"))
    out = E.datetime_features(orders, "d", E.datetime_origin(orders, "d"))
    return out.select("o_orderkey", *(F.round(f"d__datetime_{c}", 6).alias(c) for c in ("elapsed_days", "annual_sin", "annual_cos", "weekly_sin", "weekly_cos", "isna")))


@query("""
SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, (isodow(ts) - 1)::INT AS wd, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS days,
  CASE WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'mid' WHEN value <= 100 THEN 'high' ELSE 'top' END AS bucket,
  round(coalesce(value / nullif(user_id % 5, 0), 0), 6) AS ratio, round(1 / (1 + exp(-(value - 50) / 50)), 6) AS p, round(ln(1 + abs(value)), 6) AS l1 FROM events""")
def scalar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN5-FN7, FN13, FN15: calendar parts, right-closed bins, safe ratio, logistic and log1p."""
    v = F.col("value")
    bucket = F.when(v <= 10, "low").when(v <= 50, "mid").when(v <= 100, "high").otherwise("top")
    return load(spark, sf_dir, "events").select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.weekday("ts").alias("wd"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"),
        bucket.alias("bucket"), F.round(X.safe_ratio(v, F.col("user_id") % 5), 6).alias("ratio"), F.round(X.logistic((v - 50) / 50), 6).alias("p"), F.round(F.log1p(F.abs(v)), 6).alias("l1"),
    )


@query("SELECT DISTINCT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN8: names in lower case with underscores."""
    return load(spark, sf_dir, "part").select("p_name", X.normalized_name(F.col("p_name")).alias("name")).distinct()


@query("""
SELECT event_type, round(sum(value * w) / sum(w), 6) AS weighted_mean, round(sum(w) ** 2 / sum(w * w), 6) AS effective_n, round(corr(value, w), 6) AS r, round(stddev_samp(value), 6) AS sd
FROM (SELECT event_type, value, 1.0 + user_id % 7 AS w FROM events) GROUP BY event_type""")
def weighted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG30, AG32: weighted mean, effective sample size, correlation."""
    e = load(spark, sf_dir, "events").select("event_type", "value", (1.0 + F.col("user_id") % 7).alias("w"))
    return e.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 6).alias("weighted_mean"), F.round(F.pow(F.sum("w"), F.lit(2.0)) / F.sum(F.col("w") * F.col("w")), 6).alias("effective_n"), F.round(F.corr("value", "w"), 6).alias("r"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query("SELECT doc_id, round(count(*) OVER () / (count(DISTINCT quality) OVER () * count(*) OVER (PARTITION BY quality))::DOUBLE, 6) AS weight FROM labels")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG31: weights that give each class the same total."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    counts = labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")))
    return labels.join(counts.crossJoin(total), "quality").select("doc_id", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, rank() OVER (ORDER BY o_totalprice) AS a, rank() OVER (ORDER BY o_orderdate) AS b FROM orders) SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM s""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG32: correlation of ranks; ranks come from running totals, not from one global sort task."""
    from tidemark.operators.prefix import prior_totals

    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    a = prior_totals(orders, "o_totalprice", F.floor(F.col("o_totalprice") / 5000), n=F.count(F.lit(1))).select("o_totalprice", F.col("prior_n").alias("a"))
    b = prior_totals(orders, "us", F.floor(F.col("us") / 2_592_000_000_000), n=F.count(F.lit(1))).select("us", F.col("prior_n").alias("b"))
    ranked = orders.join(a, "o_totalprice").join(b, "us")
    return ranked.agg(F.round(F.corr(F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))


@query("""
WITH a AS (SELECT l_orderkey, sum(l_quantity) AS x, sum(l_quantity * 1.0) AS y, count(*) AS z FROM lineitem GROUP BY 1) SELECT bool_and(x IS NOT DISTINCT FROM y) AS xy, bool_and(x IS NOT DISTINCT FROM z) AS xz FROM a""")
def duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG33: whether two columns are equal in every row."""
    a = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("x"), F.sum(F.col("l_quantity") * 1.0).alias("y"), F.count(F.lit(1)).cast("double").alias("z"))
    return a.agg(F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("xy"), F.bool_and(F.col("x").eqNullSafe(F.col("z"))).alias("xz"))


@query("""
WITH e AS (SELECT event_type, value AS x, user_id % 2 AS c FROM events), g AS (SELECT event_type, c, count(*) AS n, avg(x) AS m FROM e GROUP BY ALL), t AS (SELECT event_type, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM e GROUP BY ALL)
SELECT g.event_type, round(sum(g.n * (g.m - t.m) ** 2) / any_value(t.n) / any_value(t.v), 9) AS ratio FROM g JOIN t USING (event_type) GROUP BY g.event_type""")
def between_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG29: variance between classes over the whole."""
    e = load(spark, sf_dir, "events").select("event_type", F.col("value").alias("x"), (F.col("user_id") % 2).alias("c"))
    g = e.groupBy("event_type", "c").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count(F.lit(1))).alias("ss"))
    w = Window.partitionBy("event_type")
    mean = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    parts = g.withColumn("b", F.col("n") * F.pow(F.col("m") - mean, F.lit(2.0)))
    return parts.groupBy("event_type").agg(F.round(F.sum("b") / (F.sum("ss") + F.sum("b")), 9).alias("ratio"))
