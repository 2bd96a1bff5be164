"""Queries of fitted preprocessing, path evidence, interval posteriors, stacks, windows and outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import evidence as V
from tidemark.operators import members as M
from tidemark.operators.preprocess import Preprocessor
from tidemark.operators.quantile import quantiles
from tidemark.plans.registry import load, query


@query("""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders), f AS (SELECT * FROM o WHERE o_orderkey % 2 = 0), k AS (SELECT o_custkey, count(*) / (SELECT count(*) FROM f)::DOUBLE AS share FROM f GROUP BY 1)
SELECT o.o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM f)), 6) AS price, (price IS NULL)::INT::DOUBLE AS missing, (o_orderstatus = 'O')::INT::DOUBLE AS open, round(coalesce(share, 0), 9) AS customer FROM o LEFT JOIN k ON k.o_custkey = o.o_custkey WHERE o.o_orderkey % 2 = 1""")
def fitted_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF9-PF11: parameters from even orders, applied to odd ones."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"), "o_orderstatus", F.col("o_custkey").cast("string").alias("customer"))
    fitted = Preprocessor().fit(o.where("o_orderkey % 2 = 0"), ["price", "o_orderstatus", "customer"])
    out = fitted.transform(o.where("o_orderkey % 2 = 1"), ["o_orderkey"])
    return out.select("o_orderkey", F.round("price", 6).alias("price"), F.col("price__isna").alias("missing"), F.col("`o_orderstatus=O`").alias("open"), F.round("customer__freq", 9).alias("customer"))


_LEAVES = "l AS (SELECT event_id AS id, (value > 30)::INT || '' AS n1, (value > 30)::INT || '/' || (user_id % 3) AS n2, (value > 30)::INT || '/' || (user_id % 3) || '/' || event_type AS n3, (event_id % 4 = 0)::INT AS y FROM events)"


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, mid = (F.col("value") > 30).cast("int").cast("string"), (F.col("user_id") % 3).cast("string")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), top.alias("n1"), F.concat(top, F.lit("/"), mid).alias("n2"), F.concat(top, F.lit("/"), mid, F.lit("/"), "event_type").alias("n3"), (F.col("event_id") % 4 == 0).cast("int").alias("y"))


@query(f"""WITH {_LEAVES}, p AS (SELECT avg(y) AS p0 FROM l), a AS (SELECT n1, (sum(y) + 2 * any_value(p0)) / (count(*) + 2.0) AS p1 FROM l, p GROUP BY n1), b AS (SELECT n2, (sum(y) + 2 * any_value(p1)) / (count(*) + 2.0) AS p2 FROM l JOIN a USING (n1) GROUP BY n2)
SELECT n3, round((sum(y) + 2 * any_value(p2)) / (count(*) + 2.0), 9) AS posterior, count(*) AS n FROM l JOIN b USING (n2) GROUP BY n3""")
def path_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21, ML16: posteriors down a tree path, each with its parent's as prior."""
    rows = _leaves(spark, sf_dir)
    counts = rows.groupBy("n1", "n2", "n3").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg((F.sum("s") / F.sum("n")).alias("p0")))
    w = lambda c: Window.partitionBy(c)
    rate = lambda c, parent: (F.sum("s").over(w(c)) + 2 * F.col(parent)) / (F.sum("n").over(w(c)) + 2)
    down = counts.crossJoin(total).withColumn("p1", rate("n1", "p0")).withColumn("p2", rate("n2", "p1"))
    return down.where("n2 is not null").select("n3", F.round((F.col("s") + 2 * F.col("p2")) / (F.col("n") + 2), 9).alias("posterior"), "n")


@query(f"""WITH {_LEAVES}, f AS (SELECT id, unnest(['n1=' || n1, 'n2=' || n2, 'n3=' || n3]) AS fact FROM l), w AS (SELECT fact, ln(1 + (SELECT count(*) FROM l) / count(*)::DOUBLE) AS w FROM f GROUP BY fact),
s AS (SELECT a.id AS query, b.id AS row, sum(w) AS score FROM f a JOIN w USING (fact) JOIN f b USING (fact) WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, row) AS rank FROM s) SELECT query, row, rank::INT AS rank FROM r WHERE rank <= 3""")
def path_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN18: for every event with an id divisible by 20, the events that share most of its tree path."""
    rows = _leaves(spark, sf_dir)
    return V.overlap_scores(rows.where("id % 20 = 0"), rows, ["n1", "n2", "n3"], 3).select("query", "row", "rank")


@query("""
WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS c FROM events), b AS (SELECT (value >= c[1])::INT + (value >= c[2])::INT + (value >= c[3])::INT AS bin, (event_id % 5 = 0)::INT AS y FROM events, q), p AS (SELECT avg(y) AS p FROM b)
SELECT bin, count(*) AS n, round((sum(y) + 2 * any_value(p)) / (count(*) + 2), 9) AS posterior FROM b, p GROUP BY bin""")
def interval_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML18: smoothed class rates by quantile interval; a value on a cut goes up."""
    e = load(spark, sf_dir, "events").select("value", (F.col("event_id") % 5 == 0).cast("int").alias("y"))
    cuts = quantiles(e, "value", [0.25, 0.5, 0.75])
    by = e.groupBy(X.bin_right(F.col("value"), cuts).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    prior = F.broadcast(by.agg((F.sum("s") / F.sum("n")).alias("p")))
    return by.crossJoin(prior).select("bin", "n", F.round((F.col("s") + 2 * F.col("p")) / (F.col("n") + 2), 9).alias("posterior"))


@query("""
WITH s AS (SELECT event_id, 1 / (1 + exp(-(value - 50) / 50 / 1.5)) AS b, CASE WHEN event_type = 'view' THEN 0.7 ELSE 0.4 END AS e FROM events),
c AS (SELECT event_id, b, b * pow(e / 0.5, 0.5) / (b * pow(e / 0.5, 0.5) + (1 - b) * pow((1 - e) / 0.5, 0.5)) AS c FROM s),
r AS (SELECT event_id, CASE WHEN b <= 0.5 AND c >= 0.5 THEN least(b, 0.5) + (0.5 - least(b, 0.5)) * (2 * c - 1) WHEN b > 0.5 AND c <= 0.5 THEN 0.5 + (b - 0.5) * 2 * c ELSE c END AS p FROM c)
SELECT event_id, round(p, 6) AS rank_proba, round(p * sqrt(0.5) / (p * sqrt(0.5) + (1 - p) * sqrt(1.5)), 6) AS calibrated FROM r""")
def probability_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML26: temperature, evidence, class-preserving projection and prior shift in one projection."""
    base = X.logistic((F.col("value") - 50) / 50 / 1.5)
    expert = F.when(F.col("event_type") == "view", 0.7).otherwise(0.4)
    rows = load(spark, sf_dir, "events").select("event_id", base.alias("b"), expert.alias("e"))
    z = [F.ln(p) + 0.5 * (F.ln(q) - F.ln(F.lit(0.5))) for p, q in ((1 - F.col("b"), 1 - F.col("e")), (F.col("b"), F.col("e")))]
    ranked = rows.select("event_id", M.preserve_class(F.col("b"), X.softmax(z)[1]).alias("p"))
    return ranked.select("event_id", F.round("p", 6).alias("rank_proba"), F.round(X.prior_shift([1 - F.col("p"), F.col("p")], [0.5, 0.5], [0.75, 0.25], 0.5)[1], 6).alias("calibrated"))


@query("""
WITH l AS (SELECT (event_id // 2500)::INT AS round, event_type, -ln(greatest(1 / (1 + exp(-(value - 50) / 50)), 1e-15)) AS loss, 1.0 + user_id % 3 AS w FROM events),
m AS (SELECT round, event_type, sum(w * loss) / sum(w) AS mean, sqrt((sum(w * loss * loss) / sum(w) - (sum(w * loss) / sum(w)) ** 2) * sum(w * w)) / sum(w) AS se FROM l GROUP BY ALL)
SELECT round, event_type, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - lag(mean) OVER (PARTITION BY event_type ORDER BY round), 6) AS change FROM m""")
def loss_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML50: weighted class losses with standard errors, and their change from round to round."""
    p = X.logistic((F.col("value") - 50) / 50)
    rows = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2500).cast("int").alias("round"), "event_type", (-F.ln(F.greatest(p, F.lit(1e-15)))).alias("loss"), (1.0 + F.col("user_id") % 3).alias("w"))
    mean = F.sum(F.col("w") * F.col("loss")) / F.sum("w")
    spread = F.sum(F.col("w") * F.col("loss") * F.col("loss")) / F.sum("w") - mean * mean
    m = rows.groupBy("round", "event_type").agg(mean.alias("mean"), (F.sqrt(spread * F.sum(F.col("w") * F.col("w"))) / F.sum("w")).alias("se"))
    change = F.col("mean") - F.lag("mean").over(Window.partitionBy("event_type").orderBy("round"))
    return m.select("round", "event_type", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round(change, 6).alias("change"))


@query("""
WITH t AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, (l_returnflag = 'R')::INT AS y FROM lineitem), u AS (SELECT 'q' AS feature, q AS v, y FROM t UNION ALL SELECT 'd', d, y FROM t UNION ALL SELECT 't', t, y FROM t)
SELECT feature, round(abs(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / stddev_pop(v), 6) AS separation FROM u GROUP BY feature""")
def wide_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL7: how far class means of each column stand apart, from one aggregate."""
    t = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), (F.col("l_returnflag") == "R").alias("y"))
    one = lambda c: F.struct(F.lit(c).alias("feature"), (F.abs(F.avg(F.when(F.col("y"), F.col(c))) - F.avg(F.when(~F.col("y"), F.col(c)))) / F.stddev_pop(c)).alias("separation"))
    return t.agg(F.array(*(one(c) for c in "qdt")).alias("a")).select(F.explode("a").alias("x")).select("x.feature", F.round("x.separation", 6).alias("separation"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN24: a field of JSON text."""
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT vec_id, len(embedding)::INT AS n, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(list_filter(embedding, lambda x: x > 0))::INT AS positive FROM embeddings")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN23: functions over arrays."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.round(F.sqrt(square), 6).alias("norm"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: counts and sums in windows of six hours."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_micros("w.start").alias("start_us"), "n", "total")


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT user_id, us, sum(CASE WHEN before IS NULL OR us - before >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: sessions that end after two quiet hours."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000) SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS rich, b.k IS NOT NULL AS big FROM a FULL JOIN b ON a.k = b.k")
def outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20, JN21: a full outer join; the strategy is the optimizer's."""
    a = load(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("a"))
    b = load(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("k"), F.col("a").isNotNull().alias("rich"), F.col("b").isNotNull().alias("big"))
