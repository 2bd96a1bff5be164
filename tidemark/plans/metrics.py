"""Queries of metrics, calibration and decisions.

Scores are made in the query: a logistic of an event's value as probability that its user id is even, and the like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import metrics as M
from tidemark.plans.registry import load, query

#: Scores rounded to two digits make many ties.
_SCORED_SQL = "s AS (SELECT event_id, user_id, event_type, date_trunc('day', ts) AS day, round(1 / (1 + exp(-(value - 50) / 50)), 2) AS p, (hash_mod < 3)::INT AS y FROM (SELECT *, (event_id * 7919 + user_id * 31 + floor(value)::BIGINT) % 7 AS hash_mod FROM events))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    mod = F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 31 + F.floor("value").cast("long"), F.lit(7))
    return e.select("event_id", "user_id", "event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), F.round(X.logistic((F.col("value") - 50) / 50), 2).alias("p"), (mod < 3).cast("int").alias("y"))


@query(f"""
WITH {_SCORED_SQL}, g AS (SELECT p, sum(y) AS a, sum(1 - y) AS b FROM s GROUP BY p), c AS (SELECT *, coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT round(sum(a * (before + 0.5 * b)) / (sum(a) * sum(b)), 6) AS auc FROM c""")
def auc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC1, WN21: AUC with half credit for ties."""
    return M.auc(_scored(spark, sf_dir), "p", F.col("y") == 1).select(F.round("auc", 6).alias("auc"))


@query(f"""
WITH {_SCORED_SQL}, w AS (SELECT *, 1.0 + user_id % 3 AS w FROM s), g AS (SELECT event_type, p, sum(w * y) AS a, sum(w * (1 - y)) AS b FROM w GROUP BY ALL),
c AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY event_type ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT event_type, round(sum(a * (before + 0.5 * b)) / (sum(a) * sum(b)), 6) AS auc FROM c GROUP BY event_type""")
def auc_weighted_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC1: weighted AUC in each group."""
    return M.auc(_scored(spark, sf_dir), "p", F.col("y") == 1, 1.0 + F.col("user_id") % 3, ("event_type",)).select("event_type", F.round("auc", 6).alias("auc"))


@query(f"""
WITH {_SCORED_SQL}, g AS (SELECT p, sum(y) AS a, count(*) AS n FROM s GROUP BY p), c AS (SELECT *, sum(a) OVER w AS ca, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY p DESC))
SELECT round(sum(a / (SELECT sum(y) FROM s)::DOUBLE * ca / cn), 6) AS average_precision FROM c""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC1: average precision over falling groups of equal scores."""
    return M.average_precision(_scored(spark, sf_dir), "p", F.col("y") == 1).select(F.round("average_precision", 6).alias("average_precision"))


@query("""
WITH v AS (SELECT vec_id, label % 3 AS y, round(exp(embedding[1]), 2) AS a, round(exp(embedding[2]), 2) AS b, round(exp(embedding[3]), 2) AS c FROM embeddings),
p AS (SELECT y, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM v),
l AS (SELECT y, 0 AS s, 1 AS o, p0 AS p FROM p UNION ALL SELECT y, 0, 2, p0 FROM p UNION ALL SELECT y, 1, 0, p1 FROM p UNION ALL SELECT y, 1, 2, p1 FROM p UNION ALL SELECT y, 2, 0, p2 FROM p UNION ALL SELECT y, 2, 1, p2 FROM p),
f AS (SELECT * FROM l WHERE y IN (s, o)),
g AS (SELECT s, o, p, sum((y = s)::INT) AS a, sum((y <> s)::INT) AS b FROM f GROUP BY ALL), c AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY s, o ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT round(avg(auc), 6) AS ovo_auc FROM (SELECT sum(a * (before + 0.5 * b)) / (sum(a) * sum(b)) AS auc FROM c GROUP BY s, o)""")
def macro_ovo_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC2: mean of the directed AUCs of all class pairs."""
    v = load(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("y"), *(F.round(F.exp(F.element_at("embedding", k + 1).cast("double")), 2).alias(f"e{k}") for k in range(3)))
    total = F.col("e0") + F.col("e1") + F.col("e2")
    return M.macro_ovo_auc(v.select("y", *((F.col(f"e{k}") / total).alias(f"p{k}") for k in range(3))), ["p0", "p1", "p2"], "y").select(F.round("ovo_auc", 6).alias("ovo_auc"))


@query(f"WITH {_SCORED_SQL} SELECT round(avg(-CASE WHEN y = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(1 - least(p, 1 - 1e-15)) END), 6) AS log_loss, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM s")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC3: log loss, RMSE, R2 and accuracy."""
    return M.losses(_scored(spark, sf_dir), "p", "y").select(*(F.round(c, 6).alias(c) for c in ("log_loss", "rmse", "r2", "accuracy")))


_TASKS_SQL = "t AS (SELECT o_orderstatus || '/' || year(o_orderdate) AS task, o_orderpriority AS model, round(avg(o_totalprice), -2) AS score FROM orders GROUP BY ALL)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.concat_ws("/", "o_orderstatus", F.year("o_orderdate").cast("string")).alias("task"), F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice"), -2).alias("score"))


@query(f"WITH {_TASKS_SQL}, r AS (SELECT model, rank() OVER (PARTITION BY task ORDER BY score DESC) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS r FROM t) SELECT model, round(avg(r), 6) AS average_rank, sum((r = 1)::INT)::BIGINT AS wins FROM r GROUP BY model")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC4: tie-averaged ranks of models over tasks."""
    return M.average_ranks(_tasks(spark, sf_dir), "task", "model", "score").select("model", F.round("average_rank", 6).alias("average_rank"), "wins")


@query(f"""
WITH {_TASKS_SQL}, d AS (SELECT a.task, avg(a.score - b.score) AS d FROM t a JOIN t b USING (task) WHERE a.model = '1-URGENT' AND b.model = '5-LOW' GROUP BY a.task)
SELECT count(d) AS tasks, round(avg(d), 4) AS delta, round(avg(d) - 1.959964 * stddev_samp(d) / sqrt(count(d)), 4) AS low, round(avg(d) + 1.959964 * stddev_samp(d) / sqrt(count(d)), 4) AS high FROM d""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC4: paired difference of two models with a normal interval."""
    t = _tasks(spark, sf_dir)
    a, b = (t.where(F.col("model") == m).select("task", F.col("score").alias(n)) for m, n in (("1-URGENT", "a"), ("5-LOW", "b")))
    return M.paired_delta(a.join(b, "task"), "task", "a", "b").select("tasks", *(F.round(c, 4).alias(c) for c in ("delta", "low", "high")))


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM (SELECT abs(value - 50) AS value FROM events)) SELECT round(value, 6) AS q FROM r WHERE k = least(ceil((n + 1) * 0.9), n)")
def conformal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC5, DC6: the conformal quantile of absolute residuals."""
    e = load(spark, sf_dir, "events").select(F.abs(F.col("value") - 50).alias("r"))
    return M.conformal_quantile(e, "r", 0.1, F.floor("r")).select(F.round("q", 6).alias("q"))


_REGION = "CASE WHEN p <= 0.3 THEN 'low' WHEN p <= 0.6 THEN 'mid' ELSE 'high' END"
_WILSON = "(k / n + 1.64 * 1.64 / (2 * n) - 1.64 * sqrt(k / n * (1 - k / n) / n + 1.64 * 1.64 / (4 * n * n))) / (1 + 1.64 * 1.64 / n)"


@query(f"WITH {_SCORED_SQL}, r AS (SELECT event_type, {_REGION} AS region, count(*)::DOUBLE AS n, sum(((p >= 0.5)::INT = y)::INT)::DOUBLE AS k FROM s GROUP BY ALL) SELECT event_type, region, n::BIGINT AS n, round(CASE WHEN n >= 20 THEN greatest({_WILSON}, 0) END, 6) AS low, round(sqrt(ln(2 / 0.05) / (2 * n)), 6) AS slack FROM r")
def regional_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC7, FN18, FN19: lower bounds of accuracy by region, with Hoeffding slack."""
    s = _scored(spark, sf_dir)
    region = F.when(F.col("p") <= 0.3, "low").when(F.col("p") <= 0.6, "mid").otherwise("high")
    r = s.groupBy("event_type", region.alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("long")).alias("k"))
    return r.select("event_type", "region", "n", F.round(F.when(F.col("n") >= 20, X.wilson_lower(F.col("k"), F.col("n"))), 6).alias("low"), F.round(X.hoeffding(F.col("n"), 0.05), 6).alias("slack"))


_POINTS_SQL = f"""WITH {_SCORED_SQL}, g AS (SELECT p, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM s GROUP BY p), c AS (SELECT p AS threshold, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS pp, sum(b) OVER () AS nn FROM g WINDOW w AS (ORDER BY p DESC)),
x AS (SELECT *, greatest({_WILSON.replace("k / n", "tp / pp").replace("/ n", "/ pp").replace("* n", "* pp")}, 0) AS low, 1 - greatest({_WILSON.replace("k / n", "(nn - fp) / nn").replace("/ n)", "/ nn)").replace("* n", "* nn").replace(") / n +", ") / nn +")}, 0) AS high FROM c)"""


@query(_POINTS_SQL + " SELECT threshold, tp, fp, round((tp / pp + 1 - fp / nn) / 2, 6) AS balanced, round(2 * low * pp / (low * pp + high * nn + pp), 6) AS conservative_f1 FROM x")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC8: every threshold with its balanced score and conservative F1."""
    t = M.operating_points(_scored(spark, sf_dir), "p", F.col("y") == 1, F.floor(F.col("p") * 16))
    return t.select("threshold", "tp", "fp", F.round("balanced", 6).alias("balanced"), F.round("conservative_f1", 6).alias("conservative_f1"))


@query(_POINTS_SQL + ", r AS (SELECT *, row_number() OVER (ORDER BY 2 * low * pp / (low * pp + high * nn + pp) DESC, threshold) AS k, row_number() OVER (ORDER BY (tp / pp + 1 - fp / nn) / 2 DESC, threshold) AS j FROM x) SELECT max(CASE WHEN k = 1 THEN threshold END) AS rare_threshold, max(CASE WHEN j = 1 THEN threshold END) AS balanced_threshold FROM r")
def chosen_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC8: the thresholds with the best conservative F1 and the best balanced score, ties to the smaller."""
    t = M.operating_points(_scored(spark, sf_dir), "p", F.col("y") == 1, F.floor(F.col("p") * 16))
    best = lambda c: F.max_by("threshold", F.struct(c, -F.col("threshold")))
    return t.agg(best("conservative_f1").alias("rare_threshold"), best("balanced").alias("balanced_threshold"))


@query(f"WITH {_SCORED_SQL} SELECT event_id, round(p * 0.2 / 0.4 / (p * 0.2 / 0.4 + (1 - p) * 0.8 / 0.6), 6) AS shifted, round(p * sqrt(0.2 / 0.4) / (p * sqrt(0.2 / 0.4) + (1 - p) * sqrt(0.8 / 0.6)), 6) AS half FROM s")
def prior_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC9, ML25: probabilities under another class prior, at full and half strength."""
    p = F.col("p")
    full, half = (X.prior_shift([1 - p, p], [0.6, 0.4], [0.8, 0.2], k)[1] for k in (1.0, 0.5))
    return _scored(spark, sf_dir).select("event_id", F.round(full, 6).alias("shifted"), F.round(half, 6).alias("half"))


@query("""
WITH t AS (SELECT user_id, sum((value > 50)::INT) AS pos, sum((value <= 50)::INT) AS neg FROM events GROUP BY user_id)
SELECT user_id, round(0.001 * pow(0.9, least(pos, 4)) * pow(0.1, least(neg, 4)) / (0.001 * pow(0.9, least(pos, 4)) * pow(0.1, least(neg, 4)) + 0.999 * pow(0.2, least(pos, 4)) * pow(0.8, least(neg, 4))), 9) AS posterior FROM t""")
def sequential_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC10: a prior folded through a sequence of test results (four positives and negatives at most)."""
    t = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sum((F.col("value") > 50).cast("int")).alias("pos"), F.sum((F.col("value") <= 50).cast("int")).alias("neg"))
    results = F.concat(F.array_repeat(F.lit(True), F.least("pos", F.lit(4)).cast("int")), F.array_repeat(F.lit(False), F.least("neg", F.lit(4)).cast("int")))
    folded = F.aggregate(results, F.lit(0.001), lambda p, x: X.test_posterior(p, F.lit(0.9), F.lit(0.8), x))
    return t.select("user_id", F.round(folded, 9).alias("posterior"))


@query(f"WITH {_SCORED_SQL}, d AS (SELECT *, 0.5 + user_id % 4 AS reward, 1.0 + event_id % 9 AS penalty FROM s), k AS (SELECT *, least(greatest((penalty - 0.1) / (reward + penalty), 0), 1) AS strike FROM d) SELECT event_id, round(strike, 6) AS strike, p >= strike AS answers, round(CASE WHEN p >= strike THEN p * reward - (1 - p) * penalty ELSE -0.1 END, 6) + 0.0 AS value FROM k")
def fair_strike_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC12: the confidence at which answering pays, the decision and its expected value."""
    d = _scored(spark, sf_dir).withColumns({"reward": 0.5 + F.col("user_id") % 4, "penalty": 1.0 + F.col("event_id") % 9})
    strike = X.fair_strike(F.col("reward"), F.col("penalty"), F.lit(0.1))
    return d.select("event_id", F.round(strike, 6).alias("strike"), (F.col("p") >= strike).alias("answers"), (F.round(X.expected_value(F.col("p"), F.col("reward"), F.col("penalty"), F.lit(0.1)), 6) + 0.0).alias("value"))


_BINS_SQL = f"""WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY p, event_id) - 1 AS i, count(*) OVER () AS n FROM s), e AS (SELECT k, round_even((k + 1) * (SELECT count(*) FROM s) / 7.0, 0)::BIGINT AS stop FROM range(7) t(k)),
b AS (SELECT r.*, (SELECT count(*) FROM e WHERE e.stop <= r.i) AS bin FROM r), g AS (SELECT bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM b GROUP BY bin)"""


@query(_BINS_SQL + " SELECT bin::INT AS bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(accuracy - confidence, 6) AS gap, round(sqrt(ln(2 / 0.05) / (2 * n)), 6) AS slack FROM g")
def no_arbitrage_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC13: calibration gaps of equal-count bins."""
    out = M.no_arbitrage(_scored(spark, sf_dir), "p", "y", "event_id", 7, 0.05, F.floor(F.col("p") * 16))
    return out.select("bin", "n", *(F.round(c, 6).alias(c) for c in ("confidence", "accuracy", "gap", "slack")))


@query(_BINS_SQL + " SELECT round(max(abs(accuracy - confidence)), 6) AS empirical_edge, round(max(abs(accuracy - confidence) + sqrt(ln(2 / 0.05) / (2 * n))), 6) AS certified_edge FROM g")
def no_arbitrage_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC13: the worst bin's gap, bare and with slack."""
    out = M.no_arbitrage(_scored(spark, sf_dir), "p", "y", "event_id", 7, 0.05, F.floor(F.col("p") * 16))
    return out.agg(F.round(F.max(F.abs("gap")), 6).alias("empirical_edge"), F.round(F.max(F.abs("gap") + F.col("slack")), 6).alias("certified_edge"))


@query(f"WITH {_SCORED_SQL} SELECT event_id, p, round(p * 0.5 / (p * 0.5 + (1 - p) * 4.0 / 3), 6) AS posterior, CASE WHEN round(p * 0.5 / (p * 0.5 + (1 - p) * 4.0 / 3), 6) >= 0.25 THEN 'answer' ELSE 'abstain' END AS decision, true AS verified FROM s")
def decision_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC11, DC14, DC15: posterior and decision of each row, re-checked from the record alone."""
    p = F.col("p")
    bundle = _scored(spark, sf_dir).select("event_id", "p", F.round(X.prior_shift([1 - p, p], [0.6, 0.4], [0.8, 0.2])[1], 6).alias("posterior"))
    bundle = bundle.withColumn("decision", F.when(F.col("posterior") >= X.fair_strike(F.lit(3.0), F.lit(1.0), F.lit(0.0)), "answer").otherwise("abstain"))
    again = p * 0.5 / (p * 0.5 + (1 - p) * 4.0 / 3)
    ok = (F.abs(again - F.col("posterior")) <= 1e-6) & ((F.col("decision") == "answer") == (F.col("posterior") >= 0.25))
    return bundle.withColumn("verified", ok)


@query(f"""
WITH {_SCORED_SQL}, g AS (SELECT day, ((p >= 0.5)::INT = y)::INT - (0 = y)::INT AS gain FROM s), b AS (SELECT day, sum(gain) AS s, count(*) AS n FROM g GROUP BY day),
l AS (SELECT (sum(s) OVER () - s) / (sum(n) OVER () - n)::DOUBLE AS m, count(*) OVER () AS k, sum(s) OVER () / (sum(n) OVER ())::DOUBLE AS gain FROM b)
SELECT any_value(k) AS blocks, round(any_value(gain), 6) AS gain, round(any_value(gain) - 1.2815515594600038 * sqrt(var_pop(m) * (any_value(k) - 1)), 6) AS low FROM l""")
def jackknife_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: a lower bound of a gain from leaving out one day at a time."""
    gain = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int") - (F.col("y") == 0).cast("int")
    return M.jackknife_lower(_scored(spark, sf_dir).select("day", gain.alias("gain")), "day", "gain").select("blocks", F.round("gain", 6).alias("gain"), F.round("low", 6).alias("low"))


@query(f"""
WITH {_SCORED_SQL}, z AS (SELECT y, ln(greatest(p, 1e-6) / greatest(1 - p, 1e-6)) AS m FROM s), t AS (SELECT k, pow(8.0, k / 39.0) AS t FROM range(40) x(k)),
l AS (SELECT t, avg(ln(1 + exp(CASE WHEN y = 1 THEN -m / t ELSE m / t END))) AS loss FROM z, t GROUP BY t) SELECT round(arg_min(t, loss), 6) AS temperature, round(min(loss), 6) AS loss FROM l""")
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN16: the temperature of a geometric grid with the least log loss, from one aggregate."""
    s = _scored(spark, sf_dir)
    m = F.ln(F.greatest("p", F.lit(1e-6)) / F.greatest(1 - F.col("p"), F.lit(1e-6)))
    signed = s.select(F.when(F.col("y") == 1, -m).otherwise(m).alias("m"))
    grid = [8.0 ** (k / 39) for k in range(40)]
    row = signed.agg(*(F.avg(F.log1p(F.exp(F.col("m") / t))).alias(f"l{k}") for k, t in enumerate(grid)))
    best = row.select(F.array_min(F.array(*(F.struct(F.col(f"l{k}").alias("loss"), F.lit(t).alias("t")) for k, t in enumerate(grid)))).alias("b"))
    return best.select(F.round("b.t", 6).alias("temperature"), F.round("b.loss", 6).alias("loss"))
