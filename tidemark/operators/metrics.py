"""Ranking and loss metrics with exact ties, thresholds, conformal and calibration reports.

Scores are grouped first: metrics run over distinct scores, and running totals over those are dealt out by a coarse
bucket of the score (see prefix), so that no task has all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import wilson_lower
from tidemark.operators.prefix import numbered, prior_totals


def _groups(df: DataFrame, score: str, positive: Column, weight: Column, keys: tuple[str, ...], bucket: Column) -> DataFrame:
    w = weight.cast("double")
    sums = {"pos": F.sum(F.when(positive, w).otherwise(F.lit(0.0))), "neg": F.sum(F.when(positive, F.lit(0.0)).otherwise(w))}
    own = df.groupBy(*keys, score).agg(*(c.alias(n) for n, c in sums.items()))
    return own.join(prior_totals(df, score, bucket, keys, **sums), [*keys, score])


def auc(df: DataFrame, score: str, positive: Column, weight: Column | None = None, keys: tuple[str, ...] = (), bucket: Column | None = None) -> DataFrame:
    """keys, auc: weighted share of (positive, negative) pairs with the positive scored higher, ties half; 0.5 without both."""
    g = _groups(df, score, positive, F.lit(1.0) if weight is None else weight, keys, F.floor(F.col(score) * 256) if bucket is None else bucket)
    p, q = F.sum("pos"), F.sum("neg")
    return g.groupBy(*keys).agg(F.when((p > 0) & (q > 0), F.sum(F.col("pos") * (F.col("prior_neg") + 0.5 * F.col("neg"))) / (p * q)).otherwise(F.lit(0.5)).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: Column, weight: Column | None = None, keys: tuple[str, ...] = (), bucket: Column | None = None) -> DataFrame:
    """keys, average_precision: sum over falling distinct scores of the recall step times the precision there; 0 without both classes."""
    g = _groups(df, score, positive, F.lit(1.0) if weight is None else weight, keys, F.floor(F.col(score) * 256) if bucket is None else bucket)
    totals = g.groupBy(*keys).agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tq"))
    joined = g.join(totals, list(keys)) if keys else g.crossJoin(F.broadcast(totals))  # totals is one row then
    above_p, above_q = F.col("tp") - F.col("prior_pos"), F.col("tq") - F.col("prior_neg")
    value = F.sum(F.col("pos") / F.col("tp") * above_p / F.greatest(above_p + above_q, F.lit(1e-12)))
    return joined.groupBy(*keys).agg(F.when((F.first("tp") > 0) & (F.first("tq") > 0), value).otherwise(F.lit(0.0)).alias("average_precision"))


def macro_ovo_auc(df: DataFrame, probabilities: list[str], target: str) -> DataFrame:
    """ovo_auc: mean over class pairs of the two directed AUCs; probabilities[k] is class k's."""
    k = len(probabilities)
    entries = F.array(*(F.struct(F.lit(c).alias("scored"), F.lit(o).alias("other"), F.col(probabilities[c]).alias("score")) for c in range(k) for o in range(k) if c != o))
    long = df.select(F.col(target).alias("target"), F.explode(entries).alias("x")).select("target", "x.*").where((F.col("target") == F.col("scored")) | (F.col("target") == F.col("other")))
    return auc(long, "score", F.col("target") == F.col("scored"), keys=("scored", "other")).agg(F.avg("auc").alias("ovo_auc"))


def losses(df: DataFrame, p: str, y: str) -> DataFrame:
    """log_loss, rmse, r2, accuracy of probabilities p for y in 0/1; r2 of a constant target is 1 if fitted exactly, else 0."""
    c = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    error = F.sum(F.pow(F.col(p) - F.col(y), F.lit(2.0)))
    spread = F.var_pop(y) * F.count(y)
    return df.agg(F.avg(-F.when(F.col(y) == 1, F.ln(c)).otherwise(F.ln(1 - c))).alias("log_loss"), F.sqrt(error / F.count(y)).alias("rmse"), F.when(spread > 0, 1 - error / spread).otherwise((error == 0).cast("double")).alias("r2"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"))


def conformal_quantile(df: DataFrame, score: str, alpha: float, bucket: Column) -> DataFrame:
    """q: the ceil((n + 1)(1 - alpha))-th smallest score, the largest if that is beyond n."""
    n = df.where(F.col(score).isNotNull()).count()
    at = min(math.ceil((n + 1) * (1 - alpha) - 1e-12), n)
    upto = prior_totals(df.where(F.col(score).isNotNull()), score, bucket, n=F.count(F.lit(1)))
    return upto.where(F.col("prior_n") < at).agg(F.max(score).alias("q"))


def no_arbitrage(df: DataFrame, confidence: str, correct: str, row_id: str, n_bins: int, delta: float, bucket: Column) -> DataFrame:
    """bin, n, confidence, accuracy, gap, slack of equal-count bins by confidence, ties by row_id.

    A bin ends at round-half-even((bin + 1) * n / n_bins); slack is Hoeffding's.
    """
    n = df.count()
    ends = sorted({round((k + 1) * n / n_bins) for k in range(n_bins)} - {0})
    dealt = numbered(df, [F.col(confidence), F.col(row_id)], bucket)
    which = sum((F.when(F.col("row") >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    by = dealt.withColumn("bin", which).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return by.withColumns({"gap": F.col("accuracy") - F.col("confidence"), "slack": F.sqrt(F.lit(math.log(2 / delta)) / (2 * F.col("n")))})


def operating_points(df: DataFrame, score: str, positive: Column, bucket: Column, z: float = 1.64) -> DataFrame:
    """threshold and tp, fp, recall, fpr, balanced (mean of recall and specificity), conservative_f1 of predicting score >= threshold, at every distinct score.

    Conservative F1 has the lower Wilson bound of recall and the upper one of the false positive rate.
    """
    g = _groups(df, score, positive, F.lit(1.0), (), bucket)
    totals = F.broadcast(g.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")))
    t = g.crossJoin(totals).select(F.col(score).alias("threshold"), (F.col("n_pos") - F.col("prior_pos")).alias("tp"), (F.col("n_neg") - F.col("prior_neg")).alias("fp"), "n_pos", "n_neg")
    recall, fpr = F.col("tp") / F.col("n_pos"), F.col("fp") / F.col("n_neg")
    low = wilson_lower(F.col("tp"), F.col("n_pos"), z)
    high = 1 - wilson_lower(F.col("n_neg") - F.col("fp"), F.col("n_neg"), z)
    tp, fp = low * F.col("n_pos"), high * F.col("n_neg")
    return t.withColumns({"recall": recall, "fpr": fpr, "balanced": (recall + 1 - fpr) / 2, "conservative_f1": 2 * tp / (tp + fp + F.col("n_pos"))})


def average_ranks(df: DataFrame, task: str, model: str, score: str) -> DataFrame:
    """model, average_rank, wins: ranks within tasks by falling score, ties sharing their mean rank."""
    w = Window.partitionBy(task)
    rank = F.rank().over(w.orderBy(F.desc(score))) + (F.count(F.lit(1)).over(Window.partitionBy(task, score)) - 1) / 2.0
    return df.select(model, rank.alias("r")).groupBy(model).agg(F.avg("r").alias("average_rank"), F.sum((F.col("r") == 1).cast("long")).alias("wins"))


def paired_delta(df: DataFrame, task: str, a: str, b: str, z: float = 1.959964) -> DataFrame:
    """tasks, delta, low, high: mean over tasks of the mean difference a - b in each, with a normal interval."""
    per = df.groupBy(task).agg(F.avg(F.col(a) - F.col(b)).alias("d"))
    half = z * F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(F.count("d"))
    return per.agg(F.count("d").alias("tasks"), F.avg("d").alias("delta"), (F.avg("d") - half).alias("low"), (F.avg("d") + half).alias("high"))


def jackknife_lower(df: DataFrame, block: str, gain: str, z: float = 1.2815515594600038) -> DataFrame:
    """blocks, gain, low: the mean gain less z standard errors, each from leaving out one block."""
    per = df.groupBy(block).agg(F.sum(gain).alias("s"), F.count(gain).alias("n"))
    total = F.broadcast(per.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("k")))
    left = per.crossJoin(total).withColumn("m", (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")))
    stats = left.agg(F.first("k").alias("blocks"), (F.first("all_s") / F.first("all_n")).alias("gain"), (F.var_pop("m") * (F.first("k") - 1)).alias("v"))
    return stats.select("blocks", "gain", (F.col("gain") - z * F.sqrt("v")).alias("low"))
