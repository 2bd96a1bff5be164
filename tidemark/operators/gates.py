"""Whether event history earns its place: a candidate feature set against a baseline over future windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import logistic
from tidemark.operators import boost, metrics, splits

#: Fixed values of the temporal gate: least gain in AUC (average precision), allowed loss of accuracy (of AUC), gain that needs no bound.
GAIN, GAIN_RARE, LOSS, CLEAR, CLEAR_RARE = 0.0005, 0.001, 0.002, 0.005, 0.01
#: Share of the rarer class up to which average precision is the metric.
RARE = 0.10


@dataclass
class Verdict:
    """metric, gain on the whole future, gains by window, the lower bound, and whether the candidate is admitted."""

    metric: str
    gain: float
    windows: list[float]
    lower: float
    selected: bool


def temporal_gate(df: DataFrame, order: str, block: Column, target: str, baseline: list[str], candidate: list[str], holdout: float = 0.3, windows: int = 3, rounds: int = 12) -> Verdict:
    """Fits both feature sets on the past, scores the future, and admits the candidate by gain, safeguards and consistency.

    Admitted: practical gain; accuracy (or AUC, for a rare class) not lost; a strict majority of at least two windows
    gains and is safe; no window loses twice the safeguard; and either a block jackknife bound of the gain in squared
    error is above 0 or the gain is clear by itself. target is 0/1.
    """
    cut = splits.future_cut(df, order, block, holdout).first()["cut"]
    past, future = df.where(F.col(order) < cut), df.where(F.col(order) >= cut)
    share = past.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    rare = min(share, 1 - share) <= RARE
    scored = future
    for name, features in (("__b", baseline), ("__c", baseline + candidate)):
        model = boost.fit(past, features, target, "binary", rounds=rounds)
        scored = scored.withColumn(name, logistic(model.scores()[0]))
    parts = splits.atomic_parts(future, order, windows, block).withColumnRenamed(order, "__at")
    scored = scored.join(parts, F.col(order) == F.col("__at")).drop("__at")
    positive = F.col(target) == 1
    measure, column = (metrics.average_precision, "average_precision") if rare else (metrics.auc, "auc")

    def both(f, c: str) -> tuple[dict, float]:
        of = {n: {r["part"]: r[c] for r in f(scored, n, positive, keys=("part",)).collect()} for n in ("__b", "__c")}
        whole = {n: f(scored, n, positive).first()[c] for n in ("__b", "__c")}
        return {k: of["__c"][k] - of["__b"][k] for k in sorted(of["__b"])}, whole["__c"] - whole["__b"]

    gains, gain = both(measure, column)
    if rare:
        second, second_whole = both(metrics.auc, "auc")
    else:
        hit = {n: ((F.col(n) >= 0.5).cast("int") == F.col(target)).cast("double") for n in ("__b", "__c")}
        second = {r["part"]: r["d"] for r in scored.groupBy("part").agg(F.avg(hit["__c"] - hit["__b"]).alias("d")).collect()}
        second_whole = scored.agg(F.avg(hit["__c"] - hit["__b"])).first()[0]
    y = F.col(target).cast("double")
    better = scored.select(order, (F.pow(F.col("__b") - y, F.lit(2.0)) - F.pow(F.col("__c") - y, F.lit(2.0))).alias("__gain"))
    lower = metrics.jackknife_lower(better, order, "__gain").first()["low"]
    wins = sum(g > 0 and second[k] >= -LOSS for k, g in gains.items())
    least, clear = (GAIN_RARE, CLEAR_RARE) if rare else (GAIN, CLEAR)
    selected = gain >= least and second_whole >= -LOSS and len(gains) >= 2 and wins >= len(gains) // 2 + 1 and all(d >= -2 * LOSS for d in second.values()) and (lower > 0 or gain >= clear)
    return Verdict(column, gain, list(gains.values()), lower, bool(selected))
