"""Evidence members, gates and searches around a base model: small driver logic over aggregates that Spark computes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import bin_right
from tidemark.operators import metrics
from tidemark.operators.prefix import prior_totals
from tidemark.operators.quantile import quantiles

#: Fixed values of the probability gate: least gains in rank and accuracy, paired z, and allowed loss in rank.
RANK_GAIN, ACCURACY_GAIN, PAIRED_Z, RANK_LOSS = 0.003, 0.005, 2.0, 0.001
#: Bits to state one literal's proof, widest conjunction, widest disjunction and exception.
PROOF_BITS, WIDEST_AND, WIDEST_OR = 0.0, 5, 8


# Class-preserving projection.


def preserve_class(base: Column, candidate: Column) -> Column:
    """A binary candidate probability kept on base's side of one half.

    A crossing one is moved between base's value and the boundary, the farther it crosses the nearer the boundary.
    """
    below, above = float(np.nextafter(0.5, 0.0)), float(np.nextafter(0.5, 1.0))
    low = F.least(base, F.lit(below))
    high = F.greatest(base, F.lit(above))
    down = low + (below - low) * F.least(F.greatest(2 * candidate - 1, F.lit(0.0)), F.lit(1.0))
    up = above + (high - above) * F.least(F.greatest(2 * candidate, F.lit(0.0)), F.lit(1.0))
    return F.when((base <= 0.5) & (candidate >= 0.5), down).when((base > 0.5) & (candidate <= 0.5), up).otherwise(candidate)


# Gates.


def probability_gate(df: DataFrame, y: str, base: str, candidate: str, fold: str) -> dict:
    """Whether a candidate probability may replace a base one for ranking and for decisions, from one table with folds.

    Rank: AUC of the class-preserving projection gains RANK_GAIN and no fold loses. Decision: accuracy gains
    ACCURACY_GAIN with paired z of PAIRED_Z, no fold has more losses than wins and at least half have more wins, AUC
    loses RANK_LOSS at most and log loss 1 / sqrt(n) at most.
    """
    rows = df.withColumn("__projected", preserve_class(F.col(base), F.col(candidate)))
    positive = F.col(y) == 1
    auc = {c: metrics.auc(rows, c, positive).first()["auc"] for c in (base, candidate, "__projected")}
    by = {c: {r[fold]: r["auc"] for r in metrics.auc(rows, c, positive, keys=(fold,)).collect()} for c in (base, candidate, "__projected")}
    right = {c: ((F.col(c) >= 0.5).cast("int") == F.col(y)) for c in (base, candidate)}
    loss = lambda c: F.avg(-F.ln(F.greatest(F.when(positive, F.col(c)).otherwise(1 - F.col(c)), F.lit(1e-300))))
    per = rows.groupBy(fold).agg(F.sum((right[candidate] & ~right[base]).cast("long")).alias("wins"), F.sum((right[base] & ~right[candidate]).cast("long")).alias("losses"), F.count(F.lit(1)).alias("n")).collect()
    total = rows.agg(loss(base).alias("base"), loss(candidate).alias("candidate")).first()
    wins, losses, n = sum(r["wins"] for r in per), sum(r["losses"] for r in per), sum(r["n"] for r in per)
    z = (wins - losses) / math.sqrt(max(wins + losses, 1))
    rank = auc["__projected"] - auc[base] >= RANK_GAIN and all(by["__projected"][f] >= by[base][f] for f in by[base])
    decision = (
        (wins - losses) / max(n, 1) >= ACCURACY_GAIN and z >= PAIRED_Z and all(r["wins"] >= r["losses"] for r in per) and 2 * sum(r["wins"] > r["losses"] for r in per) >= len(per)
        and auc[candidate] >= auc[base] - RANK_LOSS and total["candidate"] <= total["base"] + 1 / math.sqrt(max(n, 1))
    )
    return {"rank": bool(rank), "decision": bool(decision), "auc_gain": auc["__projected"] - auc[base], "wins": wins, "losses": losses, "z": z}


def fold_gate(scores: list[tuple[float, float]], least_fold: float, least_mean: float) -> bool:
    """Whether (baseline, candidate) fold scores gain least_fold in each fold and least_mean on average."""
    gains = [c - b for b, c in scores]
    return bool(gains) and min(gains) >= least_fold and sum(gains) / len(gains) >= least_mean


def null_auc_bound(counts: list[int], z: float = 1.645) -> float:
    """Largest macro pairwise AUC that random scores reach (one-sided); 1 for fewer than three classes or tiny ones."""
    if len(counts) < 3 or min(counts) < 2:
        return 1.0
    variances = [(a + b + 1) / (12 * a * b) for a, b in combinations(counts, 2)]
    return min(1.0, 0.5 + z * math.sqrt(sum(variances)) / len(variances))


# Monotone trends.


def monotone_trends(df: DataFrame, features: list[str], target: str, bins: int = 10, consistency: float = 0.8, effect: float = 0.15) -> DataFrame:
    """feature, direction, consistency, effect of features whose quantile-binned target means run one way.

    Consistency: the share of steps between neighbouring bins that go the direction; effect: the means' range over
    the target's standard deviation.
    """
    at = [k / bins for k in range(1, bins)]
    cuts = {c: [v for v in quantiles(df, c, at) if v is not None] for c in features}
    long = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), bin_right(F.col(c), sorted(set(cuts[c]))).alias("bin")) for c in features))).alias("x")).select("y", "x.*")
    means = long.groupBy("feature", "bin").agg(F.avg("y").alias("m"))
    steps = means.withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy("feature").orderBy("bin")))
    sd = F.broadcast(df.agg(F.stddev_pop(F.col(target).cast("double")).alias("sd")))  # one row
    per = steps.groupBy("feature").agg(F.sum((F.col("d") > 0).cast("int")).alias("up"), F.sum((F.col("d") < 0).cast("int")).alias("down"), F.count("d").alias("k"), (F.max("m") - F.min("m")).alias("range")).crossJoin(sd)
    out = per.select("feature", F.when(F.col("up") > F.col("down"), 1).otherwise(-1).alias("direction"), (F.greatest("up", "down") / F.col("k")).alias("consistency"), (F.col("range") / F.col("sd")).alias("effect"))
    return out.where((F.col("consistency") >= consistency) & (F.col("effect") >= effect))


# Leaves.


def ridge_leaves(df: DataFrame, leaf: str, features: list[str], target: str, weight: Column, lam: float = 1.0, lam_const: float = 1.0) -> dict[int, tuple[float, dict[str, float], dict[str, tuple[float, float]]]]:
    """leaf -> (intercept, coefficients, clamps): weighted ridge in each leaf over standardized features, from moment sums.

    The intercept is penalized like a constant leaf's mean, so without features the constant leaf results. Features
    that do not vary in a leaf are left out; values are clamped to the leaf's range before use.
    """
    m = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y, w, k = F.col(target).cast("double"), weight.cast("double"), len(features) + 1
    sums = [F.sum(w * m[i] * m[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * m[i] * y).alias(f"v_{i}") for i in range(k)]
    rows = df.groupBy(leaf).agg(*sums, *(f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    out = {}
    for r in rows:
        gram = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        v = np.array([r[f"v_{i}"] for i in range(k)])
        n = gram[0, 0]
        mu = gram[0, 1:] / n
        sd = np.sqrt(np.maximum(np.diag(gram)[1:] / n - mu**2, 0))
        good = np.flatnonzero(sd > 1e-9)
        t = np.zeros((len(good) + 1, k))  # standardized features from raw ones
        t[0, 0] = 1
        for a, g in enumerate(good, 1):
            t[a, g + 1], t[a, 0] = 1 / sd[g], -mu[g] / sd[g]
        beta = np.linalg.solve(t @ gram @ t.T + np.diag([lam_const, *[lam] * len(good)]), t @ v)
        raw = beta @ t
        names = [features[g] for g in good]
        out[r[leaf]] = (float(raw[0]), {c: float(raw[1 + features.index(c)]) for c in names}, {c: (float(r[f"lo_{c}"]), float(r[f"hi_{c}"])) for c in names})
    return out


def honest_leaves(df: DataFrame, leaf: str, g: Column, h: Column, structure: Column, lam: float = 1.0) -> DataFrame:
    """leaf, value = -G / (H + lam) from rows that did not shape the tree."""
    return df.where(~structure).groupBy(leaf).agg((-F.sum(g) / (F.sum(h) + lam)).alias("value"))


def pair_newton(pa: Column, pb: Column, ta: Column, tb: Column, weight: Column) -> tuple[Column, Column]:
    """Gradient and curvature of softmax log loss along score[a] - score[b]."""
    return weight * ((pa - ta) - (pb - tb)), F.greatest(weight * (pa + pb - (pa - pb) * (pa - pb)), F.lit(0.0))


# Symbolic programs.


def description_bits(kind: str, widths: tuple[int, ...], columns: int) -> float:
    """Bits to state an "and" (one width), "dnf" (two), "recursive" (three) or "exception" (base and one or two) program."""
    n = sum(widths)
    literal = math.log2(max(2, columns)) + 1 + PROOF_BITS
    widest = WIDEST_AND if kind == "and" else WIDEST_OR
    places = 1 if kind == "and" else max(2, (n - 1) if len(widths) == 2 else (n - 1) * (n - 2) // 2)
    return {"and": 1.0, "dnf": 2.0, "recursive": 3.0, "exception": 3.0}[kind] + math.log2(max(2, widest)) + (math.log2(places) if kind != "and" else 0.0) + n * literal


def conjunction_search(df: DataFrame, bits: list[str], y: str, beam: int = 24, widest: int = WIDEST_AND, least_bits: float = 2.0, most: int = 6) -> list[tuple[tuple[tuple[str, int], ...], float]]:
    """Signed conjunctions of bits that shorten the target's code by least_bits beyond their own statement, best first.

    A beam over widths; each width is one aggregate over all candidates' counts. Gain: null code length less that of
    the rows inside and outside (Jeffreys mixture).
    """
    def code(p: float, n: float) -> float:
        return -(math.lgamma(p + 0.5) + math.lgamma(n + 0.5) - math.lgamma(p + n + 1) - math.log(math.pi)) / math.log(2)

    target = F.col(y).cast("double")
    literals = [(b, v) for b in bits for v in (1, 0)]
    now: list[tuple[tuple[str, int], ...]] = [(x,) for x in literals]
    found: dict[tuple, float] = {}
    for width in range(1, widest + 1):
        if not now:
            break
        sums = []
        for k, c in enumerate(now):
            mask = F.lit(True)
            for b, v in c:
                mask = mask & (F.col(b) == v)
            sums += [F.sum(F.when(mask, target).otherwise(0.0)).alias(f"p{k}"), F.sum(F.when(mask, 1 - target).otherwise(0.0)).alias(f"n{k}")]
        row = df.agg(F.sum(target).alias("P"), F.sum(1 - target).alias("N"), *sums).first()
        p, n = row["P"] or 0.0, row["N"] or 0.0
        gains = [code(p, n) - code(row[f"p{k}"], row[f"n{k}"]) - code(p - row[f"p{k}"], n - row[f"n{k}"]) for k in range(len(now))] if p + n else [0.0] * len(now)
        scored = sorted(((gains[k] - description_bits("and", (width,), len(bits)), c) for k, c in enumerate(now)), key=lambda x: (-round(x[0], 6), x[1]))
        found |= {c: s for s, c in scored if s >= least_bits}
        best = [c for _, c in scored[:beam]]
        now = sorted({tuple(sorted((*c, x))) for c in best for x in literals if x[0] not in {b for b, _ in c}})
    return sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:most]


def rare_grid(df: DataFrame, x: str, event: Column, most: int = 24, exact: int = 16) -> list[float]:
    """Thresholds between values: all midpoints if there are few, else the two next to pooled and event quantiles."""
    values = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v"))
    few = [r["v"] for r in values.distinct().orderBy("v").limit(exact + 2).collect()]
    if len(few) <= exact + 1:
        return [(a + b) / 2 for a, b in zip(few, few[1:], strict=False)]
    pooled = [(k + 1) / 15 for k in range(14)]
    own = [(k + 1) / 8 for k in range(7)]
    proposed = quantiles(df, x, pooled) + quantiles(df.where(event), x, own)
    cuts: set[float] = set()
    for q in sorted({v for v in proposed if v is not None}):
        around = values.agg(F.max(F.when(F.col("v") < q, F.col("v"))).alias("lo"), F.min(F.when(F.col("v") >= q, F.col("v"))).alias("at"), F.min(F.when(F.col("v") > q, F.col("v"))).alias("hi")).first()
        if around["lo"] is not None and around["at"] is not None:
            cuts.add((around["lo"] + around["at"]) / 2)
        if around["hi"] is not None and around["at"] is not None and around["at"] < around["hi"]:
            cuts.add((around["at"] + around["hi"]) / 2)
    out = sorted(cuts)
    return out if len(out) <= most else [out[i] for i in sorted({int(v) for v in np.linspace(0, len(out) - 1, most)})]


# Search over configurations.


def halving(candidates: list, score: Callable[[object, int], list[float]], budgets: list[int], base: int = 0) -> tuple[int, dict[int, list[float]]]:
    """(winner, last block scores): half of the candidates go on at each budget, ranked by median paired gain over base.

    The base and the best mean always go on; from the second budget on, candidates that another one matches or beats on
    every block go. Scores are lists of paired block scores, larger is better.
    """
    alive, scores = list(range(len(candidates))), {}
    for k, budget in enumerate(budgets):
        now = {i: score(candidates[i], budget) for i in alive}
        scores |= now
        if k + 1 == len(budgets):
            break
        gain = {i: float(np.median(np.subtract(now[i], now[base]))) for i in alive}
        if k:
            gone = {i for i in alive if i != base and any(j != i and all(b >= a for a, b in zip(now[i], now[j], strict=True)) and any(b > a for a, b in zip(now[i], now[j], strict=True)) for j in alive)}
            alive = [i for i in alive if i not in gone]
        leader = max(alive, key=lambda i: (np.mean(now[i]), -i))
        ranked = sorted(alive, key=lambda i: (-gain[i], i))[: max(1, (len(alive) + 1) // 2)]
        alive = sorted({*ranked, leader, base})
    return max(alive, key=lambda i: (np.mean(scores[i]), -i)), scores


def latin_hypercube(samples: int, dimensions: int, seed: int = 0) -> np.ndarray:
    """Midpoints of a Latin hypercube: each column visits every stratum once."""
    rng = np.random.default_rng(seed)
    return np.stack([(rng.permutation(samples) + 0.5) / samples for _ in range(dimensions)], axis=1)


def normal_scenarios(samples: int, dimensions: int, seed: int = 0) -> np.ndarray:
    """Standard normal draws whose every margin is one draw a stratum: the Latin hypercube through the inverse distribution."""
    inverse = NormalDist().inv_cdf
    return np.vectorize(inverse, otypes=[float])(latin_hypercube(samples, dimensions, seed)) if samples else np.zeros((0, dimensions))


# Adapters.


def ordinal_probabilities(cumulative: list[Column]) -> list[Column]:
    """Class probabilities from P(y > 0), P(y > 1), ...: differences, not below 0, renormalized."""
    edges = [F.lit(1.0), *cumulative, F.lit(0.0)]
    parts = [F.greatest(a - b, F.lit(0.0)) for a, b in zip(edges, edges[1:], strict=False)]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def logit_member(df: DataFrame, features: list[str], target: str, strength: float = 0.03, rounds: int = 500):
    """(intercept, coefficients by feature): L2 logistic regression on standardized features, folded back to raw ones."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = df.count()
    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(df.withColumn("__label", F.col(target).cast("double")))
    fitted = LogisticRegression(featuresCol="__x", labelCol="__label", regParam=1 / (strength * max(n, 1)), maxIter=rounds, standardization=True).fit(rows)
    return float(fitted.intercept), dict(zip(features, map(float, fitted.coefficients), strict=True))


def ranks(df: DataFrame, value: str, block: Column) -> DataFrame:
    """value, rank: rows with a smaller value; block deals the running count out."""
    return prior_totals(df, value, block, n=F.count(F.lit(1))).select(value, F.col("prior_n").alias("rank"))


# Screens.


def focus_groups(ranked: list, limit: int) -> list:
    """Of a list by falling signal: the first half of the limit from its top, the others evenly spaced over the rest, in order."""
    if len(ranked) <= limit:
        return list(ranked)
    top = (limit + 1) // 2
    rest, more = ranked[top:], limit - top
    spaced = sorted({int(x) for x in np.linspace(0, len(rest) - 1, more)}) if more else []
    return [*ranked[:top], *(rest[i] for i in spaced)]


def screened_bits(df: DataFrame, bits: list[str], y: str, limit: int | None = None) -> list[str]:
    """Binary columns to search over: three quarters of the limit by association with y, the others by a hash of their names.

    The limit is the root of 75 million over the rows, 512 at most and one at least, unless given. Association: half the
    difference of y's mean inside and outside the column; one aggregate over all columns.
    """
    target = F.col(y).cast("double")
    inside = [F.avg(F.when(F.col(b) == 1, target)) - F.avg(F.when(F.col(b) == 0, target)) for b in bits]
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.abs(x) / 2, F.lit(0.0)).alias(f"a{k}") for k, x in enumerate(inside))).first()
    most = max(1, min(512, int(math.sqrt(75e6 / max(row["n"], 1))))) if limit is None else limit
    if len(bits) <= most:
        return list(bits)
    ranked = sorted(range(len(bits)), key=lambda k: (-round(row[f"a{k}"], 12), bits[k]))
    strongest = ranked[: (3 * most + 3) // 4]
    others = sorted(set(ranked) - set(strongest), key=lambda k: hashlib.md5(bits[k].encode()).hexdigest())
    return [bits[k] for k in sorted([*strongest, *others[: most - len(strongest)]])]
