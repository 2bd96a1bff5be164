"""Causal history: what an entity's strictly earlier events say, with equal timestamps seeing the same past.

Times are microseconds (long). Every operator first collapses an entity's equal timestamps into one batch and joins
results back through (entity, time), so rows of one batch get equal values, all taken from earlier batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import prior_totals
from tidemark.operators.quantile import quantiles

MICROS = 1_000_000.0


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def collapse_ties(df: DataFrame, keys: list[str], order: str, **aggregates: Column) -> DataFrame:
    """One row for each (keys, order)."""
    return df.groupBy(*keys, order).agg(*(c.alias(name) for name, c in aggregates.items()))


def normalized_mark(value: Column, scale: float, bound: float = 8.0) -> Column:
    """value / scale clipped to +-bound; null and non-finite values are 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.least(F.greatest(value / F.lit(scale), F.lit(-bound)), F.lit(bound))).otherwise(F.lit(0.0))


def mark_scale(df: DataFrame, value: str) -> float:
    """Median of the absolute finite values other than zero; 1 if there are none."""
    v = F.abs(F.col(value).cast("double"))
    found = quantiles(df.select(v.alias("v")).where((F.col("v") > 0) & (F.col("v") < float("inf"))), "v", [0.5])[0]
    return found or 1.0


#: A block holds so many of its longest scale, and no more than so many of its shortest; scales that share blocks are
#: within this ratio. Blocks that ended further back than SPAN scales weigh under 1e-27 and are not looked at.
BLOCK_SCALES, MOST_SCALES, RATIO, SPAN = 8.0, 500.0, 32.0, 64.0


def _groups(taus: dict[str, float]) -> list[dict[str, float]]:
    """Scales in ascending groups whose ratio is RATIO at most."""
    out: list[dict[str, float]] = []
    for name, tau in sorted(taus.items(), key=lambda x: x[1]):
        if out and tau <= RATIO * next(iter(out[-1].values())):
            out[-1][name] = tau
        else:
            out.append({name: tau})
    return out


def _running(batches: DataFrame, entity: str, order: str, weights: list[str], taus: dict[str, float], block: int | None) -> DataFrame:
    """entity, order and <weight>_<scale>: sums over strictly earlier batches of weight * exp(-age / tau), age and tau in units of order.

    An entity's line is cut into blocks. Within one, weights grown by exp(place / tau) are added up in one running sum and
    shrunk again, so the work is linear; what lies before is carried in from the totals of the few blocks that matter.
    """
    out: DataFrame | None = None
    for group in _groups(taus):
        longest, shortest = max(group.values()), min(group.values())
        width = max(1, int(min(block or BLOCK_SCALES * longest, MOST_SCALES * shortest)))
        back = int(-(-SPAN * longest // width))
        names = [(f"{w}_{t}", w, tau) for w in weights for t, tau in group.items()]
        dealt = batches.withColumn("__block", F.floor(F.col(order) / F.lit(width)).cast("long"))
        start = F.col("__block") * width
        age = lambda later, earlier, tau: F.exp(-(later - earlier) / F.lit(tau))
        totals = dealt.groupBy(entity, "__block").agg(*(F.sum(F.col(w) * age(start + width, F.col(order), tau)).alias(n) for n, w, tau in names))
        near = Window.partitionBy(entity).orderBy("__block").rangeBetween(-back, -1)
        kept = totals.withColumn("__past", F.collect_list(F.struct("__block", *(n for n, _, _ in names))).over(near))  # `back` totals at most
        carried = lambda n, tau: lambda a, x: a + x[n] * age(start, (x["__block"] + 1) * width, tau)
        carry = kept.select(entity, "__block", *(F.aggregate("__past", F.lit(0.0), carried(n, tau)).alias(f"__carry_{n}") for n, _, tau in names))
        inside = Window.partitionBy(entity, "__block").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
        grown = dealt.select("*", *(F.sum(F.col(w) * F.exp((F.col(order) - start) / F.lit(tau))).over(inside).alias(f"__sum_{n}") for n, w, tau in names)).join(carry, [entity, "__block"])
        part = grown.select(entity, order, *(((F.coalesce(F.col(f"__sum_{n}"), F.lit(0.0)) + F.col(f"__carry_{n}")) * age(F.col(order), start, tau)).alias(n) for n, _, tau in names))
        out = part if out is None else out.join(part, [entity, order])
    return out.select(entity, order, *(f"{w}_{t}" for w in weights for t in taus))


def decayed(df: DataFrame, entity: str, us: str, weights: dict[str, Column], taus: dict[str, float], block_us: int | None = None) -> DataFrame:
    """entity, us and, for each weight and scale, sum over strictly earlier events of weight * exp(-age / tau).

    Events of one batch are summed first. An entity's time line is cut into blocks (of block_us, if given, as far as
    floats hold the growth of the shortest scale within one), so that a hot entity is many windows' work; scales far
    apart have blocks of their own. The work is linear in the batches.
    """
    batches = collapse_ties(df, [entity], us, **{name: F.sum(w.cast("double")) for name, w in weights.items()})
    return _running(batches, entity, us, list(weights), {t: tau * MICROS for t, tau in taus.items()}, block_us)


def declarations(entity: str, weights: dict[str, float | None], taus: dict[str, float]) -> list[dict]:
    """What each column of decayed() and bands() is: name, kind, channel, seconds of its scale, normalization and causal scope.

    weights: the divisor of each marked channel, None for the one that counts events.
    """
    out = []
    names = sorted(taus, key=taus.get)
    for w, scale in weights.items():
        kind = "count" if scale is None else "sum"
        own = {"channel": entity if scale is None else w, "causal_scope": "strictly earlier time"} | ({} if scale is None else {"value_scale": float(scale), "normalization": "clip(value / value_scale, -8, 8), missing is 0"})
        out += [{"name": f"{w}_{t}", "kind": f"decayed {kind}", "tau_seconds": float(taus[t])} | own for t in names]
        out += [{"name": f"{w}_{b}_band", "kind": f"{kind} band", "tau_seconds": float(taus[b]), "shorter_tau_seconds": float(taus[a])} | own for a, b in zip(names, names[1:], strict=False)]
    return out


def declared(df: DataFrame, items: list[dict]) -> DataFrame:
    """df with each declaration as its column's metadata."""
    by = {x["name"]: x for x in items}
    return df.select(*(F.col(c).alias(c, metadata=by[c]) if c in by else F.col(c) for c in df.columns))


def bands(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds <longer>_band = longer - shorter for neighbouring scales."""
    return df.withColumns({f"{b}_band": F.col(b) - F.col(a) for a, b in zip(names, names[1:], strict=False)})


def context(df: DataFrame, entity: str, us: str, mark: Column, tau: float) -> DataFrame:
    """entity, us, gap, previous_gap, lag1, lag2, transition of each batch; all 0 without history.

    gap = ln(1 + seconds since the batch before / tau); previous_gap is that batch's own; lags are batch means of mark.
    """
    w = Window.partitionBy(entity).orderBy(us)
    batches = collapse_ties(df, [entity], us, m=F.avg(mark))
    seconds = (F.col(us) - F.lag(us).over(w)) / MICROS
    named = batches.withColumn("gap", F.coalesce(F.log1p(seconds / tau), F.lit(0.0)))
    lag = lambda k: F.coalesce(F.lag("m", k).over(w), F.lit(0.0))
    return named.select(entity, us, "gap", F.coalesce(F.lag("gap").over(w), F.lit(0.0)).alias("previous_gap"), lag(1).alias("lag1"), lag(2).alias("lag2"), (lag(1) * lag(2)).alias("transition"))


def scale_range(df: DataFrame, entity: str, us: str) -> DataFrame:
    """gap_low: 10 % quantile of positive gaps within entities; span_high: 95 % quantile of positive spans; n_gaps."""
    batches = df.select(entity, us).distinct()
    gaps = batches.select(((F.col(us) - F.lag(us).over(Window.partitionBy(entity).orderBy(us))) / MICROS).alias("gap")).where("gap > 0")
    spans = batches.groupBy(entity).agg(((F.max(us) - F.min(us)) / MICROS).alias("span")).where("span > 0")
    low, high = quantiles(gaps, "gap", [0.1])[0], quantiles(spans, "span", [0.95])[0]
    return gaps.agg(F.lit(low).cast("double").alias("gap_low"), F.count(F.lit(1)).alias("n_gaps"), F.lit(high).cast("double").alias("span_high"))


def time_scales(df: DataFrame, entity: str, us: str, cap: int = 8) -> list[float]:
    """Geometric scales between the two quantiles: min(cap, max(2, ceil(log2 ratio) + 1)) of them; one if they coincide."""
    import math

    found = scale_range(df, entity, us).first()
    if not found["n_gaps"]:
        raise ValueError("no entity has two different times")
    low, high = found["gap_low"], max(found["span_high"], found["gap_low"])
    ratio = high / low
    if ratio <= 1 + 1e-12:
        return [low]
    n = min(cap, max(2, math.ceil(math.log2(ratio)) + 1))
    return [low * ratio ** (k / (n - 1)) for k in range(n)]


def final_state(df: DataFrame, entity: str, us: str, weights: dict[str, Column], taus: dict[str, float]) -> DataFrame:
    """entity, last_us and each decayed sum including the last batch, as of last_us: what a frozen transform starts from."""
    last = df.groupBy(entity).agg(F.max(us).alias("last_us"))
    aged = df.join(last, entity)
    return aged.groupBy(entity, "last_us").agg(*(F.sum(w * F.exp(-(F.col("last_us") - F.col(us)) / F.lit(tau * MICROS))).alias(f"{n}_{t}") for n, w in weights.items() for t, tau in taus.items()))


def frozen(df: DataFrame, state: DataFrame, entity: str, us: str, weights: dict[str, Column], taus: dict[str, float]) -> DataFrame:
    """Decayed sums of new events from a fitted state, which does not advance; unknown entities start at 0.

    Fails (at run time) if a known entity's event is not later than its fitted last time.
    """
    own = decayed(df, entity, us, weights, taus)
    known = state.select(F.col(entity).alias("__entity"), F.col("last_us").alias("__last"), *(F.col(f"{n}_{t}").alias(f"__{n}_{t}") for n in weights for t in taus))
    joined = own.join(known, F.col(entity) == F.col("__entity"), "left").withColumn("__last", F.when(F.col(us) <= F.col("__last"), F.raise_error(F.lit("event not after the fitted state")).cast("long")).otherwise(F.col("__last")))
    start = lambda n, tau: F.coalesce(F.col(f"__{n}") * F.exp(-(F.col(us) - F.col("__last")) / F.lit(tau * MICROS)), F.lit(0.0))
    return joined.select(entity, us, *((F.col(f"{n}_{t}") + start(f"{n}_{t}", tau)).alias(f"{n}_{t}") for n in weights for t, tau in taus.items()))


def causal_target(df: DataFrame, key: str, order: str, target: str, smooth: float, start: float, block: Column) -> DataFrame:
    """key, order, encoded: (prior sum of target in the key + smooth * prior global mean) / (prior count in the key + smooth).

    Prior: strictly smaller order value. The global mean is over all keys and start where nothing is earlier. block: a
    coarse, monotone function of order, by which the global prior is dealt out.
    """
    own = prior_totals(df, order, block, (key,), n=F.count(target), s=F.sum(target)).select(key, order, F.col("prior_n").alias("kn"), F.col("prior_s").alias("ks"))  # a hot key is dealt out by block too
    whole = prior_totals(df, order, block, n=F.count(target), s=F.sum(target))
    prior = F.when(F.col("prior_n") > 0, F.col("prior_s") / F.col("prior_n")).otherwise(F.lit(start))
    return own.join(whole, order).select(key, order, ((F.col("ks") + smooth * prior) / (F.col("kn") + smooth)).alias("encoded"))


def causal_gaussian(df: DataFrame, key: str, order: str, target: str, smooth: float, block: Column) -> DataFrame:
    """key, order, encoded: precision-weighted mean of the key's strictly earlier targets and the global one; 0 at the start.

    The global prior has the sample variance of all earlier rows (1 below two). The key's own variance is shrunk
    towards it with `smooth` rows and kept within a factor of 1000; the prior counts as smooth rows of that variance.
    """
    sums = {"n": F.count(target), "s": F.sum(target), "q": F.sum(F.col(target) * F.col(target))}
    own = prior_totals(df, order, block, (key,), **sums).select(key, order, *(F.col(f"prior_{c}").alias(f"k{c}") for c in "nsq"))
    joined = own.join(prior_totals(df, order, block, **sums), order)
    n, s, q = (F.col(f"prior_{c}") for c in "nsq")
    mean = F.when(n > 0, s / n).otherwise(F.lit(0.0))
    variance = F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), 1e-12 * F.pow(F.greatest(F.lit(1.0), F.abs(mean)), F.lit(2.0)))).otherwise(F.lit(0.0))
    kn, ks, kq = (F.col(f"k{c}") for c in "nsq")
    within = F.greatest(kq - ks * ks / F.when(kn > 0, kn), F.lit(0.0))
    local = (within + smooth * variance) / (F.greatest(kn - 1, F.lit(0)) + smooth)
    local = F.least(variance * 1e3, F.greatest(variance * 1e-3, local))
    weighted = (smooth / F.when(variance > 0, variance) * mean + kn / F.when(variance > 0, local) * (ks / F.when(kn > 0, kn))) / (smooth / F.when(variance > 0, variance) + kn / F.when(variance > 0, local))
    encoded = F.when(kn == 0, mean).when(variance == 0, (ks + smooth * mean) / (kn + smooth)).otherwise(weighted)
    return joined.select(key, order, encoded.alias("encoded"))


#: Fixed values of the suffix tree: symbols below, within and above the dead zone; deepest context; mass of the root's prior per symbol.
SYMBOLS, DEPTH, DEAD_ZONE, ROOT_PRIOR, LEAST_SUPPORT = 3, 3, 0.25, 0.5, 8


def suffix_tree(df: DataFrame, entity: str, us: str, mark: Column, block: Column, least_support: int = LEAST_SUPPORT, root_prior: float = ROOT_PRIOR) -> DataFrame:
    """entity, us and expectation, entropy, support, depth of the next symbol, read from a population suffix tree.

    An entity's batch means become symbols; a context is its 0 to 3 last symbols, newest first. Counts of what followed
    a context, over all entities, are of strictly earlier times. From the root down each context's posterior has its
    parent's as prior of mass one; the deepest context whose likelihood gain over its parent's posterior exceeds
    (symbols - 1) / 2 * ln(support) is read. block: coarse, monotone function of us, by which counting is dealt out.
    """
    w = Window.partitionBy(entity).orderBy(us)
    batches = collapse_ties(df, [entity], us, m=F.avg(mark))
    batches = batches.withColumn("s", F.when(F.col("m") < -DEAD_ZONE, 0).when(F.col("m") > DEAD_ZONE, 2).otherwise(1))
    batches = batches.withColumns({f"h{k}": F.lag("s", k).over(w) for k in range(1, DEPTH + 1)})
    read = batches
    for depth in range(DEPTH + 1):
        keys = [f"h{k}" for k in range(1, depth + 1)]
        known = batches.where(F.col(keys[-1]).isNotNull()) if keys else batches
        counts = prior_totals(known, us, block, tuple(keys), **{f"c{k}": F.sum((F.col("s") == k).cast("long")) for k in range(SYMBOLS)})
        named = counts.select(F.col(us).alias("__us"), *(F.col(k).alias(f"__{k}") for k in keys), *(F.col(f"prior_c{k}").alias(f"d{depth}_{k}") for k in range(SYMBOLS)))
        match = F.col(us) == F.col("__us")
        for k in keys:
            match = match & (F.col(k) == F.col(f"__{k}"))
        read = read.join(named, match, "left").drop("__us", *(f"__{k}" for k in keys))
    total = lambda d: sum((F.col(f"d{d}_{k}") for k in range(1, SYMBOLS)), F.col(f"d{d}_0")).cast("double")
    read = read.withColumns({f"p0_{k}": (F.col(f"d0_{k}") + root_prior) / (total(0) + SYMBOLS * root_prior) for k in range(SYMBOLS)})
    read = read.withColumns({f"x{k}": F.col(f"p0_{k}") for k in range(SYMBOLS)} | {"x_support": total(0), "x_depth": F.lit(0)})
    for d in range(1, DEPTH + 1):
        there = F.col(f"h{d}").isNotNull()
        n = total(d)
        read = read.withColumns({f"p{d}_{k}": (F.col(f"d{d}_{k}") + F.col(f"p{d - 1}_{k}")) / (n + 1) for k in range(SYMBOLS)})
        gain = sum((F.when(F.col(f"d{d}_{k}") > 0, F.col(f"d{d}_{k}") * F.ln(F.col(f"d{d}_{k}") / n / F.greatest(F.col(f"p{d - 1}_{k}"), F.lit(1e-15)))).otherwise(F.lit(0.0)) for k in range(SYMBOLS)), F.lit(0.0))
        better = there & (n >= least_support) & (gain > 0.5 * (SYMBOLS - 1) * F.ln(n))
        read = read.withColumns({f"x{k}": F.when(better, F.col(f"p{d}_{k}")).otherwise(F.col(f"x{k}")) for k in range(SYMBOLS)} | {"x_support": F.when(better, n).otherwise(F.col("x_support")), "x_depth": F.when(better, F.lit(d)).otherwise(F.col("x_depth"))})
    entropy = sum((-F.col(f"x{k}") * F.ln(F.greatest(F.col(f"x{k}"), F.lit(1e-15))) for k in range(SYMBOLS)), F.lit(0.0)) / F.ln(F.lit(float(SYMBOLS)))
    return read.select(entity, us, (F.col("x2") - F.col("x0")).alias("expectation"), entropy.alias("entropy"), (F.col("x_support") / (F.col("x_support") + 1)).alias("support"), (F.col("x_depth") / float(DEPTH)).alias("depth"))


def half_life_mean(df: DataFrame, entity: str, period: str, metric: str, half_life: float) -> DataFrame:
    """entity, period, value: mean of metric over strictly earlier periods, weighted 2 ** (-age / half_life); null without any.

    The mean as of the period before, which age alone does not change: sums up to it, itself included, linear in periods.
    """
    import math

    sums = df.groupBy(entity, period).agg(F.coalesce(F.sum(metric).cast("double"), F.lit(0.0)).alias("__s"), F.count(metric).cast("double").alias("__n"))
    before = _running(sums, entity, period, ["__s", "__n"], {"h": half_life / math.log(2)}, None)
    upto = sums.join(before, [entity, period]).withColumn("__mean", F.try_divide(F.col("__s") + F.col("__s_h"), F.col("__n") + F.col("__n_h")))
    return upto.select(entity, period, F.lag("__mean").over(Window.partitionBy(entity).orderBy(period)).alias("value"))


def percent_rank_average(values: Column | str, partition: list[str]) -> Column:
    """Rank over the partition divided by its size, ties sharing their mean rank."""
    c = F.col(values) if isinstance(values, str) else values
    w = Window.partitionBy(*partition)
    peers = F.count(F.lit(1)).over(Window.partitionBy(*partition, c))
    return (F.rank().over(w.orderBy(c)) + (peers - 1) / 2.0) / F.count(F.lit(1)).over(w)
