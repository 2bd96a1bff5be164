"""Time-safe splits and deterministic samples.

Splits run over one row a distinct time, with running counts dealt out by a coarse block (see prefix). Samples order
by a hash of the id, or by evenly spaced row numbers, never by a random generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import numbered, prior_totals


def boundaries(df: DataFrame, order: str, block: Column, classes: Column | None = None) -> DataFrame:
    """order, before, n, total: rows before each distinct time, at it, and in all; with classes also c_before and c_total (of rows where it holds)."""
    sums = {"n": F.count(F.lit(1))} | ({"c": F.sum(classes.cast("long"))} if classes is not None else {})
    own = df.groupBy(order).agg(*(c.alias(k) for k, c in sums.items()))
    total = F.broadcast(df.agg(*(c.alias(f"{k}_total") for k, c in sums.items())))  # one row
    return own.join(prior_totals(df, order, block, **sums), order).crossJoin(total)


def future_cut(df: DataFrame, order: str, block: Column, holdout: float = 0.25, least_train: int = 100, least_valid: int = 40, positive: Column | None = None) -> DataFrame:
    """One row: cut, train, valid: the distinct time nearest the wanted share at which the future starts.

    Both sides have their least rows and, if positive is given, rows where it holds and where it does not. Ties to the earlier.
    """
    b = boundaries(df, order, block, positive)
    train, valid = F.col("prior_n"), F.col("n_total") - F.col("prior_n")
    ok = (train >= least_train) & (valid >= least_valid)
    if positive is not None:
        p = F.col("prior_c")
        ok = ok & (p > 0) & (p < train) & (F.col("c_total") - p > 0) & (F.col("c_total") - p < valid)
    target = F.rint((1.0 - holdout) * F.col("n_total"))
    return b.where(ok).agg(F.min_by(F.struct(F.col(order).alias("cut"), train.alias("train"), valid.alias("valid")), F.struct(F.abs(train - target), train)).alias("b")).select("b.*")


def expanding_cuts(df: DataFrame, order: str, block: Column, folds: int = 3, warmup: float = 0.4) -> DataFrame:
    """fold, start: the first distinct times at or after each share of rows; fold k is valid from its start to the next."""
    b = boundaries(df, order, block)
    parts = [warmup + (1 - warmup) * k / folds for k in range(folds)]
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(p).alias("share")) for k, p in enumerate(parts))))
    reached = b.select(order, "prior_n", "n_total", at.alias("x")).where(F.col("prior_n") >= F.col("x.share") * F.col("n_total"))
    return reached.groupBy(F.col("x.fold").alias("fold")).agg(F.min(order).alias("start"))


def recent_atomic(df: DataFrame, order: str, cap: int, block: Column) -> DataFrame:
    """The most recent rows within cap, never cutting a time's rows apart."""
    b = boundaries(df, order, block)
    kept = b.where(F.col("n_total") - F.col("prior_n") <= cap).select(F.col(order).alias("__kept"))
    return df.join(kept, F.col(order) == F.col("__kept"), "left_semi")


def atomic_parts(df: DataFrame, order: str, parts: int, block: Column) -> DataFrame:
    """order, part: distinct times in `parts` runs of about equal row counts."""
    b = boundaries(df, order, block)
    return b.select(order, F.least(F.floor(F.col("prior_n") * parts / F.col("n_total")), F.lit(parts - 1)).cast("int").alias("part"))


def evenly_spaced(df: DataFrame, row_id: str, block: Column, most: int) -> DataFrame:
    """At most `most` rows at evenly spaced places of the order by row_id, first and last included."""
    n = df.count()
    if n <= most:
        return df
    dealt = numbered(df, [F.col(row_id)], block, "__row")
    place = lambda r: F.floor(r * (most - 1) / (n - 1) + 1e-9)
    return dealt.where((F.col("__row") == 0) | (place(F.col("__row")) > place(F.col("__row") - 1))).drop("__row")


def hashed(row_id: str, seed: int = 0) -> Column:
    """A number that orders rows as good as randomly, and alike in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"/{seed}"))), 1, 12), 16, 10).cast("long")


def folds(df: DataFrame, row_id: str, k: int, strata: str | None = None, seed: int = 0) -> DataFrame:
    """df with fold 0..k-1; by strata, the classes are dealt out in hash order so that folds differ by one row at most.

    Row numbers within a class come from 256 hash blocks, not from one task.
    """
    if strata is None:
        return df.withColumn("fold", F.pmod(hashed(row_id, seed), F.lit(k)).cast("int"))
    keyed = df.withColumn("__h", hashed(row_id, seed)).withColumn("__block", F.shiftright("__h", 40))
    sizes = keyed.groupBy(strata, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(strata).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(strata, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy(strata, "__block").orderBy("__h", row_id)) - 1 + F.col("__base")
    return keyed.join(base, [strata, "__block"]).withColumn("fold", F.pmod(number, F.lit(k)).cast("int")).drop("__h", "__block", "__base")


def stratified_sample(df: DataFrame, row_id: str, strata: str, cap: int, floor: int = 1, seed: int = 0) -> DataFrame:
    """About cap rows, classes by their share (floor at least), in hash order, with weight = class rows / its sampled rows."""
    n = df.groupBy(strata).agg(F.count(F.lit(1)).alias("__n"))
    total = F.broadcast(n.agg(F.sum("__n").alias("__t")))
    quota = n.crossJoin(total).select(strata, "__n", F.least(F.greatest(F.floor(F.col("__n") * cap / F.col("__t")), F.lit(floor)), F.col("__n")).alias("__q"))
    keyed = df.withColumn("__h", hashed(row_id, seed)).withColumn("__block", F.shiftright("__h", 40))
    sizes = keyed.groupBy(strata, "__block").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(strata).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(strata, "__block", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy(strata, "__block").orderBy("__h", row_id)) + F.col("__base")
    kept = keyed.join(base, [strata, "__block"]).withColumn("__k", number).join(F.broadcast(quota), strata).where("__k <= __q")  # quota: a row a class
    return kept.withColumn("weight", F.col("__n") / F.col("__q")).drop("__h", "__block", "__base", "__k", "__n", "__q")


def reservoir(df: DataFrame, row_id: str, order: str, cap: int, block: Column, bands: int = 6) -> DataFrame:
    """df's rows with band: three quarters of cap most recent ones (band 0), the rest of cap spread over bands of doubling age.

    Within an older band a row is kept if its hash is under the band's rate; a band with fewer rows than its share keeps all.
    """
    n = df.count()
    recent = min(n, cap * 3 // 4)
    dealt = numbered(df, [F.col(order), F.col(row_id)], block, "__row").withColumn("__age", n - 1 - F.col("__row"))
    older, share = max(0, n - recent), max(1, (cap - recent) // bands)
    unit = older / (2**bands - 1) if older else 1.0
    age = (F.col("__age") - recent) / F.lit(unit)
    band = F.when(F.col("__age") < recent, 0).otherwise(F.least(F.floor(F.log2(age + 1)), F.lit(bands - 1)).cast("int") + 1)
    marked = dealt.withColumn("band", band)
    sizes = F.broadcast(marked.groupBy("band").agg(F.count(F.lit(1)).alias("__size")))
    rate = F.when(F.col("band") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share / F.col("__size")))
    return marked.join(sizes, "band").where((F.col("band") == 0) | (hashed(row_id) < rate * F.lit(float(1 << 48)))).drop("__row", "__age", "__size")
