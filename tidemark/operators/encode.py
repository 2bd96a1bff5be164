"""Turning named columns into numbers: imputation, indicator, frequency and target encodings, without leaking a row's own target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import calendar, finite
from tidemark.operators.quantile import at_ranks, quantiles

MISSING = "__nan__"


def strict_columns(df: DataFrame, fitted: list[str]) -> DataFrame:
    """df in fitted column order; fails on duplicate, missing or further columns."""
    have = df.columns
    if len(set(have)) != len(have):
        raise ValueError(f"duplicate columns: {sorted({c for c in have if have.count(c) > 1})}")
    if missing := [c for c in fitted if c not in have]:
        raise ValueError(f"missing columns: {missing}")
    if extra := [c for c in have if c not in fitted]:
        raise ValueError(f"unexpected columns: {extra}")
    return df.select(*fitted)


def augment(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with further columns; fails if one exists."""
    if clash := sorted(set(new) & set(df.columns)):
        raise ValueError(f"columns exist: {clash}")
    return df.withColumns(new)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, parsed (share of non-null texts that are numbers), coded (share with a leading zero before a digit), numeric (parsed > 0.9 and coded < 0.05)."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    n = lambda c: F.nullif(F.count(c), F.lit(0))
    row = df.agg(*(F.coalesce(F.sum(F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)").isNotNull().cast("long")) / n(c), F.lit(0.0)).alias(f"p_{c}") for c in columns), *(F.coalesce(F.sum(text(c).rlike(r"^0\d").cast("long")) / n(c), F.lit(0.0)).alias(f"z_{c}") for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"p_{c}").alias("parsed"), F.col(f"z_{c}").alias("coded")) for c in columns))).alias("x")).select("x.*", ((F.col("x.parsed") > 0.9) & (F.col("x.coded") < 0.05)).alias("numeric"))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Interpolated median of each column's finite values, 0 if there are none."""
    return {c: quantiles(df.select(finite(F.col(c)).alias("v")), "v", [0.5])[0] or 0.0 for c in columns}


def impute(df: DataFrame, columns: list[str], fitted: dict[str, float] | None = None) -> DataFrame:
    """Columns with non-finite values replaced by the fitted median, and <column>__isna flags."""
    fitted = fitted or medians(df, columns)
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(fitted[c])) for c in columns} | {f"{c}__isna": finite(F.col(c)).isNull().cast("double") for c in columns})


def levels(df: DataFrame, column: str, most: int = 20) -> list[str]:
    """At most `most` levels by falling frequency (null is a level), ties by name; refuses more."""
    rows = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("level")).count().orderBy(F.desc("count"), "level").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return [r["level"] for r in rows]


def one_hot(df: DataFrame, column: str, fitted: list[str]) -> DataFrame:
    """<column>=<level> indicators; an unseen level has none."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    return df.withColumns({f"{column}={level}": (key == level).cast("double") for level in fitted})


def level_code(column: str, fitted: list[str]) -> Column:
    """The level's number among the fitted ones, -1 if unseen."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    return F.array_position(F.array(*(F.lit(x) for x in fitted)), key).cast("int") - 1


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """level, share of rows."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("level", (F.col("n") / F.col("total")).alias("share"))  # total is one row


def lookup(df: DataFrame, column: str, table: DataFrame, value: str, default: float, name: str) -> DataFrame:
    """df with name: table's value for the column's level, or the default."""
    named = table.select(F.col("level").alias("__level"), F.col(value).alias(name))
    return df.join(named, F.coalesce(F.col(column).cast("string"), F.lit(MISSING)) == F.col("__level"), "left").drop("__level").withColumn(name, F.coalesce(name, F.lit(default)))


def oof_target(df: DataFrame, key: str, target: str, fold: Column, smooth: float, name: str) -> DataFrame:
    """df with name: (n * mean + smooth * global) / (n + smooth) over the key's rows of other folds.

    The global mean is of all rows, the held-out fold's too; a key without other rows gets it. One pass: counts by
    (key, fold) and by key are subtracted, no job for each fold.
    """
    dealt = df.withColumn("__fold", fold)
    parts = dealt.groupBy(key, "__fold").agg(F.count(target).alias("__n"), F.sum(target).alias("__s"))
    w = Window.partitionBy(key)
    rest = parts.select(F.col(key).alias("__key"), F.col("__fold").alias("__f"), (F.sum("__n").over(w) - F.col("__n")).alias("__rn"), (F.sum("__s").over(w) - F.col("__s")).alias("__rs"))
    mean = F.broadcast(df.agg(F.avg(target).alias("__mean")))
    joined = dealt.join(rest, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__fold") == F.col("__f")), "left").crossJoin(mean)
    value = (F.coalesce("__rs", F.lit(0.0)) + smooth * F.col("__mean")) / (F.coalesce("__rn", F.lit(0)) + smooth)
    return joined.withColumn(name, value).select(*df.columns, name)


def class_posteriors(df: DataFrame, key: str, target: str, classes: list, smooth: float) -> DataFrame:
    """level and, for each class but the first, (sum + smooth * prior) / (count + smooth)."""
    hits = {f"c{k}": F.sum((F.col(target) == c).cast("double")) for k, c in enumerate(classes[1:])}
    prior = F.broadcast(df.agg(*(F.avg((F.col(target) == c).cast("double")).alias(f"p{k}") for k, c in enumerate(classes[1:]))))
    counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(MISSING)).alias("level")).agg(F.count(target).alias("n"), *(c.alias(n) for n, c in hits.items())).crossJoin(prior)
    return counts.select("level", *(((F.col(f"c{k}") + smooth * F.col(f"p{k}")) / (F.col("n") + smooth)).alias(f"target={c}") for k, c in enumerate(classes[1:])))


def gaussian_means(df: DataFrame, key: str, target: str, smooth: float) -> DataFrame:
    """level, mean: conjugate mean of each level's targets under a prior of `smooth` rows of the global mean and variance.

    A level's variance is shrunk to the global one and kept within a factor of a thousand of it.
    """
    y = F.col(target)
    total = F.broadcast(df.agg(F.avg(y).alias("m"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v0")).withColumn("v", F.greatest("v0", 1e-12 * F.pow(F.greatest(F.lit(1.0), F.abs("m")), F.lit(2.0)))))
    by = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(MISSING)).alias("level")).agg(F.count(y).alias("n"), F.avg(y).alias("x"), F.coalesce(F.var_pop(y) * F.count(y), F.lit(0.0)).alias("ss")).crossJoin(total)
    local = F.least(F.greatest((F.col("ss") + smooth * F.col("v")) / (F.greatest(F.col("n") - 1, F.lit(0)) + smooth), 1e-3 * F.col("v")), 1e3 * F.col("v"))
    data, prior = F.col("n") / local, smooth / F.col("v")
    return by.select("level", ((prior * F.col("m") + data * F.col("x")) / (prior + data)).alias("mean"))


def datetime_origin(df: DataFrame, column: str) -> int:
    """Microseconds of the upper median: the value at place n // 2 of the sorted ones; 0 without any."""
    times = df.select(F.unix_micros(F.col(column).cast("timestamp")).alias("us"))
    return at_ranks(times, "us", [times.agg(F.count("us")).first()[0] // 2])[1][0] or 0


def datetime_features(df: DataFrame, column: str, origin: int) -> DataFrame:
    """<column>__datetime_* : elapsed days from origin, cycles and missing flag; missing times stand at the origin."""
    ts = F.coalesce(F.col(column).cast("timestamp"), F.timestamp_micros(F.lit(origin)))
    days = (F.unix_micros(ts) - origin) / 86_400_000_000.0
    parts = {"elapsed_days": days} | calendar(ts) | {"isna": F.col(column).isNull().cast("double")}
    return df.withColumns({f"{column}__datetime_{k}": v for k, v in parts.items()})


def rollup(df: DataFrame, key: str, measure: str, item: str, flag: Column) -> DataFrame:
    """Named aggregates of a key's rows: n, items, total, mean, least, most, concentration (sum of squared shares), signature, flagged."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(item).alias("items"), F.sum(measure).alias("total"), F.avg(measure).alias("mean"), F.min(measure).alias("least"), F.max(measure).alias("most"),
        (F.sum(F.col(measure) * F.col(measure)) / F.pow(F.sum(measure), F.lit(2.0))).alias("concentration"),
        F.array_join(F.sort_array(F.collect_set(F.col(item).cast("string"))), "|").alias("signature"), F.sum(flag.cast("long")).alias("flagged"),
    )


def inconsistent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: for each column the number of keys with more than one distinct value."""
    per_key = df.groupBy(key).agg(*(F.count_distinct(c).alias(c) for c in columns))
    return per_key.agg(*(F.sum((F.col(c) > 1).cast("long")).alias(c) for c in columns))
