"""Finding the roles of an event table's columns: timestamp, entity, marked values."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in column names that speak for a role.
TIME_WORDS = ("time", "timestamp", "date", "datetime", "ts", "at", "when")
ENTITY_WORDS = ("id", "key", "user", "userid", "custkey", "customer", "account", "entity", "ip", "device", "session", "card", "client")
VALUE_WORDS = ("amount", "value", "price", "total", "quantity", "count", "score", "balance")
#: Least rows, and least share of rows, in entities with three rows or more.
LEAST_ROWS, LEAST_COVERAGE = 200, 0.2


@dataclass(frozen=True)
class EventSchema:
    entity: str
    timestamp: str
    values: tuple[str, ...]
    score: float


def name_score(column: str, words: tuple[str, ...]) -> float:
    """2 if the whole name is one of the words, 1 if a part of it (cut at capitals and other characters) is, else 0."""
    name = re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", column).lower()).strip("_")
    if name in words:
        return 2.0
    return 1.0 if any(p in words for p in name.split("_")) else 0.0


def timestamp_roles(df: DataFrame, most: int = 2) -> list[tuple[str, float]]:
    """(column, score) of the best timestamp columns: native ones 3, named text that parses 1, plus the name's score.

    A column qualifies if all its values parse, at least three differ. Numbers never do. One aggregate over all columns.
    """
    found = []
    for f in df.schema:
        native = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        score = name_score(f.name, TIME_WORDS)
        if native or (isinstance(f.dataType, T.StringType) and score):
            us = F.unix_micros(F.col(f.name).cast("timestamp")) if native else F.unix_micros(F.try_to_timestamp(F.col(f.name)))
            found.append((f.name, (3.0 if native else 1.0) + score, us))
    if not found:
        return []
    row = df.agg(F.count(F.lit(1)).alias("n"), *(x.alias(f"{k}_{i}") for i, (_, _, us) in enumerate(found) for k, x in (("c", F.count(us)), ("d", F.count_distinct(us))))).first()
    good = [(name, score) for i, (name, score, _) in enumerate(found) if row[f"c_{i}"] == row["n"] and row[f"d_{i}"] >= 3]
    return sorted(good, key=lambda x: (-x[1], df.columns.index(x[0])))[:most]


def entity_score(df: DataFrame, entity: str, timestamp: str) -> DataFrame:
    """One row: rows, entities, eligible_entities, eligible_rows (of entities with three rows and two times), score (null if unfit)."""
    us = F.unix_micros(F.col(timestamp).cast("timestamp"))
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), (F.max(us) > F.min(us)).alias("moves"))
    ok = (F.col("n") >= 3) & F.col("moves")
    t = per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("entities"), F.sum(ok.cast("long")).alias("eligible_entities"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("eligible_rows"))
    score = 4 * F.col("eligible_rows") / F.col("rows") + 2 * F.log1p("eligible_entities") / F.log1p("rows") + F.least(F.lit(1.0), F.col("rows") / F.greatest(3.0 * F.col("entities"), F.lit(1.0))) + 2 * name_score(entity, ENTITY_WORDS)
    fit = (F.col("entities") >= 2) & (F.col("entities") <= F.floor(F.col("rows") / 2)) & (F.col("eligible_entities") >= 2) & (F.col("eligible_rows") >= F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("rows") * LEAST_COVERAGE)))
    return t.withColumn("score", F.when(fit, score))


def value_roles(df: DataFrame, entity: str, timestamp: str, most: int = 2) -> list[str]:
    """Numeric columns that look like amounts: four fifths finite, three distinct, not all zero; whole numbers need a telling name.

    A second one needs a telling name, too.
    """
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (entity, timestamp) and name_score(f.name, ENTITY_WORDS) == 0]
    if not numeric:
        return []
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    row = df.agg(F.count(F.lit(1)).alias("n"), *(x.alias(f"{k}_{c}") for c in numeric for k, x in (("f", F.count(finite(c))), ("d", F.count_distinct(finite(c))), ("z", F.max(F.abs(finite(c)))), ("w", F.bool_and(finite(c) == F.floor(finite(c))))))).first()
    ranked = []
    for c in numeric:
        share, name = row[f"f_{c}"] / max(1, row["n"]), name_score(c, VALUE_WORDS)
        if share < 0.8 or row[f"d_{c}"] < 3 or not row[f"z_{c}"] or (not name and row[f"w_{c}"]):
            continue
        ranked.append((-(2 * name + math.log1p(row[f"d_{c}"]) / math.log1p(row["n"] + 1) + share), df.columns.index(c), name, c))
    ranked.sort()
    return [c for k, (_, _, name, c) in enumerate(ranked[:most]) if not k or name]


def discover(df: DataFrame, most: int = 3) -> list[EventSchema]:
    """Proposals of (entity, timestamp, values), best first."""
    kinds = (T.IntegerType, T.LongType, T.ShortType, T.StringType)
    out = []
    for ts, score in timestamp_roles(df):
        for f in df.schema:
            if f.name != ts and isinstance(f.dataType, kinds):
                found = entity_score(df, f.name, ts).first()["score"]
                if found is not None:
                    out.append((score + found, f.name, ts))
    out.sort(key=lambda x: (-x[0], df.columns.index(x[1])))
    return [EventSchema(e, t, tuple(value_roles(df, e, t)), s) for s, e, t in out[:most]]
