"""Reading and writing: delimited files with a stated schema, triples, row ranges, split manifests, reports and parameter tables."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_FORMAT = 1


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A delimited file with header; the schema is stated, never inferred, and bad rows fail."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, mode="FAILFAST", enforceSchema=False)
    return df.select(*columns) if columns else df


def read_tables(spark: SparkSession, directory: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Several <name>.csv files by their schemas."""
    return {name: read_csv(spark, f"{directory}/{name}.csv", schema) for name, schema in schemas.items()}


def read_matrix(spark: SparkSession, path: str, columns: int, sep: str = ",") -> DataFrame:
    """A headless numeric matrix: label, then c1, c2, ...; a non-finite or unreadable value fails when it is read."""
    names = ["label", *(f"c{k}" for k in range(1, columns))]
    df = spark.read.csv(path, schema=", ".join(f"{n} double" for n in names), sep=sep, mode="FAILFAST")
    check = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == math.inf), F.raise_error(F.lit(f"non-finite value in {c}")).cast("double")).otherwise(F.col(c)).alias(c)
    return df.select(*(check(n) for n in names))


def read_triples(spark: SparkSession, path: str, inverses: bool = False) -> DataFrame:
    """rel, head, tail from lines head<tab>relation<tab>tail; other lines are ignored. inverses adds <rel>_inv backwards."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("x")).where(F.size("x") == 3)
    triples = parts.select(F.col("x")[1].alias("rel"), F.col("x")[0].alias("head"), F.col("x")[2].alias("tail"))
    if inverses:
        triples = triples.unionByName(triples.select(F.concat("rel", F.lit("_inv")).alias("rel"), F.col("tail").alias("head"), F.col("head").alias("tail")))
    return triples


def is_graph(df: DataFrame) -> bool:
    """Whether a table is one of triples, by its columns."""
    return {(f.name, f.dataType.simpleString()) for f in df.schema} >= {("rel", "string"), ("head", "string"), ("tail", "string")}


def read_rows(spark: SparkSession, path: str, row_id: str, start: int, stop: int) -> DataFrame:
    """Rows of a Parquet table with start <= row_id < stop; row groups outside are skipped by their statistics."""
    return spark.read.parquet(path).where((F.col(row_id) >= start) & (F.col(row_id) < stop))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) row_id tables of the first split of a JSON manifest {"splits": [[{"train": [...], "test": [...]}]]}; they may not overlap."""
    first = spark.read.json(path, schema="splits array<array<struct<train: array<long>, test: array<long>>>>", multiLine=True).select(F.col("splits")[0][0].alias("s"))
    train, test = (first.select(F.explode(f"s.{side}").alias("row_id")) for side in ("train", "test"))
    if train.join(test, "row_id", "left_semi").limit(1).count():
        raise ValueError("train and test overlap")
    return train, test


def suite(metadata: DataFrame, least: int, most: int, problem: str | None = None, runnable: bool = True, cap: int | None = None) -> DataFrame:
    """Dataset metadata (name, rows, problem, runnable) filtered by size, kind and flag, by name."""
    found = metadata.where((F.col("rows") >= least) & (F.col("rows") < most))
    if problem:
        found = found.where(F.col("problem") == problem)
    if runnable:
        found = found.where("runnable")
    found = found.orderBy("name")
    return found.limit(cap) if cap else found


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with header in a stated order; the commit protocol makes it appear whole or not at all."""
    df.repartition(1).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def save_model(spark: SparkSession, path: str, kind: str, parameters: dict) -> None:
    """Parameters (plain JSON values) with a format number, as Parquet; no code is stored."""
    row = [(MODEL_FORMAT, kind, json.dumps(parameters, sort_keys=True, allow_nan=False))]
    spark.createDataFrame(row, "format int, kind string, parameters string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, kind: str) -> dict:
    """The parameters of save_model; fails on another format or kind."""
    row = spark.read.parquet(path).first()
    if row is None or row["format"] != MODEL_FORMAT or row["kind"] != kind:
        raise ValueError("not a model of this format and kind")
    return json.loads(row["parameters"])
