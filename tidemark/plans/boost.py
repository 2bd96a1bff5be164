"""Queries that fit and apply boosted trees and nearest-neighbour votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import boost as B
from tidemark.operators import neighbours as N
from tidemark.plans.registry import load, query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), (F.col("l_extendedprice") / 1000).alias("price"))


@query()
def boosted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML1, ML2, ML6, FN17: Huber loss with early stopping on held-out orders, half of the rows a round, then a refit on all."""
    rows = _lines(spark, sf_dir)
    model = B.fit(rows, ["q", "d", "t"], "price", valid=F.pmod("l_orderkey", F.lit(5)) == 0, rounds=6, huber=0.95, subsample=0.5, refit=True)
    return model.predict(rows).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("prediction", 6).alias("prediction"))


@query()
def boosted_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML4: log loss of a planted interaction, trees grown by the best leaf."""
    rows = _lines(spark, sf_dir).withColumn("y", ((F.col("q") > 25) != (F.col("d") > 0.05)).cast("int"))
    model = B.fit(rows, ["q", "d", "t"], "y", "binary", valid=F.pmod("l_orderkey", F.lit(5)) == 0, rounds=5, leaves=6)
    return model.predict(rows).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "y", F.round("probability_1", 6).alias("p"))


@query()
def boosted_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML3: softmax boosting of three price classes."""
    rows = _lines(spark, sf_dir).withColumn("y", F.when(F.col("price") < 15, 0).when(F.col("price") < 35, 1).otherwise(2))
    model = B.fit(rows, ["q", "d"], "y", "multiclass", classes=3, rounds=2)
    return model.predict(rows).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *(F.round(f"probability_{k}", 6).alias(f"p{k}") for k in range(3)))


@query("""
WITH s AS (SELECT a.vec_id AS query, b.label, b.vec_id AS row, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(d, 9), row) AS k FROM s), v AS (SELECT query, label, sum(1 / (d + 1e-9)) AS w FROM k WHERE k <= 15 GROUP BY ALL) SELECT query, label, round(w / sum(w) OVER (PARTITION BY query), 6) AS vote FROM v""")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16, ML14: for every vec_id divisible by 20, the inverse-distance vote of its 15 nearest rows."""
    e = load(spark, sf_dir, "embeddings")
    near = N.nearest(e, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 15).join(e.select(F.col("vec_id").alias("row"), "label"), "row")
    votes = near.groupBy("query", "label").agg(F.sum(1 / (F.col("d") + 1e-9)).alias("w"))
    return votes.select("query", "label", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("query")), 6).alias("vote"))
