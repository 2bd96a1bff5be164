"""Queries that fit whole models, and clauses and declarations made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import datalog as D
from tidemark.operators import history as H
from tidemark.operators.predicates import tree_regions
from tidemark.plans.boost import _lines
from tidemark.plans.history import TAUS, _events
from tidemark.plans.predicates import _REGIONS_SQL, TREES
from tidemark.plans.registry import load, query

_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query()
def regressor_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML12, DC6: prices from quantities with conformal intervals as wide as residuals are where a row lies."""
    rows = _lines(spark, sf_dir)
    fitted = model.Regressor(["q", "d", "t"], rounds=8, depth=3).fit(rows, "price", F.pmod("l_orderkey", F.lit(5)) == 0)
    return fitted.interval(rows).select(*_KEYS, *(F.round(c, 6).alias(c) for c in ("prediction", "lower", "upper")))


@query()
def classifier_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML13, DC7: a planted interaction with a lower bound of precision in regions fitted to where decisions are right."""
    rows = _lines(spark, sf_dir).withColumn("y", ((F.col("q") > 25) != (F.col("d") > 0.05)).cast("int"))
    fitted = model.Classifier(["q", "d", "t"], rounds=6, depth=3).fit(rows, "y", F.pmod("l_orderkey", F.lit(5)) == 0)
    return fitted.certify(rows).select(*_KEYS, F.round("probability_1", 6).alias("p"), "label", F.round("precision_low", 6).alias("precision_low"), F.concat_ws(",", F.col("labels").cast("array<string>")).alias("labels"))


@query()
def multi_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML33: one model a label, a set of labels a row."""
    rows = _lines(spark, sf_dir).withColumns({"big": (F.col("q") > 25).cast("int"), "cheap": (F.col("d") > 0.05).cast("int")})
    fitted = model.MultiOutput(["q", "d"], rounds=3, depth=2).fit(rows, ["big", "cheap"], F.pmod("l_orderkey", F.lit(5)) == 0)
    return fitted.predict(rows).select(*_KEYS, F.concat_ws(",", "labels").alias("labels"))


@query(f"WITH {_REGIONS_SQL}, b AS (SELECT l_orderkey AS id, max(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1) SELECT tree, leaf, count(*) AS n FROM b JOIN r ON q > q_lo AND q <= q_hi AND p > p_lo AND p <= p_hi GROUP BY ALL")
def region_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL19: each leaf's region as a Horn clause, and the orders that follow from it."""
    b = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p")).select(F.col("l_orderkey").cast("string").alias("a0"), F.col("q").cast("string"), F.col("p").cast("string"))
    facts = {"row": b.select("a0"), "q": b.select("a0", F.col("q").alias("a1")), "p": b.select("a0", F.col("p").alias("a1"))}
    leaves = {f"leaf{r['tree']}_{r['leaf']}": r for k, t in enumerate(TREES) for r in tree_regions(t, k)}
    known = D.closure([D.region_rule(head, r["bounds"]) for head, r in leaves.items()], facts)
    counted = None
    for head, r in leaves.items():
        part = known[head].agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(r["tree"]).alias("tree"), F.lit(r["leaf"]).alias("leaf"), "n")
        counted = part if counted is None else counted.unionByName(part)
    return counted


@query()
def history_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN11: what the history columns are, read back from the table's own metadata."""
    out = H.decayed(_events(spark, sf_dir), "user_id", "us", {"v": F.lit(1.0)}, TAUS)
    named = H.declared(H.bands(out, [f"v_{t}" for t in TAUS]), H.declarations("user_id", {"v": None}, TAUS))
    rows = [(f.name, f.metadata["kind"], f.metadata["channel"], f.metadata["tau_seconds"], f.metadata["causal_scope"]) for f in named.schema if f.metadata]
    return spark.createDataFrame(rows, "name string, kind string, channel string, tau_seconds double, causal_scope string")
