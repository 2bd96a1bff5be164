"""Queries that write tables with the sinks and read them again with the sources, and proofs of single facts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import datalog as D
from tidemark.operators.cut import shared_dir
from tidemark.plans.registry import load, query
from tidemark.sources import readers as R


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2, SC13, SC14: a CSV file in a stated order, and back by its stated schema."""
    path = _path(spark)
    R.write_csv(load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, ["n_nationkey"])
    return R.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM orders")
def csv_typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2: dates and numbers of a CSV file, typed by the schema."""
    path = _path(spark)
    R.write_csv(load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), F.round("o_totalprice", 2).alias("o_totalprice")), path, ["o_orderkey"])
    return R.read_csv(spark, path, "o_orderkey long, o_orderdate date, o_totalprice double")


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3: several files of one folder, joined."""
    path = _path(spark)
    R.write_csv(load(spark, sf_dir, "region").select("r_regionkey", "r_name"), f"{path}/region.csv", ["r_regionkey"])
    R.write_csv(load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{path}/nation.csv", ["n_nationkey"])
    tables = R.read_tables(spark, path, {"region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int"})
    return tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query("SELECT l_linenumber::DOUBLE AS label, l_quantity AS c1, l_tax AS c2 FROM lineitem WHERE l_orderkey % 10 = 0")
def numeric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4: a headless numeric matrix."""
    path = _path(spark)
    some = load(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0")
    some.select(F.concat_ws(";", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), F.col("l_tax").cast("string"))).write.text(path)
    return R.read_matrix(spark, path, 3, ";")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500")
def parquet_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5: a range of rows, row groups outside skipped."""
    return R.read_rows(spark, f"{sf_dir}/orders.parquet", "o_orderkey", 100, 500).select("o_orderkey", "o_custkey")


@query("SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'test' ELSE 'train' END AS side, n_name FROM nation")
def manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6: the rows that a split manifest names."""
    path, nation = _path(spark), load(spark, sf_dir, "nation")
    sides = {side: sorted(r[0] for r in nation.where((F.col("n_nationkey") % 5 == 0) == (side == "test")).select("n_nationkey").collect()) for side in ("train", "test")}  # 25 rows
    spark.createDataFrame([(json.dumps({"splits": [[sides]]}),)], "value string").coalesce(1).write.text(path)
    train, test = R.read_manifest(spark, path)
    named = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return named.join(nation, F.col("row_id") == F.col("n_nationkey")).select("side", "n_name")


@query("SELECT 'nation' AS name, 25::BIGINT AS rows FROM region WHERE (SELECT count(*) FROM nation) = 25 LIMIT 1")
def dataset_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9: data sets chosen by size, kind and flag."""
    rows = [(name, load(spark, sf_dir, name).count(), kind, name != "events") for name, kind in (("region", "graph"), ("nation", "graph"), ("orders", "table"), ("events", "table"))]
    return R.suite(spark.createDataFrame(rows, "name string, rows long, problem string, runnable boolean"), 10, 1000, "graph").select("name", "rows")


@query("SELECT r_regionkey, r_name FROM region")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15: rows as JSON lines, and back."""
    path = _path(spark)
    R.write_report(load(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    return spark.read.text(path).select(F.from_json("value", "r_regionkey int, r_name string").alias("x")).select("x.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 + 0.25 * l_quantity, 6) AS score FROM lineitem")
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16, SC17: a model's parameters written as a table, read again and applied."""
    path = _path(spark)
    R.save_model(spark, path, "line", {"base": 0.5, "l_quantity": 0.25})
    p = R.load_model(spark, path, "line")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(p["base"] + p["l_quantity"] * F.col("l_quantity"), 6).alias("score"))


@query("SELECT n_name || chr(9) || 'in' || chr(9) || r_name AS line, n_name AS head, 'in' AS rel, r_name AS tail FROM nation JOIN region ON n_regionkey = r_regionkey")
def triple_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, SC8: triples from tab-separated lines, told from other tables by their columns; broken lines are ignored."""
    path = _path(spark)
    named = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named.select(F.concat_ws("\t", "n_name", F.lit("in"), "r_name")).unionByName(spark.createDataFrame([("no triple",)], "value string").toDF("concat_ws(\t, n_name, in, r_name)")).write.text(path)
    found = R.read_triples(spark, path)
    if not R.is_graph(found) or R.is_graph(load(spark, sf_dir, "nation")):
        raise AssertionError("triples are told by their columns")
    return found.select(F.concat_ws("\t", "head", "rel", "tail").alias("line"), "head", "rel", "tail")


#: Two steps and an absence: a nation is in a region; two nations are near if in one region; lone if near nobody with a smaller key.
_RULES = [
    (("in", "X", "R"), [("of", "X", "R"), ("region", "R")]),
    (("near", "X", "Y"), [("in", "X", "R"), ("in", "Y", "R"), ("cmp", "<", "Y", "X")]),
    (("some", "X"), [("near", "X", "Y")]),
    (("first", "X"), [("in", "X", "R"), ("not", ("some", "X"))]),
]


@query("""
WITH f AS (SELECT r_regionkey, min(n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT k::VARCHAR AS nation, true AS proved, true AS checked, false AS forged, 'first(' || k || ')' || chr(10) || '  in(' || k || ', ' || r_regionkey || ')' || chr(10) || '    of(' || k || ', ' || r_regionkey || ')  [base]' || chr(10) || '    region(' || r_regionkey || ')  [base]' AS shown FROM f""")
def datalog_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL3, DL4, DL5: a proof of each fact of the last stratum, its check, the check of a forged one, and its text."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    facts = {"of": nation.select(F.col("n_nationkey").cast("string").alias("a0"), F.col("n_regionkey").cast("string").alias("a1")), "region": region.select(F.col("r_regionkey").cast("string").alias("a0"))}
    wanted = [("first", r["a0"]) for r in D.closure(_RULES, facts)["first"].collect()]  # one a region
    base = {(p, *r) for p, df in facts.items() for r in df.collect()}  # 30 facts
    rows = []
    for fact in wanted:
        proof = D.prove(fact, _RULES, base)
        forged = (fact, _RULES[3], [(("in", fact[1], "9"), "base", [])])
        rows.append((fact[1], proof is not None, D.check(proof, base, _RULES), D.check(forged, base, _RULES), D.show(proof)))
    return spark.createDataFrame(rows, "nation string, proved boolean, checked boolean, forged boolean, shown string")
