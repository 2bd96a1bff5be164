"""The theta join deals a nation's pairs out over many tasks and loses none."""

import duckdb
from pyspark.sql import functions as F

from tidemark import plans


def test_one_nation_is_many_tasks(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT 3 AS n_nationkey, 'N' AS n_name) TO '{tmp_path}/nation.parquet'")
    con.sql(f"COPY (SELECT i::BIGINT AS s_suppkey, 3 AS s_nationkey, CASE WHEN i % 11 > 0 THEN (i * 37 % 1000) / 8 END AS s_acctbal FROM range(60) t(i)) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"COPY (SELECT i::BIGINT AS c_custkey, 3 AS c_nationkey, CASE WHEN i % 13 > 0 THEN (i * 53 % 1000) / 8 - 20 END AS c_acctbal FROM range(900) t(i)) TO '{tmp_path}/customer.parquet'")
    for t in ("nation", "supplier", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = plans.QUERIES["theta_join"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r)[:4] for r in got) == sorted(con.sql(plans.ORACLES["theta_join"]).fetchall())
    assert len({r["task"] for r in got}) > 3
