"""The query of neighbours by tree path, on many events that share theirs."""

import duckdb

from tests.test_overlap import ended
from tidemark import plans


def test_path_neighbours_of_many_events(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS event_id, i % 7 AS user_id, 'view' AS event_type, 60.0 AS value FROM range(300000) t(i)) TO '{tmp_path}/events.parquet'")
    got = ended(spark, plans.QUERIES["path_neighbours"](spark, str(tmp_path)), 60)
    assert len(got) == 45_000
    paths = [sorted((i for i in range(60) if i % 7 % 3 == u), key=int)[:4] for u in range(3)]
    for r in (r for r in got if r["query"] < 2000):
        mine = [x for x in paths[r["query"] % 7 % 3] if x != r["query"]]
        assert r["row"] == mine[r["rank"] - 1]


def test_nulls_give_no_facts(spark, tmp_path):
    con = duckdb.connect()
    value = "CASE WHEN i % 3 > 0 THEN (i * 7 % 60)::DOUBLE END"
    con.sql(f"COPY (SELECT i AS event_id, i % 7 AS user_id, if(i % 5 = 0, 'view', 'buy') AS event_type, {value} AS value FROM range(400) t(i)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    for name in ("path_neighbours", "path_posteriors"):
        got = plans.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(plans.ORACLES[name]).fetchall())
