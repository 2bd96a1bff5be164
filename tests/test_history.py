"""Hand-computed decays, causality, tie atomicity and invariance."""

import math
import random
import time

from pyspark.sql import functions as F

from tidemark.operators import history as H

HOUR = 3_600_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "user string, us long, v double")


def test_decay_by_hand(spark):
    rows = [("a", h * HOUR, 1.0) for h in (0, 1, 1, 3)] + [("b", 0, 1.0), ("b", 8 * HOUR, 1.0)]
    tau = 7200.0
    for block in (None, HOUR, 5 * HOUR):
        got = {(r["user"], r["us"] // HOUR): r["n_t"] for r in H.decayed(frame(spark, rows), "user", "us", {"n": F.lit(1.0)}, {"t": tau}, block).collect()}
        one = math.exp(-3600 / tau)
        assert got[("a", 0)] == 0 and got[("b", 0)] == 0
        assert math.isclose(got[("a", 1)], one)
        assert math.isclose(got[("a", 3)], one * math.exp(-7200 / tau) + 2 * math.exp(-7200 / tau))


def test_prefix_consistency_and_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(40) * HOUR, rng.random()) for _ in range(200)]
    run = lambda r: {(x["user"], x["us"]): round(x["v_t"], 9) for x in H.decayed(frame(spark, r), "user", "us", {"v": F.col("v")}, {"t": 9000.0}).collect()}
    whole = run(rows)
    early = run([r for r in rows if r[1] <= 20 * HOUR])
    assert all(whole[k] == v for k, v in early.items())
    rng.shuffle(rows)
    assert run(rows) == whole


def test_context_by_hand(spark):
    rows = [("a", h * HOUR, m) for h, m in ((0, 1.0), (1, 2.0), (1, 4.0), (3, -1.0))]
    got = {r["us"] // HOUR: r for r in H.context(frame(spark, rows), "user", "us", F.col("v"), 3600.0).collect()}
    assert got[3]["lag1"] == 3.0 and got[3]["lag2"] == 1.0 and got[3]["transition"] == 3.0
    assert math.isclose(got[3]["gap"], math.log1p(2)) and math.isclose(got[3]["previous_gap"], math.log1p(1))


def test_frozen_state(spark):
    import pytest

    rows = frame(spark, [("a", 0, 1.0), ("a", 2 * HOUR, 1.0)])
    state = H.final_state(rows, "user", "us", {"n": F.lit(1.0)}, {"t": 3600.0})
    new = frame(spark, [("a", 3 * HOUR, 1.0), ("x", HOUR, 1.0)])
    got = {r["user"]: r["n_t"] for r in H.frozen(new, state, "user", "us", {"n": F.lit(1.0)}, {"t": 3600.0}).collect()}
    assert math.isclose(got["a"], math.exp(-1) + math.exp(-3)) and got["x"] == 0
    with pytest.raises(Exception, match="not after"):
        H.frozen(frame(spark, [("a", HOUR, 1.0)]), state, "user", "us", {"n": F.lit(1.0)}, {"t": 3600.0}).collect()


def test_causal_target_does_not_leak(spark):
    rows = [(k, g, float(y)) for k, g, y in zip("abaabb", (0, 0, 1, 1, 2, 2), (1, 0, 0, 1, 1, 0), strict=True)]
    got = {(r["user"], r["us"]): r["encoded"] for r in H.causal_target(frame(spark, rows), "user", "us", "v", 2.0, 0.5, F.col("us")).collect()}
    assert got[("a", 0)] == got[("b", 0)] == 0.5
    assert got[("a", 1)] > 0.5


def test_live_history_matches_batch(spark, tmp_path):
    from tidemark.streaming.live import live_decay

    rng = random.Random(2)
    rows = [(rng.randrange(4), t * HOUR) for t in sorted(rng.randrange(30) for _ in range(80))]
    for k in range(4):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "user long, us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, us long").parquet(str(tmp_path / "in"))
    q = live_decay(stream, "user", "us", {"t": 7200.0}).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["user"], r["us"]): r["n_t"] for r in H.decayed(spark.createDataFrame(rows, "user long, us long"), "user", "us", {"n": F.lit(1.0)}, {"t": 7200.0}).collect()}
    got = [r for r in spark.table("live").collect() if not r["late"]]
    assert got and all(math.isclose(r["v_t"], want[(r["entity"], r["us"])], rel_tol=1e-9, abs_tol=1e-12) for r in got)


def test_live_history_marks_nulls_late(spark, tmp_path):
    from tidemark.streaming.live import live_decay

    rows = [(1, 0), (1, None), (None, HOUR), (None, None), (1, HOUR)]
    spark.createDataFrame(rows, "user long, us long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, us long").parquet(str(tmp_path / "in"))
    q = live_decay(stream, "user", "us", {"t": 3600.0}, forget_after_ms=3_600_000).writeStream.format("memory").queryName("nulls").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(100):  # with a timeout there is always a next batch, so wait for the rows
        time.sleep(0.5)
        if q.exception() or spark.table("nulls").count() == 5:
            break
    q.stop()
    assert q.exception() is None
    got = sorted(((r["entity"], r["us"], r["late"], round(r["v_t"], 6)) for r in spark.table("nulls").collect()), key=repr)
    assert got == sorted([(1, 0, False, 0.0), (1, HOUR, False, round(math.exp(-1), 6)), (1, None, True, 0.0), (None, HOUR, True, 0.0), (None, None, True, 0.0)], key=repr)
