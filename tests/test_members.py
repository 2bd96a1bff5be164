"""Gates, searches, leaves and proof records."""

import copy
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import members as M
from tidemark.operators import proofs
from tidemark.plans.predicates import TREES


def test_records_verify_and_tampering_fails():
    for q, p in ((10.0, 5000.0), (30.0, 40000.0), (50.0, 36000.0)):
        record = proofs.artifact(TREES, 0.1, 0.3, {"q": q, "p": p})
        assert proofs.check(record, TREES)
        for change in (lambda r: r["row"].update(q=26.0 if q < 25 else 24.0), lambda r: r.update(score=9.0), lambda r: r["parts"][0].update(value=3.0), lambda r: r.pop("sha256"), lambda r: r.update(schema="x")):
            bad = copy.deepcopy(record)
            change(bad)
            assert not proofs.check(bad, TREES)
        rehashed = copy.deepcopy(record)
        rehashed["parts"][0]["value"] += 1
        rehashed["score"] += 0.3
        body = {k: v for k, v in rehashed.items() if k != "sha256"}
        assert not proofs.check(body | {"sha256": proofs.digest(body)}, TREES)
    with pytest.raises(ValueError):
        proofs.canonical({"x": math.nan})


def test_sufficient_reason_is_sufficient():
    import random

    rng = random.Random(1)
    for _ in range(50):
        row = {"q": rng.uniform(0, 60), "p": rng.uniform(0, 60000)}
        score = lambda r: 0.1 + 0.3 * sum(proofs.path_of(t, r)[1] for t in TREES)
        reason = proofs.sufficient_reason(TREES, 0.1, 0.3, row, 0.5)
        for _ in range(50):
            other = {"q": rng.uniform(0, 60), "p": rng.uniform(0, 60000)}
            if all((c["above"] is None or other[c["feature"]] > c["above"]) and (c["at_most"] is None or other[c["feature"]] <= c["at_most"]) for c in reason):
                assert (score(other) >= 0.5) == (score(row) >= 0.5)


def test_client():
    client = proofs.DecisionClient({"m": (TREES, 0.1, 0.3)})
    reply = client.create("m", {"q": 1.0, "p": 2.0})
    assert client.models_list() == ["m"] and client.verify_decision(reply)
    assert not client.verify_decision(reply | {"model": "n"})
    for name, value in (("base", 100.0), ("rate", 0.9)):  # a forged record that is whole in itself
        body = {k: v for k, v in reply["record"].items() if k != "sha256"} | {name: value}
        body["score"] = body["base"] + body["rate"] * sum(p["value"] for p in body["parts"])
        forged = body | {"sha256": proofs.digest(body)}
        assert proofs.check(forged) and not client.verify_decision(reply | {"record": forged})
    assert not client.verify_decision(reply | {"record": None})


def test_program_search_finds_conjunction(spark):
    rows = [(k % 2, k // 2 % 2, k // 4 % 2, int(k % 2 == 1 and k // 4 % 2 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, c int, y int")
    assert M.conjunction_search(df, ["a", "b", "c"], "y", most=1)[0][0] == (("a", 1), ("c", 0))


def test_halving_keeps_base_and_best():
    quality = [0.5, 0.6, 0.9, 0.1]
    best, scores = M.halving(quality, lambda q, budget: [q + 0.001 * k for k in range(budget)], [3, 5, 8])
    assert best == 2 and 0 in scores


def test_hypercube_strata():
    x = M.latin_hypercube(16, 3, seed=5)
    assert all(sorted((x[:, k] * 16 - 0.5).round().astype(int)) == list(range(16)) for k in range(3))


def test_projection_keeps_side(spark):
    grid = [(b / 20, c / 20) for b in range(21) for c in range(21)]
    df = spark.createDataFrame(grid, "b double, c double")
    rows = df.select("b", M.preserve_class(F.col("b"), F.col("c")).alias("p")).collect()
    assert all((r["p"] > 0.5) == (r["b"] > 0.5) for r in rows)


def test_gate_rejects_noise_and_accepts_signal(spark):
    import random

    rng = random.Random(2)
    rows = []
    for k in range(900):
        y = k % 2
        rows.append((k % 3, y, 0.5 + 0.1 * rng.gauss(y - 0.5, 2), 0.5 + 0.2 * (rng.gauss(y - 0.5, 0.3)), rng.random()))
    df = spark.createDataFrame(rows, "fold int, y int, base double, good double, noise double")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.01)), F.lit(0.99))
    df = df.select("fold", "y", *(clip(F.col(c)).alias(c) for c in ("base", "good", "noise")))
    good, noise = (M.probability_gate(df, "y", "base", c, "fold") for c in ("good", "noise"))
    assert good["decision"] and good["wins"] > good["losses"], good
    assert good["auc_gain"] > noise["auc_gain"] and not noise["decision"] and not noise["rank"], noise


def test_temporal_gate_admits_history_only_where_it_helps(spark):
    import random

    from tidemark.operators.gates import temporal_gate

    rng = random.Random(3)
    rows = []
    for t in range(1200):
        h, noise, x = rng.random(), rng.random(), rng.random()
        rows.append((t // 4, x, h, noise, int(0.2 * x + h > 0.6 + 0.1 * rng.gauss(0, 1))))
    df = spark.createDataFrame(rows, "at long, x double, history double, noise double, y int")
    gate = lambda c: temporal_gate(df, "at", F.floor(F.col("at") / 50), "y", ["x"], [c], rounds=4)
    assert gate("history").selected and not gate("noise").selected


def test_exact_quantiles(spark):
    import random

    import numpy as np

    from tidemark.operators.quantile import at_ranks, quantiles

    rng = random.Random(4)
    xs = [rng.choice([rng.gauss(0, 1), 0.5, -1.0]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    assert np.allclose(quantiles(df, "x", shares), np.quantile(xs, shares))
    assert at_ranks(df, "x", [0, 1500, 9999]) == (3000, [min(xs), sorted(xs)[1500], max(xs)])
    assert quantiles(df.limit(0), "x", [0.5]) == [None]


def test_model_objects(spark, tmp_path):
    """Coverage of intervals, precision bounds that hold, records that only their own model accepts, and a saved copy."""
    import random

    from pyspark.sql import functions as F

    from tidemark import model

    rng = random.Random(8)
    rows = [(x, z, 3 * x + rng.gauss(0, 0.1 + z), int(x + rng.gauss(0, 0.1) > 0.5)) for x, z in ((rng.random(), rng.random()) for _ in range(3000))]
    df = spark.createDataFrame(rows, "x double, z double, y double, c int")
    fitted = model.Regressor(["x", "z"], rounds=8, rate=0.4).fit(df, "y")
    seen = fitted.interval(df).agg(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")), F.corr("z", F.col("upper") - F.col("lower"))).first()
    assert seen[0] > 0.86 and seen[1] > 0.5
    row = {"x": 0.9, "z": 0.2}
    record = fitted.proof(row)
    assert fitted.verify(record) and not fitted.verify(record | {"base": 5.0})
    assert "x" in fitted.reason(row, 1.5)
    fitted.save(spark, str(tmp_path / "m"))
    again = model.Regressor.load(spark, str(tmp_path / "m"))
    assert again.verify(record) and again.interval(df.limit(5)).collect() == fitted.interval(df.limit(5)).collect()
    judge = model.Classifier(["x", "z"], rounds=5, rate=0.5).fit(df, "c")
    found = judge.certify(df)
    assert found.where("precision_low > 0.9").agg(F.avg((F.col("label") == F.col("c")).cast("double"))).first()[0] > 0.9
    assert found.agg(F.avg(F.array_contains("labels", F.col("c")).cast("double"))).first()[0] > 0.86


def test_boosting_is_the_plain_one(spark):
    """Two rounds of squared loss against plain numpy over the same bins."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators import boost

    rng = np.random.default_rng(2)
    x = np.round(rng.random((800, 2)), 2)
    y = x[:, 0] * 2 + (x[:, 1] > 0.4) + rng.normal(scale=0.1, size=800)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    cuts = boost.edges(df, ["a", "b"], 16)
    score = np.full(800, y.mean())

    def grow(rows, depth, g):
        best = (0.0, None, None)
        for f, name in enumerate("ab"):
            for t in cuts[name]:
                left = rows & (x[:, f] <= t)
                right = rows & ~left
                if min(left.sum(), right.sum()) >= 20:
                    part = lambda m: g[m].sum() ** 2 / (m.sum() + 1.0)
                    gain = round(part(left) + part(right) - part(rows), 9)
                    if gain > best[0]:
                        best = (gain, f, t)
        if not depth or best[1] is None:
            score[rows] += 0.2 * -g[rows].sum() / (rows.sum() + 1.0)
            return
        left = rows & (x[:, best[1]] <= best[2])
        grow(left, depth - 1, g)
        grow(rows & ~left, depth - 1, g)

    for _ in range(2):
        grow(np.ones(800, dtype=bool), 2, score - y)
    model = boost.fit(df, ["a", "b"], "y", rounds=2, depth=2, bins=16)
    got = np.array([r["p"] for r in model.predict(df).select(F.col("prediction").alias("p")).collect()])
    assert np.allclose(got, score, atol=1e-9)
    many = boost.fit(df, ["a", "b"], "y", rounds=24, depth=2, bins=16, subsample=0.7, colsample=0.5, leaves=4)
    raw = df.select(many.scores()[0].alias("p")).collect()
    assert np.allclose([r["p"] for r in raw], [r["prediction"] for r in many.predict(df).collect()])


def test_focus_groups_keep_the_top_and_spread():
    from tidemark.operators.members import focus_groups

    assert focus_groups(list("abc"), 5) == list("abc")
    assert focus_groups(list(range(20)), 6) == [0, 1, 2, 3, 11, 19]
    assert focus_groups(list(range(9)), 1) == [0]
