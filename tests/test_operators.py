"""Datalog, graphs, predicates, splits, boosting, sources."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boost, datalog, encode, graph, predicates, schema, splits
from tidemark.operators.evidence import bit_pair_information
from tidemark.sources import readers


def test_strata_reject_negative_recursion():
    with pytest.raises(ValueError, match="negation"):
        datalog.strata([(("p", "X"), [("q", "X"), ("not", ("p", "X"))])])


def test_proofs_hold_and_tampering_fails():
    rules = [(("path", "X", "Y"), [("link", "X", "Y")]), (("path", "X", "Z"), [("path", "X", "Y"), ("link", "Y", "Z")]), (("big", "X"), [("n", "X", "V"), ("is", "W", ("+", "V", "1")), ("cmp", ">", "W", "3")])]
    base = {("link", "a", "b"), ("link", "b", "c"), ("link", "c", "a"), ("n", "a", "4")}
    proof = datalog.prove(("path", "a", "a"), rules, base)
    assert datalog.check(proof, base, rules)
    assert "link(a, b)  [base]" in datalog.show(proof)
    assert datalog.check(datalog.prove(("big", "a"), rules, base), base, rules)
    assert not datalog.check((("path", "a", "z"), proof[1], proof[2]), base, rules)
    assert not datalog.check(proof, base - {("link", "b", "c")}, rules)
    assert not datalog.check(proof, base, rules[:1])
    loop = [("p",), (("p",), [("p",)]), []]
    loop[2] = [loop]
    assert not datalog.check(loop)
    assert not datalog.check(None)
    # A proof may not lean on the absence of what the rules derive.
    both = [(("p", "X"), [("q", "X")]), (("r", "X"), [("s", "X"), ("not", ("p", "X"))])]
    facts = {("q", "a"), ("s", "a"), ("s", "b")}
    assert datalog.check(datalog.prove(("r", "b"), both, facts), facts, both)
    assert not datalog.check((("r", "a"), both[1], [(("s", "a"), "base", [])]), facts, both)
    assert not datalog.check(datalog.prove(("r", "b"), both, facts))
    assert datalog.prove(("path", "a", "z"), rules, base) is None


def test_mining_equals_exhaustive(spark):
    import itertools
    import random

    for seed in range(2):
        rng = random.Random(seed)
        t = {(rng.choice("pqr"), f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(40)}
        edges = spark.createDataFrame(sorted(t), "rel string, head string, tail string")
        sources = spark.createDataFrame([(f"n{k}",) for k in range(12)], "source string")
        want = {}
        for n in (1, 2, 3):
            for chain in itertools.product("pqr", repeat=n):
                for s in range(12):
                    now = {f"n{s}"}
                    for r in chain:
                        now = {b for (q, a, b) in t if q == r and a in now}
                    if now:
                        want[("→".join(chain), f"n{s}")] = len(now)
        got = {(r["chain"], r["source"]): r["n"] for r in graph.observed_chains(edges, sources, 3).collect()}
        assert got == want


def test_promotion_finds_deep_chain(spark):
    t = spark.createDataFrame([("r1", "u0", "a"), ("r1", "u1", "b"), ("r2", "a", "c"), ("r2", "b", "d"), ("r3", "c", "e")], "rel string, head string, tail string")
    s = spark.createDataFrame([("u0",), ("u1",), ("u2",)], "source string")
    wide = graph.features(graph.promoted(t, ("r1", "r2")), s, [("@r1→r2", "r3")]).orderBy("source").collect()
    assert [r[1] for r in wide] == [1, 0, 0]


def test_xor_is_found(spark):
    rows = [(k, k % 2, k // 2 % 2, k // 4 % 2, (k % 2) ^ (k // 2 % 2)) for k in range(64)]
    got = bit_pair_information(spark.createDataFrame(rows, "id int, b0 int, b1 int, b2 int, y int"), "id", ["b0", "b1", "b2"], "y").orderBy(F.desc("information")).first()
    assert (got["a"], got["b"]) == ("b0", "b1") and got["information"] > 0.69


def test_intervals_merge(spark):
    rows = [(8.0, 9.0), (0.0, 2.0), (-2.0, 1.0), (1.0, 3.0), (9.0, 10.0), (5.0, 5.0)]
    got = predicates.merged_intervals(spark.createDataFrame([("k", *r) for r in rows], "k string, low double, high double"), ["k"], "low", "high")
    assert sorted((r["low"], r["high"]) for r in got.collect()) == [(-2.0, 3.0), (8.0, 10.0)]


def test_predicate_names():
    p = predicates.Predicate("exception", branches=((("a", 1),), (("b", 1), ("c", 0))))
    assert predicates.described(p) == "(a) AND NOT (b AND NOT c)"


def test_strict_columns_and_augment(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert encode.strict_columns(df, ["b", "a"]).columns == ["b", "a"]
    for fitted in (["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            encode.strict_columns(df, fitted)
    with pytest.raises(ValueError):
        encode.augment(df, {"a": F.lit(1)})


def test_unique_ids_carry_no_target(spark):
    df = spark.createDataFrame([(k, float(k % 2)) for k in range(30)], "k int, y double")
    got = encode.oof_target(df, "k", "y", F.pmod("k", F.lit(5)), 20.0, "e").select("e").distinct().count()
    assert got == 1


def test_future_cut_is_strict(spark):
    df = spark.createDataFrame([(g, y) for g in range(12) for y in [g % 2] * 8], "g long, y int")
    cut = splits.future_cut(df, "g", F.floor(F.col("g") / 4), least_train=10, least_valid=10).first()
    assert cut["train"] == cut["cut"] * 8 and cut["train"] + cut["valid"] == 96


def test_folds_are_even(spark):
    df = spark.createDataFrame([(k, "ab"[k % 7 == 0]) for k in range(210)], "k long, c string")
    counts = splits.folds(df, "k", 5, "c").groupBy("c", "fold").count().collect()
    assert {r["count"] for r in counts if r["c"] == "b"} == {6} and {r["count"] for r in counts if r["c"] == "a"} == {36}


def test_boosting_learns_interaction(spark):
    import random

    rng = random.Random(4)
    rows = [(x, z, float((x > 0.5) != (z > 0.4))) for x, z in ((rng.random(), rng.random()) for _ in range(2000))]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    model = boost.fit(df, ["x", "z"], "y", "binary", rounds=4, depth=3, rate=0.5, bins=16)
    hits = model.predict(df).agg(F.avg(((F.col("probability_1") > 0.5).cast("double") == F.col("y")).cast("double"))).first()[0]
    assert hits > 0.9


def test_schema_roles(spark):
    rows = [(k % 10, f"2024-01-{k % 28 + 1:02d} 00:{k % 60:02d}:00", 1.5 * k, k) for k in range(300)]
    df = spark.createDataFrame(rows, "user_id long, event_time string, amount double, step long")
    best = schema.discover(df)[0]
    assert (best.entity, best.timestamp, best.values) == ("user_id", "event_time", ("amount",))


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    readers.write_csv(df, str(tmp_path / "x.csv"), ["k"])
    assert [r["k"] for r in readers.read_csv(spark, str(tmp_path / "x.csv"), "k int, v string").collect()] == [1, 2]
    (tmp_path / "kg.txt").write_text("a\tr\tb\nbroken line\nb\tr\tc\n")
    t = readers.read_triples(spark, str(tmp_path / "kg.txt"), inverses=True)
    assert t.count() == 4 and readers.is_graph(t)
    readers.save_model(spark, str(tmp_path / "m"), "tree", {"base": 0.5})
    assert readers.load_model(spark, str(tmp_path / "m"), "tree") == {"base": 0.5}
    with pytest.raises(ValueError):
        readers.load_model(spark, str(tmp_path / "m"), "other")
    (tmp_path / "s.json").write_text('{"splits": [[{"train": [1, 2], "test": [3]}]]}')
    train, test = readers.read_manifest(spark, str(tmp_path / "s.json"))
    assert train.count() == 2 and test.count() == 1
    df.write.parquet(str(tmp_path / "p"))
    assert readers.read_rows(spark, str(tmp_path / "p"), "k", 2, 9).count() == 1
    readers.write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_induced_rules_mine_all_relations(spark, monkeypatch):
    from tidemark.operators import graph
    from tidemark.plans import QUERIES

    seen = set()
    mine = graph.induced_rules
    monkeypatch.setattr(graph, "induced_rules", lambda known, target: seen.update(r["rel"] for r in known.select("rel").distinct().collect()) or mine(known, target))
    QUERIES["induced_rules"](spark, "/root/testdata/sf0.001")
    assert {"placed", "supplied_by", "placed_inv", "supplied_by_inv"} <= seen
