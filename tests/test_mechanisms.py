from __future__ import annotations

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import session
from sparkloom.functions.measures import Measures
from sparkloom.operators import entities, ledger, ranking, reconcile, retention
from sparkloom.sources import files


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_asof_tier_like_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr("sparkloom.operators.skew.BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr("sparkloom.operators.skew.hot_keys.__defaults__", (0.1, 20))
    rng = random.Random(4)
    tiers = [(k, rng.randrange(50), rng.randrange(9)) for k in "abc" for _ in range(8)] + [("a", None, 5), (None, 1, 5)]
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([None, *range(60)])) for i in range(300)]
    want = {}
    for i, k, v in rows:
        met = [(least, pct) for t, least, pct in tiers if t == k and k is not None and least is not None and v is not None and least <= v]
        want[i] = max(met)[1] if met else None
    out = reconcile.asof_tier(spark.createDataFrame(rows, "id int, k string, v int"), spark.createDataFrame(tiers, "k string, least int, pct int"), ["k"], "v", "least", "pct").collect()
    assert {r.id: r.pct for r in out} == want and len(out) == 300


def test_split_over_tiers(spark):
    df = spark.createDataFrame([(1, 5), (2, 25), (3, 0), (4, None), (5, 100), (5, 100)], "id int, amount long")
    got = [tuple(r) for r in ledger.split_over_tiers(df, "amount", [(0, 10, 10), (10, 30, 33), (30, None, 50)]).orderBy("id", "tier").collect()]
    assert got[:3] == [(1, 5, 1, 5, 1), (2, 25, 1, 10, 1), (2, 25, 2, 15, 5)] and len(got) == 9
    assert all(sum(p for i, _, _, p, _ in got if i == k) == a * n for k, a, n in ((1, 5, 1), (2, 25, 1), (5, 100, 2)))


@pytest.mark.parametrize("largest", [10**6, 3])
def test_percentiles_and_ranks_like_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(ranking, "LARGEST_GROUP", largest)
    monkeypatch.setattr(ranking.ranked, "__defaults__", ("rn", None, largest))
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(12)])) for _ in range(400)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = {r.g: r for r in ranking.percentiles(df, ["g"], "v", {"p10": 0.1, "p90": 0.9, "p50": 0.5}).collect()}
    near = {r.g: r for r in ranking.percentiles(df, ["g"], "v", {"p95": 0.95}, nearest=True).collect()}
    for g in {r[0] for r in rows}:
        own = sorted(v for k, v in rows if k == g and v is not None)
        for name, q in (("p10", 10), ("p90", 90), ("p50", 50)):
            assert got[g][name] == (pytest.approx(np.percentile(own, q)) if own else None)
        assert near[g].p95 == (own[math.ceil(0.95 * len(own)) - 1] if own else None)
    whole = ranking.percentiles(df, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [np.median([v for _, v in rows if v is not None])]
    assert ranking.percentiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    for r in ranking.value_ranks(df, ["g"], "v").collect():
        own = [v for k, v in rows if k == r.g]
        above = [v for v in own if v is not None and (r.v is None or v > r.v)]
        assert (r.rk, r.dr) == (1 + len(above), 1 + len(set(above)))


def test_shortest_path(spark):
    edges = [("a", "x", "b"), ("c", "y", "b"), ("c", "x", "d"), ("a", "x", "e"), ("e", "z", "d"), ("p", "x", "q"), (None, "x", "a"), ("a", "x", "b")]
    df = spark.createDataFrame(edges, "src string, rel string, dst string")
    assert [tuple(r) for r in entities.shortest_path(df, "a", "d").orderBy("step").collect()] == [(0, "a", None, None), (1, "e", "x", "out"), (2, "d", "z", "out")]
    assert [tuple(r) for r in entities.shortest_path(df, "b", "d").orderBy("step").collect()] == [(0, "b", None, None), (1, "c", "y", "in"), (2, "d", "x", "out")]
    assert entities.shortest_path(df, "a", "q").count() == 0 and entities.shortest_path(df, "a", "a").count() == 1


def test_graph_of_documents_and_its_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A", (7, "N", (2, "R")), ["t", "t"]), (2, "B", (7, "N", (2, "R")), None), (None, "C", None, ["u"]), (1, "Aa", (7, "N", (2, "R")), [])], "id int, name string, nation struct<id int, name string, region struct<id int, name string>>, tags array<string>")
    nodes, edges = entities.graph_of_documents(docs)
    entities.write_graph(nodes, edges, str(tmp_path))
    nodes, edges = entities.read_graph(spark, str(tmp_path))
    assert {tuple(r) for r in edges.collect()} == {("s1", "in_nation", "n7"), ("s2", "in_nation", "n7"), ("n7", "in_region", "r2"), ("s1", "tagged", "t:t")}
    assert {tuple(r) for r in nodes.collect()} == {("s1", "supplier", "A"), ("s2", "supplier", "B"), ("n7", "nation", "N"), ("r2", "region", "R"), ("t:t", "tag", "t"), ("t:u", "tag", "u")}
    assert {(r.id, r.link, r.other) for r in entities.context(nodes, edges).where("id = 'n7'").collect()} == {("n7", "in_nation <-", "s1"), ("n7", "in_nation <-", "s2"), ("n7", "in_region ->", "r2")}


def test_find(spark):
    df = spark.createDataFrame([(1, " Roads ", ["Traffic!", None], "Count"), (2, "roads", None, "count"), (3, None, ["traffic"], "count"), (4, "Roads", ["traffic"], None)], "id int, c string, t array<string>, x string")
    assert [r.id for r in entities.find(df, {"c": "ROADS"}, {"t": "traffic"}, ["x"], "cou").collect()] == [1]
    assert {r.id for r in entities.find(df, {}, {}, []).collect()} == {1, 2, 3, 4}


def test_measures(spark):
    m = Measures().add("n", "count(*)").add("s", "sum(v)").add("mean", "[s] / [n]").add("share", "[s] / [s@all]").add("loop", "[loop] + 1").add("lost", "[gone]")
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0), (None, 2.0)], "g string, v double")
    assert {tuple(r) for r in m.evaluate(df, ["mean", "share"], ["g"]).collect()} == {("a", 2.0, 0.4), ("b", 4.0, 0.4), (None, 2.0, 0.2)}
    assert [tuple(r) for r in m.evaluate(df, ["n"], []).collect()] == [(4,)]
    for bad in ("loop", "lost", "nothing"):
        with pytest.raises(ValueError, match="unknown or defined by itself"):
            m.evaluate(df, [bad], [])


def test_erlang_has_no_limit(spark):
    loads = spark.createDataFrame([(0.0,), (1.0,), (100.0,), (20_000.0,), (None,), (-1.0,)], "load double")
    got = {r.load: r.n for r in loads.select("load", retention.erlang_agents("load", lambda n, b: b <= 0.02).alias("n")).collect()}
    for load in (1.0, 100.0, 20_000.0):
        b, n = 1.0, 0
        while b > 0.02:
            n += 1
            b = load * b / (n + load * b)
        assert got[load] == n
    assert got[0.0] == 1 and got[None] is None and got[-1.0] is None


def test_weighted_score(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0, 5.0), ("b", 0.5, 20.0, 5.0), ("c", None, None, 5.0)], "m string, f double, cost double, ms double")
    assert {r.m: (r.score, r["rank"]) for r in retention.weighted_score(df, "m", {"f": 0.5}, {"cost": 0.3, "ms": 0.2}).collect()} == {"a": (100.0, 1), "b": (45.0, 2), "c": (20.0, 3)}


def test_two_sinks_and_polygons(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1.5, 2.5), (2, None, None, 1.0)], "id int, name string, lon double, lat double")
    text, features = files.write_both(df, str(tmp_path / "both"), "lon", "lat", ["id", "name"])
    assert {tuple(r) for r in files.read_csv_declared(spark, text, df.schema.simpleString()[7:-1].replace(":", " ")).collect()} == {tuple(r) for r in df.collect()}
    assert {tuple(r) for r in files.read_features(spark, features, "id: INT, name: STRING").collect()} == {(1, "x", 1.5, 2.5), (2, None, None, None)}
    zones = spark.createDataFrame([(1, [(0.0, 1.0), (2.0, 3.0)]), (2, None)], "id int, ring array<struct<lon double, lat double>>")
    files.polygon_features(zones, "ring", ["id"]).write.text(str(tmp_path / "p"))
    assert {r.id: r.ring for r in files.read_polygons(spark, str(tmp_path / "p"), "id: INT").collect()} == {r.id: r.ring for r in zones.collect()}


def test_shared_folder(spark, monkeypatch):
    a = session.written(spark.range(5))
    assert a.count() == 5
    path = session._written[spark.sparkContext.applicationId][-1]
    fs = lambda: spark.sparkContext._jvm.java.io.File(path.removeprefix("file:")).exists()
    assert fs()
    session.release(spark)
    assert not fs()
    unset = SimpleNamespace(isDefined=lambda: False)
    cluster = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="all executors share"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=cluster, conf=SimpleNamespace(get=lambda *_: None)))


def test_asserted(spark):
    df = spark.createDataFrame([(1, "opening"), (2, "flow")], "id int, kind string")
    assert reconcile.asserted(df, F.col("id") > 0, "no").count() == 2
    with pytest.raises(Exception, match="several openings"):
        reconcile.asserted(df, F.col("kind") != "opening", "several openings").collect()
