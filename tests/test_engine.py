from __future__ import annotations

import random
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import entities, ledger, reconcile, retention
from sparkloom.operators.allocate import largest_remainder, rounded_then_corrected
from sparkloom.operators.ranking import ranked
from sparkloom.operators.skew import hot_keys, salted_join
from sparkloom.sources import files
from sparkloom.streaming.windows import hourly_counts


def test_ranked_with_one_huge_group(spark):
    rng = random.Random(3)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", rng.randrange(10**6), i, None if i % 11 == 0 else i % 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, x long, id long, v long").repartition(7)
    call = lambda most: {r.id: (r.rn, r.run) for r in ranked(df, ["g"], [F.col("x").desc(), F.col("id")], "rn", {"run": "v"}, most).collect()}
    state, want = {}, {}
    for g, x, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        n, s = state.get(g, (0, None))
        s = s if v is None else (s or 0) + v
        state[g] = want[i] = (n + 1, s)
    assert call(100) == want and call(10**6) == want
    assert ranked(df.limit(0), ["g"], [F.col("id")]).count() == 0
    assert [r.rn for r in ranked(df, [], [F.col("id")], largest=10).orderBy("id").collect()] == list(range(1, 4001))


def test_salted_join_keeps_rows(spark):
    big = spark.range(1000).select((F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 40)).alias("k"), F.col("id").alias("b"))
    small = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("s"))
    hot = hot_keys(big, ["k"], least=20)
    assert len(hot) == 1 and hot_keys(big.limit(0), ["k"]) == {}
    for how in ("inner", "left"):
        plain = sorted(map(tuple, big.join(small, "k", how).select("k", "b", "s").collect()), key=str)
        assert sorted(map(tuple, salted_join(big, small, ["k"], ["b"], hot, how).select("k", "b", "s").collect()), key=str) == plain


def shares(spark, f, weights, total, tie="pos"):
    df = spark.createDataFrame([("g", i, w, total) for i, w in enumerate(weights)], "g string, pos int, w long, total long")
    got = [[r.cents for r in f(df, ["g"], "total", "w", [F.col(tie)], largest=most).orderBy("pos").collect()] for most in (2, 10**6)]
    assert got[0] == got[1]
    return got[0]


def test_allocation(spark):
    assert shares(spark, largest_remainder, [1, 1, 1], 10000) == [3334, 3333, 3333]
    assert shares(spark, largest_remainder, [0, 0, 0], 100) == [34, 33, 33]
    assert shares(spark, largest_remainder, [5, 0, None], 99) == [99, 0, 0]
    assert shares(spark, rounded_then_corrected, [1, 1, 1, 1, 1, 1], 10) == [1, 1, 2, 2, 2, 2]  # each rounds up to 2: two too many
    assert shares(spark, rounded_then_corrected, [1, 1, 1], 10000) == [3334, 3333, 3333]
    rng = random.Random(5)
    for f in (largest_remainder, rounded_then_corrected):
        w = [rng.randrange(10**9) for _ in range(17)]
        got = shares(spark, f, w, 123_456_789)
        assert sum(got) == 123_456_789 and all(abs(g - 123_456_789 * x / sum(w)) <= 1 for g, x in zip(got, w, strict=True))


def test_ledger_like_decimal(spark):
    rng = random.Random(6)
    rows = [(f"p{rng.randrange(3)}", i, rng.random() < 0.4, rng.randrange(1, 60), rng.randrange(100, 90_000)) for i in range(400)] + [(None, 1, None, None, 500), (None, 2, True, 1, None)]
    df = spark.createDataFrame(rows, "k string, seq int, issue boolean, qty long, cents long")
    got = {(r.k, r.seq): (r.on_hand, r.value_left, r.issue_value, r.went_negative) for r in ledger.perpetual_average_cost(df, "k", [F.col("seq")], "issue", "qty", "cents").collect()}
    state = {}
    for k, seq, issue, qty, cents in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        stock, worth, bad = state.get(k, (0, Decimal(0), False))
        taken = Decimal(0)
        if issue:
            if stock > 0:
                x = worth * (qty or 0) / stock
                taken = x.copy_abs().quantize(Decimal(1), ROUND_HALF_UP).copy_sign(x)
            stock, worth = stock - (qty or 0), worth - taken
            bad = bad or stock < 0
        else:
            stock, worth = stock + (qty or 0), worth + (cents or 0)
        state[k] = (stock, worth, bad)
        assert got[k, seq] == (stock, int(worth), int(taken), bad)


@pytest.mark.parametrize(("rate", "periods"), [(600, 6), (0, 6), (1200, 1), (475, 36)])
def test_loans_end_at_zero(spark, rate, periods):
    df = spark.createDataFrame([(1, 1_000_000), (2, 7), (3, 0)], "id int, principal long")
    rows = ledger.amortization(df, "principal", rate, periods).orderBy("id", "period").collect()
    assert len(rows) == 3 * periods
    for i, principal in ((1, 1_000_000), (2, 7), (3, 0)):
        mine = [r for r in rows if r.id == i]
        assert mine[-1].balance == 0 and sum(r.principal_part for r in mine) == principal and all(r.paid == r.interest + r.principal_part for r in mine)


def test_brackets(spark):
    df = spark.createDataFrame([(0, 25), (25, 10), (8, 4)], "before long, n long")
    got = [r.charge for r in ledger.through_brackets(df, F.col("before"), F.col("n"), [(0, 10, 1), (10, 20, 2), (20, None, 5)]).collect()]
    assert got == [10 + 20 + 25, 50, 2 + 4]


def test_backlog(spark):
    d = lambda y, m, x=1: datetime(y, m, x)
    df = spark.createDataFrame([(d(2023, 11), d(2023, 11, 9)), (d(2023, 11), d(2024, 2)), (d(2024, 1), None), (None, d(2024, 1))], "o timestamp, c timestamp")
    rows = [tuple(r) for r in reconcile.backlog(df, F.col("o"), F.col("c")).orderBy("month").collect()]
    assert rows == [("2023-11", 0, 2, 1, 1), ("2023-12", 1, 0, 0, 1), ("2024-01", 1, 1, 0, 2), ("2024-02", 2, 0, 1, 1)]
    assert reconcile.backlog(df.limit(0), F.col("o"), F.col("c")).count() == 0


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 100), (2, 50), (3, 10), (None, 1)], "k int, v long")
    b = spark.createDataFrame([(1, 105), (2, 70), (4, 1), (None, 1)], "k int, v long")
    got = {(r.k, r.status) for r in reconcile.reconcile(a, b, "k", "v", 5).collect()}
    assert got == {(1, "match"), (2, "mismatch"), (3, "only_left"), (4, "only_right"), (None, "only_left"), (None, "only_right")}


def test_overlaps_like_brute_force(spark):
    rng = random.Random(8)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        s = rng.randrange(20 * 3600)
        rows.append((i % 3, i, datetime.fromtimestamp(t0.timestamp() + s), datetime.fromtimestamp(t0.timestamp() + s + rng.choice([0, 600, 3600, 9000]))))
    df = spark.createDataFrame(rows, "k int, i int, s timestamp, e timestamp")
    got = [tuple(r) for r in reconcile.overlapping_pairs(df, ["k"], "i", "s", "e").collect()]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_movement_uses_the_ledger_period_before(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 3, 15), ("b", 1, 5), ("c", 3, 7)], "k string, p int, v long")
    got = {r.p: tuple(r)[1:] for r in retention.movement(df, "k", "p", "v").collect()}
    assert got == {1: (0, 15, 0, 0, 0, 15), 3: (15, 7, 5, 0, 5, 22)}


def test_entities_and_graph(spark):
    df = spark.createDataFrame([(1, "a@x", None, "A"), (2, " a@x ", "5", "B"), (3, "", "5", "C"), (4, None, None, None)], "seq long, email string, phone string, name string")
    keyed = df.withColumn("key", entities.match_key(F.col("email"), F.col("phone"), F.col("name")))
    got = {r.key: (r.copies, r.phone, r.name, r.name_conflict) for r in entities.merge_entities(keyed, "key", "seq", ["phone", "name"]).collect()}
    assert got == {"0:a@x": (2, "5", "A", True), "1:5": (1, "5", "C", False), "row:4": (1, None, None, False)}
    edges = spark.createDataFrame([("a", "r", "b"), ("c", "r", "b"), ("c", "r", "d"), ("x", "r", "y"), (None, "r", "a")], "src string, rel string, dst string")
    assert {tuple(r) for r in entities.distances(edges, "a").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "a"}, "geometry": {"type": "Point", "coordinates": [-63.5, 44.6]}}, {"type": "Feature", "properties": {"n": "b"}, "geometry": null}]}')
    assert [tuple(r) for r in files.read_feature_collection(spark, str(tmp_path / "c.json"), "n: STRING").collect()] == [("a", -63.5, 44.6), ("b", None, None)]
    (tmp_path / "t.csv").write_text('id,note\n1,"a ""b"", c"\n2,""\n')
    assert [tuple(r) for r in files.read_csv_text(spark, str(tmp_path / "t.csv"), ["id", "note"]).collect()][0] == ("1", 'a "b", c')
    df = spark.createDataFrame([("1",)], "`Vendor Name` string")
    assert files.canonical_headers(df, {"vendor": ("vendor_name",), "gone": ()}).first().asDict() == {"vendor": "1", "gone": None}


def test_stream_and_batch_agree(spark, tmp_path):
    src = tmp_path / "in"
    events = spark.createDataFrame([(datetime(2024, 1, 1, h, m), t) for h in range(3) for m in (1, 50) for t in "ab"], "ts timestamp, event_type string")
    events.write.parquet(str(src))
    stream = hourly_counts(spark.readStream.schema(events.schema).parquet(str(src)), "1 hour")
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, hourly_counts(events).collect()))


def test_dominant_variant(spark):
    rows = [("k", "Rare", 1), ("k", "Usual", 2), ("k", "Usual", 2), ("k", " ", 99), ("t", "b", 3), ("t", "a", 3), ("m", "two", 1), ("m", "two", 1), ("m", "one", 2), ("z", "x", None), (None, "y", 5)]
    got = entities.dominant_variant(spark.createDataFrame(rows, "k string, v string, a long"), "k", "v", "a", "name").collect()
    assert {r.k: r.name for r in got} == {"k": "Usual", "t": "a", "m": "two", "z": "x"}


def test_resolve_terms(spark):
    nodes = spark.createDataFrame([("e:fire", "element", "Fire"), ("m:fire", "materia", "Fire"), ("m:ice", "materia", "Blizzard"), ("a:x", "area", "Ice"), ("b:y", "area", "Twin"), ("a:y", "area", "twin")], "id string, type string, label string")
    want = {"FIRE": "m:fire", "e:fire": "e:fire", " ice ": "m:ice", "ICE": "a:x", "TWIN": "a:y", "nothing": None}
    terms = spark.createDataFrame([(t,) for t in [*want, "FIRE", " ", None]], "term string")
    assert {r.term: r.id for r in entities.resolve_terms(terms, nodes, "m:", "materia").collect()} == want


def test_retention_rates(spark):
    moved = spark.createDataFrame([(1, 0, 50, 0, 0, 0), (2, 100, 0, 30, 10, 20)], "m int, opening long, new long, expansion long, contraction long, churned long")
    got = {r.m: (r.churn_rate, r.grr, r.nrr) for r in retention.rates(moved).collect()}
    assert got == {1: (None, None, None), 2: (0.2, 0.7, 1.0)}


def test_operators_of_named_ids_exist():
    from sparkloom.plans import engine

    for name in ("b22_open_aging", "b25_maturity_ladder", "b43_erlang_c_agents", "b59_shift_coverage", "b59_rejected_assignments", "b59_double_booking", "b60_hours_anomalies", "b60_milestones", "b72_display_name", "b82_retention_rates", "b95_term_resolution"):
        assert f"ref_{name}" in engine.R.sql


def test_distances_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"c{i}", "next", f"c{i + 1}") for i in range(53)], "src string, rel string, dst string")
    assert {r.id: r.distance for r in entities.distances(edges, "c0").collect()} == {f"c{i}": i for i in range(54)}
    short = edges.where("src IN ('c0', 'c1', 'c2')")
    assert entities.distances(short, "c0", most=3).count() == 4
    with pytest.raises(ValueError, match="farther than 2"):
        entities.distances(short, "c0", most=2)
