from __future__ import annotations

import math
import random
import re
from datetime import datetime

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import nearby, orphans, rejects
from sparkloom.operators.multivalue import explode_packed, split_packed
from sparkloom.plans.landing import LAYOUTS

AT = datetime(2024, 1, 1)


# References -------------------------------------------------------------------
def found(children, parents):
    keys = dict(child_key="k", parent_key="k", child_time="at", parent_time="at", parent_status="status", parent_tie="id")
    return {(r.id, r.reason) for r in orphans.orphan_references(children, parents, **keys).collect()}


KIDS = "id long, k string, at timestamp, status string"


def test_orphans(spark):
    day = lambda d: datetime(2024, 1, d)
    parents = spark.createDataFrame([(1, "A1", day(1), "INS"), (2, " a2 ", day(1), "INS"), (3, "A2", day(2), " rem "), (4, "A3", day(9), None), (5, None, day(1), "REM"), (6, "A4", day(3), "REM"), (7, "A4", day(3), "INS")], KIDS)
    kids = spark.createDataFrame([(1, "a1 ", day(1), None), (2, "A2", day(1), None), (3, "A3", day(3), None), (4, "A9", day(1), None), (5, "none", day(1), None), (6, None, day(1), None), (7, "", day(1), None), (4, "A9", day(1), None), (8, "A4", day(4), None)], KIDS)
    assert found(kids, parents) == {(2, "deleted"), (3, "late"), (4, "missing")}
    clash = kids.withColumns({"reason": F.lit("x"), "_key": F.lit("y"), "_last": F.lit("z"), "n": F.lit(1)})
    assert found(clash, parents) == found(kids, parents)
    assert found(kids, parents.limit(0)) == {(i, "missing") for i in (1, 2, 3, 4, 8)}
    assert found(kids.limit(0), parents) == set()


def test_filter_proves_what_it_rejects(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("K"), "id").alias("k"))
    hashes = np.array([r[0] for r in spark.range(60_000).select(F.xxhash64(F.concat(F.lit("K"), "id"))).collect()])
    for bits, parts in ((64 << 20, 16), (1 << 16, 16), (1 << 15, 2)):  # in one part, in several, and too small
        f = orphans.bloom_filter(keys, "k", 30_000, bits, parts)
        passed = f.might_contain(hashes)
        assert passed[:30_000].all() and len(f.parts) == min(parts, -(-300_000 // bits))
        assert parts == 2 or passed[30_000:].mean() < 0.05
    assert not orphans.bloom_filter(keys.limit(0), "k", 0).might_contain(hashes).any()


def test_filter_of_a_key_with_nearly_the_largest_hash(spark):
    keys = spark.createDataFrame([("HS290291",)], "k string")  # one of some 100,000 keys has such a hash
    h = keys.select(F.xxhash64("k")).first()[0]
    assert h + 3 * (h >> 17) >= 1 << 63
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert orphans.bloom_filter(keys, "k", 1).might_contain(np.array([h])).all()


def test_orphans_with_a_filter_that_is_too_small(spark, monkeypatch):
    monkeypatch.setattr(orphans.bloom_filter, "__defaults__", (1 << 15, 2))
    parents = spark.range(5000).select("id", F.concat(F.lit("K"), F.col("id") * 2).alias("k"), F.lit(AT).alias("at"), F.lit("INS").alias("status"))
    kids = spark.range(10000).select("id", F.concat(F.lit("k"), "id").alias("k"), F.lit(AT).alias("at"), F.lit("x").alias("status"))
    assert found(kids, parents) == {(i, "missing") for i in range(1, 10000, 2)}


def test_orphans_without_broadcast_and_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.operators.skew.BROADCAST_ROWS", 0)
    monkeypatch.setattr("sparkloom.operators.skew.hot_keys.__defaults__", (0.002, 10))
    parents = spark.range(50).select("id", F.concat(F.lit("K"), "id").alias("k"), F.lit(AT).alias("at"), F.when(F.col("id") == 0, "REM").otherwise("INS").alias("status"))
    kids = spark.range(900).select("id", F.concat(F.lit("k"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 60)).alias("k"), F.lit(AT).alias("at"), F.lit("x").alias("status"))
    want = {(i, "deleted") for i in range(900) if i < 300 or i % 60 == 0} | {(i, "missing") for i in range(300, 900) if i % 60 >= 50}
    assert found(kids, parents) == want


# Rows that fail to parse ---------------------------------------------------------
def brute_reason(line: str, layout) -> str | None:
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            end, text = at + 1, []
            while True:
                nxt = line.find('"', end)
                if nxt < 0:
                    return "quoting"
                text.append(line[end:nxt])
                if line[nxt + 1 : nxt + 2] == '"':
                    text.append('"')
                    end = nxt + 2
                    continue
                break
            if nxt + 1 < n and line[nxt + 1] != ",":
                return "quoting"
            fields.append("".join(text))
            at = nxt + 1
        else:
            nxt = line.find(",", at)
            nxt = n if nxt < 0 else nxt
            if '"' in line[at:nxt]:
                return "quoting"
            fields.append(line[at:nxt])
            at = nxt
        if at >= n:
            break
        at += 1
    if len(fields) != len(layout.columns):
        return "columns"
    for c in layout.integers:
        t = fields[layout.columns.index(c)].strip(" ")
        if t and not (re.fullmatch("[0-9]+", t) and int(t) < 2**31):
            return "value"
    for c in layout.decimals:
        t = fields[layout.columns.index(c)].strip(" ")
        if t and not re.fullmatch(r"[0-9]+(\.[0-9]+)?", t):
            return "value"
    return None


def test_lines_against_brute_force(spark):
    rng, layout = random.Random(1), rejects.Layout(("a", "b", "c"), integers=("a",), decimals=("c",))
    pieces = ["1", "12", '"', '""', ",", ",", "x", "\n", " ", "2147483647", "2147483648", "1.5", "1..2", '"a,b"', '"q""q"', '"1"', "", "٣"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["1,2\x1e3,4", "1,2,3\x1e", "1," * 30_000, "," * 20_001, "1,\r,2", "\n1,2,3", "1,2\r\n3,4", " ,, ", ",,", "#1,2,3"] + ['1,"' + "x" * 200_000 + '",2', "y" * 300_000, '"' + '""' * 100_000 + '",1,1', "", "1,2,3\n"]
    df = spark.createDataFrame([(i, "k", x) for i, x in enumerate(lines)] + [(-1, "k", None), (-2, "other", "x"), (-3, None, "x")], "row_id long, kind string, line string")
    got = {r.row_id: r.reason for r in rejects.classify_lines(df, "line", "kind", {"k": layout}).select("row_id", "reason").collect()}
    assert {k: got.pop(k) for k in (-1, -2, -3)} == {-1: None, -2: None, -3: None}
    assert got == {i: brute_reason(x, layout) for i, x in enumerate(lines)}


def test_good_lines_load(spark):
    line = '1,BP-1,2020-01-01,12.50,New,"two ""units"", shared",Issued,X,D,1,2,Single,44.1,-63.2'
    df = spark.createDataFrame([(1, "permits", line)], "row_id long, kind string, line string")
    df = df.withColumns({"reason": F.lit("x"), "corrupt": F.lit("y"), "read_permits": F.lit("z")})
    r = rejects.classify_lines(df, "line", "kind", {"permits": LAYOUTS["permits"]}).first()
    assert r.reason is None and r.read_permits.primary_work_scope == 'two "units", shared' and r.corrupt is None


def test_values(spark):
    bad = ["x", "1.5", "-1", "2147483648", "99999999999999999999", "１", "1e4", "+1", "0x1"]
    good = [None, "", " ", "0", " 7 ", "2147483647", "0002147483647"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(bad + good)], "row_id long, v string")
    assert {r.row_id for r in rejects.landed_faults(df, integers=("v",)).collect()} == set(range(len(bad)))


# Nearby ---------------------------------------------------------------------------
def distance(a, b):
    p, q, d, e = math.radians(a[1]), math.radians(b[1]), math.radians(b[1] - a[1]) / 2, math.radians(b[2] - a[2]) / 2
    return 2 * 6_371_000 * math.asin(math.sqrt(math.sin(d) ** 2 + math.cos(p) * math.cos(q) * math.sin(e) ** 2))


def points(spark, rows):
    return nearby.usable_points(spark.createDataFrame(rows, "k string, lat double, lon double"), F.col("k"), F.col("lat"), F.col("lon"))


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.operators.skew.hot_keys.__defaults__", (0.002, 5))
    rng = random.Random(2)
    a = [(f"a{i}", 47.99 + rng.random() * 0.01, -60 + rng.random() * 0.01) for i in range(150)] + [(None, 47.99, -60.0), ("nan", None, -60.0), ("far", 42.0, -60.0)]
    b = [(f"b{i % 200}", 47.99 + rng.random() * 0.01, -60 + rng.random() * 0.01) for i in range(300)] + [(f"h{i}", 47.995, -59.995) for i in range(100)]
    usable = lambda rows: [r for r in rows if r[0] and r[1] and 43 <= r[1] <= 48]
    for radius in (30, 100):
        want = {(x[0], y[0]) for x in usable(a) for y in usable(b) if distance(x, y) <= radius}
        assert {tuple(r) for r in nearby.pairs_within(points(spark, a), points(spark, b), radius).collect()} == want
    own = {(x[0], y[0]) for x in usable(b) for y in usable(b) if x[0] < y[0] and distance(x, y) <= 50}
    got = nearby.pairs_within(points(spark, b), None, 50).collect()
    assert {tuple(r) for r in got} == own and len(got) == len(own)
    assert nearby.pairs_within(points(spark, a).limit(0), points(spark, b), 50).count() == 0


def test_pairs_near_poles_and_the_180th_meridian(spark):
    rng = random.Random(3)
    for lat, lon in ((70.0, 20.0), (-89.9995, 0.0), (89.9999, 90.0), (10.0, 180.0), (0.0, -180.0), (-45.0, 179.9999)):
        wide = 0.001 if abs(lat) < 80 else 180
        wrap = lambda x: (x + 180) % 360 - 180
        a, b = ([(f"{s}{i}", max(-90.0, min(90.0, lat + rng.uniform(-0.001, 0.001))), wrap(lon + rng.uniform(-wide, wide))) for i in range(120)] for s in "ab")
        p, q = (spark.createDataFrame(x, "key string, lat double, lon double") for x in (a, b))
        want = {(x[0], y[0]) for x in a for y in b if distance(x, y) <= 60}
        assert want and {tuple(r) for r in nearby.pairs_within(p, q, 60).collect()} == want


def test_regions(spark, monkeypatch):
    square = [(-60.0, 45.0), (-59.9, 45.0), (-59.9, 45.1), (-60.0, 45.1), (-60.0, 45.0)]
    hollow = [(-60.2, 45.0), (-60.1, 45.0), (-60.1, 45.1), (-60.15, 45.02), (-60.2, 45.1), (-60.2, 45.0)]
    zones = spark.createDataFrame([(1, square), (2, hollow), (3, None), (4, square[:2])], "zone_id long, ring array<struct<lon double, lat double>>")
    p = points(spark, [("in", 45.05, -59.95), ("in", 45.06, -59.95), ("out", 45.2, -59.95), ("notch", 45.08, -60.15), ("leg", 45.03, -60.19)])
    assert {tuple(r) for r in nearby.points_in_regions(p, nearby.region_index(zones)).collect()} == {("1", "in"), ("2", "leg")}
    monkeypatch.setattr(nearby, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("sparkloom.operators.skew.hot_keys.__defaults__", (0.1, 1))
    many = points(spark, [("in", 45.05, -59.95), ("leg", 45.03, -60.19)] + [(f"hot{i}", 45.051 + i * 1e-5, -59.95) for i in range(50)])
    assert {r.right_key for r in nearby.points_in_regions(many, nearby.region_index(zones)).collect()} == {"in", "leg", *(f"hot{i}" for i in range(50))}


# Several values in one field ---------------------------------------------------------
def brute_split(text):
    out = []
    for m in re.finditer(r'"((?:[^"]|"")*)"|[^\W_]+(?:/[^\W\d_](?![^\W_]))*', text or ""):
        if m[1] is not None:
            out += [m[1].replace('""', '"')] if m[1] else []
        elif m[0].lower() not in ("and", "et"):
            out.append(m[0])
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='AB7é/"", ;\n|，and et', max_size=25)), max_size=6))
def test_split_like_brute_force(texts):
    assert split_packed(pa.array(texts, pa.string())).to_pylist() == [brute_split(t) for t in texts]


def test_explode_packed(spark):
    df = spark.createDataFrame([(1, '7A/B, 7/12 and "x ""y"" and", 7', "e"), (2, None, "f"), (3, "", None), (4, "9 " * 50_000, "g")], "row_id long, routes string, extra string")
    rows = explode_packed(df, "routes", "route").collect()
    assert [(r.row_id, r.pos, r.route) for r in rows if r.row_id == 1] == [(1, 1, "7A/B"), (1, 2, "7"), (1, 3, "12"), (1, 4, 'x "y" and'), (1, 5, "7")]
    assert sum(r.row_id == 4 for r in rows) == 50_000 and {r.row_id for r in rows} == {1, 4}
    assert explode_packed(df, "routes", "extra").columns == ["row_id", "pos", "extra"]
    assert explode_packed(df.limit(0), "routes").count() == 0
