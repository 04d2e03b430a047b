from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.operators import timestamps as T
from sparkloom.plans import landing

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
HALIFAX = ZoneInfo("America/Halifax")


def us(*utc) -> int:
    return (datetime(*utc, tzinfo=timezone.utc) - EPOCH) // timedelta(microseconds=1)


@pytest.fixture(scope="module")
def zone(spark):
    return T.zone_table(spark)


CASES = {
    "2020-07-01 12:00:00": us(2020, 7, 1, 15),
    "2020-01-01T12:00:00.352": us(2020, 1, 1, 16, 0, 0, 352000),
    "2020-01-01T12:00:00.123456Z": us(2020, 1, 1, 12, 0, 0, 123456),
    "2020-01-01T12:00+01:00": us(2020, 1, 1, 11),
    "2020-01-01 12:00:00.000-0330": us(2020, 1, 1, 15, 30),
    "7/4/2021 12:05:06 AM": us(2021, 7, 4, 3, 5, 6),
    "7/4/2021, 3:05 p.m.": us(2021, 7, 4, 18, 5),
    "07/04/21": us(2021, 7, 4, 3),
    "04.07.2021 09:22": us(2021, 7, 4, 12, 22),
    "20210704": us(2021, 7, 4, 3),
    "20210704T172814": us(2021, 7, 4, 20, 28, 14),
    "1262538776": 1262538776 * 10**6,
    "1262538776902": 1262538776902 * 1000,
    "01-Aug-12 11:41": us(2012, 8, 1, 14, 41),
    "Fri, 01 Jan 2010 23:23:30 GMT": us(2010, 1, 1, 23, 23, 30),
    "10 juin 2025 12 h 03": us(2025, 6, 10, 15, 3),
    "1er août 2017 1 h 05": us(2017, 8, 1, 4, 5),
    "December 10, 2011 5:49 PM": us(2011, 12, 10, 21, 49),
    "2015-07-24 00:30 NDT": us(2015, 7, 24, 3, 0),
    "1/1/2012 11:00:00 PM EST": us(2012, 1, 2, 4),
    "  2020-07-01  ": us(2020, 7, 1, 3),
    "2020-03-08 02:30:00": us(2020, 3, 8, 6, 30),  # skipped: forward an hour
    "2020-11-01 01:30:00": us(2020, 11, 1, 4, 30),  # twice: the first
    "Wednesday., September. 30th, 2020, 11:59:59.123456789 p.m. -03:00": us(2020, 10, 1, 2, 59, 59, 123456),
    "2020-01-01T12:00:00.12345678901234567890Z": us(2020, 1, 1, 12, 0, 0, 123456),
    "2020-01-01T12:00:00." + "9" * 100 + "Z": us(2020, 1, 1, 12, 0, 0, 999999),
    "2020-01-01 10:00 UT": us(2020, 1, 1, 10),
    "2020-01-01 10:00 UTC": us(2020, 1, 1, 10),
    "2100-07-01 12:00": us(2100, 7, 1, 15),
    "2150-07-01 12:00": us(2150, 7, 1, 15),
    "9999-01-01 12:00": us(9999, 1, 1, 16),
    "ven. 3 janvier 2020": us(2020, 1, 3, 4),
}
NONE = [None, "", "   ", "pending", "13/45/2020 9:00:00 AM", "2021-06-31T10:00:00", "2/29/2019", "00000000", "2020-01-01 25:61:00", "2020-01-01 13:00 PM", "2020-01-01 12:00 XYZ", "1" * 5000, "2020-01-01T12:00:60", "qq 3 Jan 2020", "2020-01-01 10:00 XX", "x" * 100_000]


def test_cases(zone):
    assert dict(zip(CASES, T.utc_micros(pa.array(list(CASES)), zone).to_pylist(), strict=True)) == CASES


def test_no_moment(zone):
    assert T.utc_micros(pa.array(NONE, pa.string()), zone).null_count == len(NONE)


def test_versions(spark, zone):
    assert zone.version and T.zone_table(spark, version=zone.version).switches.tolist() == zone.switches.tolist()
    with pytest.raises(ValueError):
        T.zone_table(spark, version="1800z")


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1975, 1, 1), datetime(9990, 1, 1)))
def test_wall_time_like_zoneinfo(zone, at):
    at = at.replace(microsecond=0)
    want = (at.replace(tzinfo=HALIFAX).astimezone(timezone.utc) - EPOCH) // timedelta(seconds=1)
    wall = np.array([(at - datetime(1970, 1, 1)) // timedelta(seconds=1)])
    assert zone.to_utc(wall)[0] == want
    there = datetime.fromtimestamp(want, HALIFAX).replace(tzinfo=None)
    assert zone.to_wall(np.array([want]))[0] == (there - datetime(1970, 1, 1)) // timedelta(seconds=1)


@pytest.mark.parametrize("session", ["UTC", "Asia/Tokyo"])
def test_wall_day(spark, session):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        df = spark.createDataFrame([(us(2020, 7, 1, 2, 59, 59),), (us(2020, 7, 1, 3),), (None,)], "at long")
        assert [str(r.d) for r in df.select(T.wall_day("at").alias("d")).collect()] == ["2020-06-30", "2020-07-01", "None"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_table_with_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "2020-01-01", None), (1, "2020-01-01", 2.0), (2, None, 1.0)], "row_id long, text string, other double")
    assert sorted(r.row_id for r in T.with_utc_micros(df, "text").collect()) == [1, 1]
    clash = T.with_utc_micros(df, "text", "other")
    assert clash.columns == ["row_id", "text", "other"] and {r.other for r in clash.collect()} == {us(2020, 1, 1, 4)}
    assert T.with_utc_micros(df.limit(0), "text").count() == 0


WORDS = {**{m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}, **{m: i for i, m in enumerate("janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(), 1)}}
ZONES = {"ADT": -3, "AST": -4, "EDT": -4, "EST": -5, "GMT": 0, "UTC": 0, "Z": 0, "NDT": -2.5, "NST": -3.5}
DAY = (
    r"(?P<Y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<D>\d{1,2})|(?P<m2>\d{1,2})/(?P<D2>\d{1,2})/(?P<Y2>\d{4}|\d\d)|(?P<D3>\d{1,2})\.(?P<m3>\d{1,2})\.(?P<Y3>\d{4}|\d\d)|(?P<Y4>\d{4})(?P<m4>\d\d)(?P<D4>\d\d)"
    r"|(?P<D5>\d{1,2})(?:er)?[ -](?P<B5>[^\W\d]+)[ -](?P<Y5>\d{4}|\d\d)|(?P<B6>[^\W\d]+) (?P<D6>\d{1,2}), (?P<Y6>\d{4})"
)
TIME = r"(?:[T ]|, )(?:(?P<H>\d{1,2})(?::| h )(?P<M>\d\d)(?::(?P<S>\d\d)(?:\.(?P<f>\d+))?)?|(?P<H2>\d\d)(?P<M2>\d\d)(?P<S2>\d\d))(?: ?(?P<p>[AaPp]\.?[Mm]\.?))?(?: ?(?P<z>[A-Z]+|[+-]\d\d:?\d\d))?"
WHOLE = re.compile(rf"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?(?:{DAY})(?:{TIME})?")


def one_by_one(text):
    """The moment of one text by datetime and zoneinfo; None if it isn't real."""
    text = (text or "").strip()
    if re.fullmatch(r"\d{10}|\d{13}", text):
        return int(text) * (10**6 if len(text) == 10 else 1000)
    m = WHOLE.fullmatch(text)
    if not m:
        return None
    g = {re.sub(r"\d$", "", k): v for k, v in m.groupdict().items() if v is not None}
    month = int(g["m"]) if "m" in g else next((i for w, i in WORDS.items() if g["B"].lower() == w or (len(w) == 3 and len(g["B"]) > 2 and date(2000, i, 1).strftime("%B").lower() == g["B"].lower())), 0)
    hour = int(g.get("H", 0))
    if "p" in g:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["p"][0] in "Pp")
    try:
        at = datetime(int(g["Y"]) + 2000 * (len(g["Y"]) == 2), month, int(g["D"]), hour, int(g.get("M", 0)), int(g.get("S", 0)), int((g.get("f", "0") + "000000")[:6]))
    except ValueError:
        return None
    z = g.get("z")
    if z is None:
        return (at.replace(tzinfo=HALIFAX).astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)
    if z[0] in "+-":
        shift = timedelta(hours=int(z[1:3]), minutes=int(z[-2:])) * (-1 if z[0] == "-" else 1)
    elif z in ZONES:
        shift = timedelta(hours=ZONES[z])
    else:
        return None
    return (at.replace(tzinfo=timezone.utc) - shift - EPOCH) // timedelta(microseconds=1)


def test_p1_like_one_by_one(spark, sf):
    want = {(t, r.row_id, us_) for t, c in landing.DATE_FIELDS for r in spark.read.parquet(f"{sf}/{t}.parquet").select("row_id", c).collect() if (us_ := one_by_one(r[c])) is not None}
    assert len(want) > 1000 and {tuple(r) for r in landing.p1_found(spark, sf).collect()} == want
