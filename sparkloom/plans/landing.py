"""Queries p1, p2, p4, p5, p6: landing tables made usable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import plain_decimal, strip_ws
from sparkloom.operators.multivalue import explode_packed
from sparkloom.operators.nearby import pairs_within, points_in_regions, region_index, usable_points
from sparkloom.operators.orphans import orphan_references
from sparkloom.operators.rejects import Layout, classify_lines, landed_faults, loaded_records
from sparkloom.operators.timestamps import with_utc_micros, zone_table
from sparkloom.plans.registry import Registry
from sparkloom.session import written
from sparkloom.sources.tables import table

R = Registry()

#: The four fields of mixed date texts.
DATE_FIELDS = (("collisions_raw", "accident_datetime"), ("calls_raw", "call_date"), ("raw_counts", "count_date"), ("catalogue_raw", "last_data_updated_date"))

# The column orders of the three extracts.
LAYOUTS = {
    "traffic_counts": Layout(
        ("section_id", "highway", "section", "section_length", "section_description", "count_date", "description", "grp", "type", "county", "ptrucks", "adt", "aadt", "direction", "pct85", "priority_points"),
        integers=("aadt",),
        decimals=("section_length",),
    ),
    "calls": Layout(
        ("call_date", "military_hour", "call_interval", "offered", "handled", "abandoned", "processed_in_ivr", "total_talk_time", "average_talk_time", "objectid"),
        integers=("offered",),
    ),
    "permits": Layout(
        ("source_object_id", "permit_number", "date_of_permit_issuance", "estimated_project_value", "work_type", "primary_work_scope", "permit_status", "community", "district", "net_new_units", "number_of_storeys", "type_of_structure", "latitude", "longitude"),
        decimals=("estimated_project_value",),
    ),
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@R.add("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every landed date text that names a real moment, as microseconds in UTC."""
    parts = [table(spark, sf, t).select(F.lit(t).alias("table_name"), "row_id", F.col(c).alias("text")) for t, c in DATE_FIELDS]
    return with_utc_micros(_union(parts), "text").select("table_name", "row_id", "utc_us")


@R.add("p1_zone_transitions")
def p1_zone_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """The versioned transition table that p1_found converts through."""
    z = zone_table(spark)
    rows = [(z.zone, z.version, int(s), int(a), int(b)) for s, a, b in zip(z.switches, z.offsets[:-1], z.offsets[1:], strict=True)]
    return spark.createDataFrame(rows, "zone string, version string, wall_switch_s bigint, offset_before_s bigint, offset_after_s bigint")


_P2_SQL = r"""
WITH kids AS (
  SELECT row_id, loaded_at, k FROM (SELECT row_id, loaded_at, upper(regexp_replace(busstopid, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS k FROM shelters_raw)
  WHERE regexp_matches(k, '[0-9]')
), stops AS (
  SELECT upper(regexp_replace(busstopid, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS k, upper(trim(busstatus)) AS st, loaded_at, row_id FROM stops_raw WHERE busstopid IS NOT NULL
), latest AS (
  SELECT k, st AS last_status FROM (SELECT k, st, row_number() OVER (PARTITION BY k ORDER BY loaded_at DESC, row_id DESC) AS rn FROM stops) WHERE rn = 1
), firsts AS (SELECT k, min(loaded_at) AS first_at FROM stops GROUP BY k),
judged AS (
  SELECT kids.row_id, kids.loaded_at, CASE WHEN l.k IS NULL THEN 'missing' WHEN l.last_status = 'REM' THEN 'deleted' WHEN f.first_at > kids.loaded_at THEN 'late' END AS reason
  FROM kids LEFT JOIN latest l ON kids.k = l.k LEFT JOIN firsts f ON kids.k = f.k
)
"""


def _orphan_shelters(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(
        table(spark, sf, "shelters_raw", "row_id", "busstopid", "loaded_at"),
        table(spark, sf, "stops_raw", "row_id", "busstopid", "busstatus", "loaded_at"),
        child_key="busstopid",
        parent_key="busstopid",
        child_time="loaded_at",
        parent_time="loaded_at",
        parent_status="busstatus",
        parent_tie="row_id",
    )


@R.add("p2_found", _P2_SQL + "SELECT row_id, reason FROM judged WHERE reason IS NOT NULL")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Shelters that point at stops that are missing, deleted or late."""
    return _orphan_shelters(spark, sf).select("row_id", "reason")


@R.add(
    "p2_orphans_by_month",
    _P2_SQL + "SELECT 'shelters_raw' AS table_name, strftime(loaded_at, '%Y-%m') AS month, reason, count(*)::BIGINT AS orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
)
def p2_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, month of arrival and reason."""
    found = _orphan_shelters(spark, sf).select(F.lit("shelters_raw").alias("table_name"), F.date_format("loaded_at", "yyyy-MM").alias("month"), "reason")
    return found.groupBy("table_name", "month", "reason").agg(F.count(F.lit(1)).alias("orphans"))


_QF = r'"[^"]*(?:""[^"]*)*"'
_ONE = rf'(?:{_QF}|[^,"]*)'
_P4_INT = "coalesce(trim({0}) <> '' AND NOT (regexp_full_match(trim({0}), '[0-9]+') AND try_cast(trim({0}) AS HUGEINT) <= 2147483647 AND try_cast(trim({0}) AS HUGEINT) IS NOT NULL), false)"
_P4_DEC = "coalesce(trim({0}) <> '' AND NOT regexp_full_match(trim({0}), '[0-9]+([.][0-9]+)?'), false)"


def _p4_field(k: int) -> str:
    raw = rf"regexp_extract(line, '(?s)^(?:{_ONE},){{{k}}}({_ONE})(?:,|$)', 1)" if k else rf"regexp_extract(line, '(?s)^({_ONE})(?:,|$)', 1)"
    return rf"""replace(regexp_replace({raw}, '^"|"$', '', 'g'), '""', '"')"""


_P4_SQL = rf"""
WITH q AS (
  SELECT row_id, file_kind, line, regexp_full_match(line, '(?s){_ONE}(?:,{_ONE})*') AS quoted_well,
    len(regexp_extract_all(line || ',', '(?s)(?:{_QF}|[^,"]*),')) AS n
  FROM raw_lines WHERE line IS NOT NULL
), l AS (
  SELECT 'raw_lines' AS table_name, row_id, CASE
    WHEN file_kind NOT IN ('traffic_counts', 'calls', 'permits') OR file_kind IS NULL THEN NULL
    WHEN NOT quoted_well THEN 'quoting'
    WHEN n <> CASE file_kind WHEN 'traffic_counts' THEN 16 WHEN 'calls' THEN 10 ELSE 14 END THEN 'columns'
    WHEN file_kind = 'traffic_counts' AND ({_P4_INT.format(_p4_field(12))} OR {_P4_DEC.format(_p4_field(3))}) THEN 'value'
    WHEN file_kind = 'calls' AND {_P4_INT.format(_p4_field(3))} THEN 'value'
    WHEN file_kind = 'permits' AND {_P4_DEC.format(_p4_field(3))} THEN 'value' END AS reason
  FROM q
)
SELECT table_name, row_id, reason FROM l WHERE reason IS NOT NULL
UNION ALL SELECT 'raw_counts', row_id, 'value' FROM raw_counts WHERE {_P4_INT.format("aadt")} OR {_P4_DEC.format("section_length")}
UNION ALL SELECT 'calls_raw', row_id, 'value' FROM calls_raw WHERE {_P4_INT.format("offered")}
"""


@R.add("p4_found", _P4_SQL)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records and landed values that fail to parse, with the reason."""
    lines = classify_lines(table(spark, sf, "raw_lines", "row_id", "file_kind", "line"), "line", "file_kind", LAYOUTS).where(F.col("reason").isNotNull())
    counts = landed_faults(table(spark, sf, "raw_counts", "row_id", "aadt", "section_length"), integers=("aadt",), decimals=("section_length",))
    calls = landed_faults(table(spark, sf, "calls_raw", "row_id", "offered"), integers=("offered",))
    return _union([x.select(F.lit(t).alias("table_name"), "row_id", "reason") for t, x in (("raw_lines", lines), ("raw_counts", counts), ("calls_raw", calls))])


def _p4_loaded_sql(kind: str) -> str:
    layout = LAYOUTS[kind]
    types = dict.fromkeys(layout.integers, "INTEGER") | dict.fromkeys(layout.decimals, "DOUBLE")
    text = lambda k: f"nullif(trim({_p4_field(k)}), '')"
    columns = [f"try_cast({text(k)} AS {types[c]}) AS {c}" if c in types else f"{text(k)} AS {c}" for k, c in enumerate(layout.columns)]
    return f"SELECT row_id, {', '.join(columns)} FROM raw_lines WHERE file_kind = '{kind}' AND line IS NOT NULL AND row_id NOT IN (SELECT row_id FROM ({_P4_SQL}) WHERE table_name = 'raw_lines')"


def _loaded(kind: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return loaded_records(table(spark, sf, "raw_lines", "row_id", "file_kind", "line"), "line", "file_kind", kind, LAYOUTS[kind], ["row_id"])

    run.__doc__ = f"The records of the {kind} extract that load, every column, typed."
    return run


for _kind, _name in (("traffic_counts", "p4_loaded_counts"), ("calls", "p4_loaded_calls"), ("permits", "p4_loaded_permits")):
    R.add(_name, _p4_loaded_sql(_kind))(_loaded(_kind))


def _stop_points(spark: SparkSession, sf: str) -> DataFrame:
    return usable_points(table(spark, sf, "stops_raw", "busstopid", "lat", "lon"), F.upper(strip_ws(F.col("busstopid"))), F.col("lat"), F.col("lon"))


_P5_SQL = r"""
WITH s AS (
  SELECT DISTINCT upper(regexp_replace(busstopid, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS key, lat, lon FROM stops_raw WHERE lat BETWEEN 43 AND 48 AND lon BETWEEN -67 AND -59
), c AS (
  SELECT DISTINCT key, lat, lon FROM (
    SELECT collision_id AS key,
      CASE WHEN regexp_full_match(trim(lat), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN try_cast(trim(lat) AS DOUBLE) END AS lat,
      CASE WHEN regexp_full_match(trim(lon), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN try_cast(trim(lon) AS DOUBLE) END AS lon FROM collisions_raw)
  WHERE lat BETWEEN 43 AND 48 AND lon BETWEEN -67 AND -59 AND key IS NOT NULL AND key <> ''
), e AS (SELECT DISTINCT objectid::VARCHAR AS key, lat, lon FROM ev_raw WHERE lat BETWEEN 43 AND 48 AND lon BETWEEN -67 AND -59 AND objectid IS NOT NULL),
v AS (SELECT zone_id::VARCHAR AS zid, unnest(range(1, len(ring))) AS i, ring FROM zones),
g AS (SELECT zid, ring[i].lon AS ax, ring[i].lat AS ay, ring[i+1].lon AS bx, ring[i+1].lat AS by2 FROM v),
b AS (SELECT zid, min(least(ay, by2)) AS y0, max(greatest(ay, by2)) AS y1, min(least(ax, bx)) AS x0, max(greatest(ax, bx)) AS x1 FROM g GROUP BY zid),
p AS (SELECT 'zone_collision' AS kind, key, lat, lon FROM c UNION ALL SELECT 'zone_stop', key, lat, lon FROM s UNION ALL SELECT 'zone_ev', key, lat, lon FROM e),
boxed AS (SELECT p.*, b.zid FROM p JOIN b ON p.lat >= b.y0 AND p.lat <= b.y1 AND p.lon >= b.x0 AND p.lon <= b.x1),
pip AS (
  SELECT kind, zid, key, lat, lon FROM boxed JOIN g USING (zid)
  GROUP BY kind, zid, key, lat, lon
  HAVING sum(CASE WHEN (ay > lat) <> (by2 > lat) AND lon < (bx - ax) * (lat - ay) / (by2 - ay) + ax THEN 1 ELSE 0 END) % 2 = 1
), near AS (
  SELECT 'stop_collision' AS kind, a.key AS l, o.key AS r, 60 AS lim, a.lat AS y1, a.lon AS x1, o.lat AS y2, o.lon AS x2 FROM s a JOIN c o ON abs(a.lat - o.lat) < 0.001 AND abs(a.lon - o.lon) < 0.002
  UNION ALL SELECT 'stop_ev', a.key, o.key, 250, a.lat, a.lon, o.lat, o.lon FROM s a JOIN e o ON abs(a.lat - o.lat) < 0.003 AND abs(a.lon - o.lon) < 0.005
  UNION ALL SELECT 'stop_stop', a.key, o.key, 30, a.lat, a.lon, o.lat, o.lon FROM s a JOIN s o ON a.key < o.key AND abs(a.lat - o.lat) < 0.001 AND abs(a.lon - o.lon) < 0.001
)
SELECT DISTINCT kind, l AS left_key, r AS right_key FROM near
WHERE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))) <= lim
UNION ALL SELECT DISTINCT kind, zid, key FROM pip
"""


@R.add("p5_found", _P5_SQL)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Stops near collisions, chargers and other stops, and the zone each point lies in."""
    # Each point set is parsed and made distinct once, for all the pairs it takes part in.
    stops = written(_stop_points(spark, sf))
    collisions = written(usable_points(table(spark, sf, "collisions_raw", "collision_id", "lat", "lon"), F.col("collision_id"), plain_decimal(F.col("lat")), plain_decimal(F.col("lon"))))
    chargers = written(usable_points(table(spark, sf, "ev_raw", "objectid", "lat", "lon"), F.col("objectid"), F.col("lat"), F.col("lon")))
    zones = region_index(table(spark, sf, "zones", "zone_id", "ring"))
    pairs = {
        "stop_collision": pairs_within(stops, collisions, 60, once=False),
        "stop_ev": pairs_within(chargers, stops, 250, once=False).select(F.col("right_key").alias("left_key"), F.col("left_key").alias("right_key")),
        "stop_stop": pairs_within(stops, None, 30, once=False),
        "zone_collision": points_in_regions(collisions, zones, once=False),
        "zone_stop": points_in_regions(stops, zones, once=False),
        "zone_ev": points_in_regions(chargers, zones, once=False),
    }
    return _union([p.select(F.lit(k).alias("kind"), "left_key", "right_key") for k, p in pairs.items()]).distinct()


_P6_SQL = r"""
WITH l AS (SELECT row_id, regexp_extract_all(routes, '"(?:[^"]|"")*"|[\p{L}\p{N}]+(?:/\p{L}\b)*') AS l FROM parkride_raw WHERE routes IS NOT NULL),
v AS (SELECT row_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM l),
r AS (SELECT row_id, i, starts_with(v, '"') AS quoted, CASE WHEN starts_with(v, '"') THEN replace(v[2:-2], '""', '"') ELSE v END AS route FROM v)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) AS INTEGER) AS pos, route FROM r WHERE route <> '' AND (quoted OR lower(route) NOT IN ('and', 'et'))
"""


@R.add("p6_found", _P6_SQL)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every route of a park-and-ride lot, one per row with its place."""
    return explode_packed(table(spark, sf, "parkride_raw", "row_id", "routes"), "routes", "route")
