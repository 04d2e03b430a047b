"""Points near other points, and points in regions.

Points are hashed to grid cells sized by the radius (and by the latitude, so the same holds from pole
to pole and across the 180th meridian), one side is laid out over the neighbouring cells, the sides
meet on the cell, and only then is the exact great-circle distance taken. Regions are cut by horizontal bands: each (region, cell) pair carries the edges that cross the cell's band,
so the point-in-polygon test looks at few edges. Cells that hold a large share of the rows are
salted; nothing is collected.

Defined results: rows with a null or unusable coordinate or key take no part; the same pair of keys
counts once, however many rows say so; a point on a region's edge belongs to at most one of two
regions that share that edge; empty tables give no pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.skew import BROADCAST_ROWS, hot_keys, salted_join

EARTH_M = 6_371_000.0
DEGREE_M = EARTH_M * math.pi / 180


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def usable_points(df: DataFrame, key: Column, lat: Column, lon: Column, lat_range: tuple[float, float] = (43, 48), lon_range: tuple[float, float] = (-67, -59)) -> DataFrame:
    """Distinct (key, lat, lon) of the rows that take part."""
    p = df.select(key.cast("string").alias("key"), lat.alias("lat"), lon.alias("lon"))
    return p.where(F.col("key").isNotNull() & (F.col("key") != "") & F.col("lat").between(*lat_range) & F.col("lon").between(*lon_range)).distinct()


def _band(lat: Column, dy: float) -> Column:
    """The band of latitude, counted from the south pole."""
    return F.floor((lat + 90) / dy)


def _cells_in(band: Column, dy: float, radius_m: float) -> Column:
    """Into how many cells a band is cut: each is at least as wide as the radius, for all points of the band and its two neighbours."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * dy - 90), F.abs((band + 2) * dy - 90)))
    reach = math.sin(radius_m / (2 * EARTH_M)) * 1.000001 / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), reach)))
    return F.greatest(F.lit(1), F.floor(360 / width)).cast("bigint")


def _cell_of(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * n), n)


def pairs_within(left: DataFrame, right: DataFrame | None, radius_m: float, once: bool = True) -> DataFrame:
    """Pairs (left_key, right_key) of (key, lat, lon) points at most radius_m apart, anywhere on the sphere.

    With right None the left points are paired with each other, two different keys, the smaller
    first. The right side should be the larger one: it stays in place, the left one is laid out
    over nine cells. Cells follow the latitude: bands a shade higher than the radius, each cut into
    equal cells around the globe, fewer towards the poles. With `once` False a pair may come out again for
    each place that its keys have, for callers that make several results distinct together.
    """
    dy = radius_m / DEGREE_M * 1.000001
    big = (left if right is None else right).withColumn("cy", _band(F.col("lat"), dy)).withColumn("cx", _cell_of(F.col("lon"), _cells_in(F.col("cy"), dy, radius_m)))
    bands = left.withColumn("cy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: _band(F.col("lat"), dy) + i))).withColumn("__sl_n", _cells_in(F.col("cy"), dy, radius_m))
    here = _cell_of(F.col("lon"), F.col("__sl_n"))
    near = F.array_distinct(F.array(*[F.pmod(here + i, F.col("__sl_n")) for i in (-1, 0, 1)]))
    small = bands.select(F.col("key").alias("left_key"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "cy", F.explode(near).alias("cx"))
    met = salted_join(big, small, ["cy", "cx"], ["key", "lat", "lon"], hot_keys(big, ["cy", "cx"]))
    if right is None:
        met = met.where(F.col("left_key") < F.col("key"))
    close = met.where(great_circle_m(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")) <= radius_m)
    pairs = close.select("left_key", F.col("key").alias("right_key"))
    return pairs.distinct() if once else pairs


def region_cells(regions: DataFrame, region_id: str, ring: str, step: float) -> DataFrame:
    """(rid, cy, cx, edges): for each cell that a region may touch the edges that cross the cell's band of latitude.

    Within a band a region lies between the ends of the edges that cross it; no cell beyond them is made.
    """
    edges = (
        regions.where(F.size(ring) >= 4)
        .select(F.col(region_id).cast("string").alias("rid"), F.explode(F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by")))).alias("p"))
        .where(F.col("p.ay").isNotNull() & F.col("p.by").isNotNull() & F.col("p.ax").isNotNull() & F.col("p.bx").isNotNull())
    )
    band = F.explode(F.sequence(F.floor(F.least("p.ay", "p.by") / step), F.floor(F.greatest("p.ay", "p.by") / step)))
    banded = edges.select("rid", "p", band.alias("cy")).groupBy("rid", "cy")
    cells = banded.agg(F.collect_list("p").alias("edges"), F.min(F.least("p.ax", "p.bx")).alias("x0"), F.max(F.greatest("p.ax", "p.bx")).alias("x1"))
    return cells.select("rid", "cy", F.explode(F.sequence(F.floor(F.col("x0") / step), F.floor(F.col("x1") / step))).alias("cx"), "edges")


def inside(edges: Column, lat: Column, lon: Column) -> Column:
    """Even-odd test against the edges of the point's band, straight edges in lon/lat, half-open in latitude."""
    crossed = F.aggregate(
        edges,
        F.lit(0),
        lambda n, e: n + F.when(((e["ay"] > lat) != (e["by"] > lat)) & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]), 1).otherwise(0),
    )
    return crossed % 2 == 1


def region_index(regions: DataFrame, region_id: str = "zone_id", ring: str = "ring", step: float = 0.05) -> tuple[DataFrame, bool]:
    """The cells of all regions, and whether cells and edges (32 bytes each) are few enough to broadcast."""
    cells = region_cells(regions, region_id, ring, step)
    size = cells.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("edges")).first()
    few = size["cells"] <= BROADCAST_ROWS // 4 and size["edges"] <= 500_000
    return (F.broadcast(cells) if few else cells), few


def points_in_regions(points: DataFrame, index: tuple[DataFrame, bool], step: float = 0.05, once: bool = True) -> DataFrame:
    """Pairs (left_key: region id, right_key: point key) of the points inside each region; the index comes from region_index with the same step."""
    cells, few = index
    placed = points.withColumn("cy", F.floor(F.col("lat") / step)).withColumn("cx", F.floor(F.col("lon") / step))
    hot = {} if few else hot_keys(placed, ["cy", "cx"])
    met = salted_join(placed, cells, ["cy", "cx"], ["key", "lat", "lon"], hot).where(inside(F.col("edges"), F.col("lat"), F.col("lon")))
    pairs = met.select(F.col("rid").alias("left_key"), F.col("key").alias("right_key"))
    return pairs.distinct() if once else pairs
