"""Text sources and sinks: CSV in its several readings, JSON and GeoJSON, one mart to two sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkloom.session import written


def read_csv_declared(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV under a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV (a path or a glob) with every column as text; empty fields stay empty texts where they were quoted."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types; reads the input twice, so prefer a declared schema."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def with_file_tag(df: DataFrame, tag: str, pattern: str = r"([^/]+?)(?:=[^/]*)?/[^/]*$") -> DataFrame:
    """df with a column taken from the path of the file a row came from."""
    return df.withColumn(tag, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def canonical_headers(df: DataFrame, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    """df under canonical column names: each is looked for under its synonyms, in any case and spacing; missing ones are null."""
    have = {"".join(c.lower().split("_")).replace(" ", ""): c for c in df.columns}
    pick = lambda names: next((have[k] for n in names if (k := n.lower().replace("_", "").replace(" ", "")) in have), None)
    return df.select(*[F.col(f"`{c}`").alias(name) if (c := pick((name, *other))) else F.lit(None).cast("string").alias(name) for name, other in synonyms.items()])


def write_csv(df: DataFrame, path: str, *order: Column, single: bool = False) -> None:
    """CSV with a header, ordered; `single` makes one file, for small reports only."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if single else out).write.option("header", True).option("escape", '"').csv(path)


def point_features(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature text per row; rows without a coordinate have a null geometry."""
    geometry = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Rows of a file of GeoJSON features, one a line: the properties, lon and lat."""
    schema = f"type STRING, properties STRUCT<{properties}>, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>"
    f = spark.read.schema(schema).json(path)
    return f.select("properties.*", F.element_at("geometry.coordinates", 1).alias("lon"), F.element_at("geometry.coordinates", 2).alias("lat"))


def read_feature_collection(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Rows of whole FeatureCollection documents: features unnested, the properties, lon and lat."""
    schema = f"features ARRAY<STRUCT<properties: STRUCT<{properties}>, geometry: STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.element_at("f.geometry.coordinates", 1).alias("lon"), F.element_at("f.geometry.coordinates", 2).alias("lat"))


def polygon_features(df: DataFrame, ring: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature text per row with a polygon of one ring; a null ring is a null geometry."""
    geometry = F.when(F.col(ring).isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def read_polygons(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Rows of a file of GeoJSON polygon features, one a line: the properties and the outer ring."""
    schema = f"type STRING, properties STRUCT<{properties}>, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    outer = F.transform(F.element_at("geometry.coordinates", 1), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return spark.read.schema(schema).json(path).select("properties.*", outer.alias("ring"))


def write_both(df: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> tuple[str, str]:
    """A mart to a CSV and a GeoJSON sink; it is made once, written, and both sinks are fed from that. The places of the two."""
    made = written(df)
    write_csv(made, f"{path}/csv")
    point_features(made, lon, lat, properties).write.text(f"{path}/geojson")
    return f"{path}/csv", f"{path}/geojson"


def bulk_load(texts: DataFrame, schema: str, path: str) -> DataFrame:
    """Rows of texts cast by a declared schema (in its order) into a parquet store, and the store; a text that doesn't cast is null."""
    spark = texts.sparkSession
    types = spark.createDataFrame([], schema).schema
    texts.select(*[F.col(c).try_cast(f.dataType).alias(f.name) for c, f in zip(texts.columns, types, strict=True)]).write.mode("append").parquet(path)
    return spark.read.schema(types).parquet(path)


def ring_centroid(ring: str) -> tuple[Column, Column]:
    """Longitude and latitude of a ring's centroid by the shoelace formula, relative to its first corner."""
    x0, y0 = F.col(ring)[0]["lon"], F.col(ring)[0]["lat"]
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct((a["lon"] - x0).alias("ax"), (a["lat"] - y0).alias("ay"), (b["lon"] - x0).alias("bx"), (b["lat"] - y0).alias("by")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, e: s + f(e))
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    area = total(cross)
    return x0 + total(lambda e: (e["ax"] + e["bx"]) * cross(e)) / (3 * area), y0 + total(lambda e: (e["ay"] + e["by"]) * cross(e)) / (3 * area)
