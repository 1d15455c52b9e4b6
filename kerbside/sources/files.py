"""File readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside import schemas as S
from kerbside.functions import scalars
from kerbside.operators import zones as zone_ops


def read_trips_csv(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """Raw trip CSV with a header; ``typed=False`` reads every column as text.

    The quoted polyline is whole on its line, so files stay splittable.
    """
    schema = S.TRIP_RAW if typed else S.TRIP_RAW_TEXT
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_zone_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Zone map CSV; columns bind by position, whatever the header calls them."""
    return spark.read.schema(S.ZONE_MAP).option("header", True).option("enforceSchema", True).csv(path)


def default_zone_map(spark: SparkSession) -> DataFrame:
    """The standard map from its rule: 22 source zones, folded onto 16, kinds alternating."""
    i = F.col("id")
    box = S.SOURCE_GRID
    width = (box.lon_max - box.lon_min) / S.SOURCE_GRID_COLS
    height = (box.lat_max - box.lat_min) / S.SOURCE_GRID_ROWS
    col, row = (i - 1) % S.SOURCE_GRID_COLS, F.floor((i - 1) / S.SOURCE_GRID_COLS)
    return spark.range(1, S.SOURCE_ZONES + 1).select(
        i.cast("int").alias("source_zone_id"),
        ((i - 1) % (S.GRID_COLS * S.GRID_ROWS) + 1).cast("int").alias("arrondissement_id"),
        F.when(i % 2 == 1, "residential").otherwise("commercial").alias("zone_type"),
        F.round(box.lon_min + (col + 0.5) * width, 3).alias("lon"),
        F.round(box.lat_min + (row + 0.5) * height, 3).alias("lat"),
    )


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Directory, file or glob; a declared schema also reads files that lack a late column."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_serving_table(spark: SparkSession, path_or_table: str) -> DataFrame:
    """A serving table, by catalog name or by path."""
    if "/" in path_or_table:
        return spark.read.parquet(path_or_table)
    return spark.read.table(path_or_table)


def positions_in_zone(positions: DataFrame, zone_id: int, limit: int = 50,
                      city: str | None = None) -> DataFrame:
    """Newest positions of a zone; the key filter prunes partitions, the limit keeps a top-k."""
    rows = positions.where(F.col("zone_id") == zone_id)
    if city is not None:
        rows = rows.where(F.col("city") == city)
    return rows.orderBy(F.col("event_time").desc(), "taxi_id").limit(limit)


_PROPERTIES = T.StructType([
    T.StructField("Arrondissement", T.StringType()), T.StructField("Prefecture", T.StringType()),
    T.StructField("Population", T.LongType()),
])
# coordinates stay text: their depth depends on the geometry type
_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
_FEATURE = T.StructType([T.StructField("properties", _PROPERTIES), T.StructField("geometry", _GEOMETRY)])
_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])


def read_zones_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Zone polygons to the zones frame.

    One FeatureCollection per file, or with ``lines`` one feature per line, which splits over tasks
    but has no feature order; the zone id stands in for it.
    """
    if lines:
        feats = spark.read.schema(_FEATURE).json(path).withColumn("pos", F.lit(0))
    else:
        feats = spark.read.schema(_COLLECTION).option("multiLine", True).json(path).select(
            F.posexplode("features").alias("pos", "f")).select("f.*", "pos")
    coords = F.col("geometry.coordinates")
    polygon = F.array(F.from_json(coords, "array<array<array<double>>>"))
    multi = F.from_json(coords, "array<array<array<array<double>>>>")
    polygons = F.when(F.col("geometry.type") == "MultiPolygon", multi).otherwise(polygon)
    raw = feats.select(
        F.col("pos").alias("zone_order"), F.col("properties.Arrondissement").alias("raw_name"),
        F.col("properties.Prefecture").alias("prefecture"), F.col("properties.Population").alias("population"),
        polygons.cast(S.MULTI_POLYGON).alias("polygons"))
    zones = zone_ops.zones_from_features(raw)
    return zones.withColumn("zone_order", F.col("zone_id")) if lines else zones


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather document with parallel hourly arrays to one row per hour."""
    return weather_from_arrays(spark.read.schema(S.WEATHER_ARRAYS).option("multiLine", True).json(path))


def weather_from_arrays(df: DataFrame) -> DataFrame:
    """``hourly`` struct of arrays to rows (time_window, temperature_bucket, is_raining)."""
    h = F.explode(F.arrays_zip("hourly.time", "hourly.temperature_2m", "hourly.precipitation")).alias("h")
    return df.select(h).select(
        F.try_to_timestamp(F.col("h.time")).alias("time_window"),
        scalars.temperature_bucket(F.col("h.temperature_2m")).alias("temperature_bucket"),
        scalars.rain_flag(F.col("h.precipitation")).alias("is_raining"))
