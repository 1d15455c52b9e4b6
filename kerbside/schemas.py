"""Declared schemas and the fixed values that define results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Box(NamedTuple):
    """A longitude/latitude rectangle in degrees."""

    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float


# Bounds of the city and of the two source-city frames.
CITY = Box(-7.6895, -7.4008, 33.5072, 33.6527)
SOURCE_CITY = Box(-8.6922, -8.5594, 41.1396, 41.1848)
SOURCE_GRID = Box(-8.72, -8.55, 41.14, 41.21)
SOURCE_EXPLORE = Box(-8.69, -8.56, 41.14, 41.20)

# Zone grids.
GRID_COLS = 4
GRID_ROWS = 4
SOURCE_GRID_COLS = 6
SOURCE_GRID_ROWS = 4
SOURCE_ZONES = 22

# Units and rates.
EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_KM = 6371.0088
KM_PER_MILE = 1.60934
SECONDS_PER_POINT = 15
ETA_METRES_PER_SECOND = 30_000.0 / 3600
ETA_FLOOR_SECONDS = 30
BASE_FARE = "5.00"
FARE_PER_KM = "3.50"
FARE_PER_MINUTE = "0.50"
COMMISSION_RATE = "0.15"
MAX_CHARGE_ATTEMPTS = 5
CITY_NAME = "casablanca"
CITY_TIME_ZONE = "Africa/Casablanca"
CURRENCY = "MAD"

# Zone ids by name.
ZONE_IDS = {
    "Mechouar Casablanca": 1,
    "Anfa": 2,
    "Hay Hassani": 3,
    "Sidi Moumen": 4,
    "Moulay Rachid": 5,
    "Sidi Othmane": 6,
    "Ben M'Sick": 7,
    "Sbata": 8,
    "Aîn-Chock": 9,
    "Al Fida": 10,
    "Mers Sultan": 11,
    "Assoukhour Assawda": 12,
    "Hay Mohammadi": 13,
    "Aïn Sebaâ": 14,
    "Sidi Bernoussi": 15,
    "El Maarif": 16,
    "Sidi Belyout": 17,
}

# Coastline of the city, [lon, lat], north-east to south-west.
COASTLINE = [
    [-7.47, 33.70],
    [-7.52, 33.69],
    [-7.56, 33.67],
    [-7.60, 33.65],
    [-7.64, 33.62],
    [-7.68, 33.59],
    [-7.72, 33.57],
    [-7.76, 33.55],
    [-7.79, 33.53],
    [-7.74, 33.40],
]
COASTLINE_BAND = 0.001
INLAND_NUDGE = 2e-5
GEOMETRY_EPSILON = 1e-12

POLYLINE = T.ArrayType(T.ArrayType(T.DoubleType()))
MULTI_POLYGON = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))


TRIP_RAW_TEXT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "TRIP_ID", "CALL_TYPE", "ORIGIN_CALL", "ORIGIN_STAND", "TAXI_ID",
            "TIMESTAMP", "DAY_TYPE", "MISSING_DATA", "POLYLINE",
        )
    ]
)

TRIP_RAW = T.StructType(
    [
        T.StructField("TRIP_ID", T.StringType()),
        T.StructField("CALL_TYPE", T.StringType()),
        T.StructField("ORIGIN_CALL", T.StringType()),
        T.StructField("ORIGIN_STAND", T.StringType()),
        T.StructField("TAXI_ID", T.StringType()),
        T.StructField("TIMESTAMP", T.LongType()),
        T.StructField("DAY_TYPE", T.StringType()),
        T.StructField("MISSING_DATA", T.BooleanType()),
        T.StructField("POLYLINE", T.StringType()),
    ]
)

YELLOW_RAW = T.StructType(
    [
        T.StructField("PULocationID", T.IntegerType()),
        T.StructField("tpep_pickup_datetime", T.TimestampType()),
        T.StructField("trip_distance", T.DoubleType()),
    ]
)

ZONE_MAP = T.StructType(
    [
        T.StructField("source_zone_id", T.IntegerType()),
        T.StructField("arrondissement_id", T.IntegerType()),
        T.StructField("zone_type", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
    ]
)

PING_EVENT = T.StructType(
    [
        T.StructField("taxi_id", T.StringType()),
        T.StructField("driver_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

TRIP_REQUEST_EVENT = T.StructType(
    [
        T.StructField("trip_id", T.StringType()),
        T.StructField("rider_id", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("origin_zone", T.IntegerType()),
        T.StructField("destination_zone", T.IntegerType()),
        T.StructField("origin_lat", T.DoubleType()),
        T.StructField("origin_lon", T.DoubleType()),
        T.StructField("dest_lat", T.DoubleType()),
        T.StructField("dest_lon", T.DoubleType()),
        T.StructField("requested_at", T.LongType()),
        T.StructField("call_type", T.StringType()),
    ]
)

MATCH_EVENT = T.StructType(
    [
        T.StructField("trip_id", T.StringType()),
        T.StructField("driver_id", T.StringType()),
        T.StructField("rider_id", T.StringType()),
        T.StructField("distance_meters", T.DoubleType()),
        T.StructField("eta_seconds", T.IntegerType()),
        T.StructField("origin_zone", T.IntegerType()),
        T.StructField("destination_zone", T.IntegerType()),
        T.StructField("matched_zone", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("matched_at", T.LongType()),
    ]
)

# Both spellings of every field producers use; see functions.events.completion_fields.
COMPLETION_EVENT = T.StructType(
    [
        T.StructField("trip_id", T.StringType()),
        T.StructField("tripId", T.StringType()),
        T.StructField("driver_id", T.StringType()),
        T.StructField("driverId", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("rider_id", T.StringType()),
        T.StructField("distance_km", T.DoubleType()),
        T.StructField("distanceKm", T.DoubleType()),
        T.StructField("duration_min", T.DoubleType()),
        T.StructField("durationMin", T.DoubleType()),
        T.StructField("surge", T.DoubleType()),
        T.StructField("surge_multiplier", T.DoubleType()),
        T.StructField("completed_at", T.LongType()),
    ]
)

WEATHER_ARRAYS = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("temperature_2m", T.ArrayType(T.DoubleType())),
                    T.StructField("precipitation", T.ArrayType(T.DoubleType())),
                ]
            ),
        )
    ]
)
