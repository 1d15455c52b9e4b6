"""Trip curation: filters, typed projections, the two trip ETLs, profiling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import geo, scalars
from kerbside.operators.tables import first_per_key
from kerbside.session import broadcast_if_small, cut_lineage, once


# --- row filters -------------------------------------------------------------------------------


def without_missing(df: DataFrame, flag: str = "MISSING_DATA") -> DataFrame:
    """Drop trips flagged incomplete; the flag may be boolean or the text "True"/"False"."""
    kind = dict(df.dtypes)[flag]
    if kind == "boolean":
        return df.where(~F.col(flag))
    return df.where(F.lower(F.col(flag)) == "false")


def known(df: DataFrame, *columns: str) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def positive_distance(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0)


def valid_trajectory(df: DataFrame, points: str) -> DataFrame:
    return df.where(F.size(points) > 1)


def since(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Date floor: drops rows of broken clocks; a plain comparison, so Parquet filters see it."""
    return df.where(F.col(ts) >= F.lit(day).cast(dict(df.dtypes)[ts]))


def duration_between(df: DataFrame, minutes: str, low: float = 0, high: float = 60) -> DataFrame:
    """Exclusive on both ends."""
    return df.where((F.col(minutes) > low) & (F.col(minutes) < high))


def with_status(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """Case-insensitive status filter; no status given keeps every row."""
    if status is None or not status.strip():
        return df
    return df.where(F.upper(F.col(column)) == status.strip().upper())


def without_round_trips(df: DataFrame, points: str, tolerance: float = 0.001) -> DataFrame:
    return df.where(~geo.is_round_trip(F.col(points), tolerance))


def pick_column(df: DataFrame, *candidates: str) -> Column:
    """First of the candidate columns the frame has."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    raise ValueError(f"none of {candidates} in {df.columns}")


# --- trip ETLs ---------------------------------------------------------------------------------


def curate_trips(raw: DataFrame, zone_map: DataFrame) -> DataFrame:
    """Raw trips to the curated table.

    One row per trip id, complete trips with at least two points, start and end with cell ids, the
    grid zone mapped through ``zone_map`` (cell id where the map has no entry), month label.
    Among the complete copies of a trip the smallest (time, taxi, hash of the polyline) is kept, so
    reruns agree; the hash keeps the long text out of the comparison that is shuffled.
    """
    trips = first_per_key(without_missing(raw), ["TRIP_ID"], ["TIMESTAMP", "TAXI_ID", F.xxhash64("POLYLINE")])
    pts = F.col("_points")
    trips = valid_trajectory(once(trips, "_points", geo.parse_polyline(F.col("POLYLINE"))), "_points")
    first, last = F.get(pts, F.lit(0)), F.get(pts, F.size(pts) - 1)
    trips = trips.withColumns({
        "start_lon": F.get(first, F.lit(0)), "start_lat": F.get(first, F.lit(1)),
        "end_lon": F.get(last, F.lit(0)), "end_lat": F.get(last, F.lit(1)),
    })
    trips = trips.withColumns({
        "start_cell": geo.cell_id(F.col("start_lat"), F.col("start_lon")),
        "end_cell": geo.cell_id(F.col("end_lat"), F.col("end_lon")),
        "_source_zone": geo.source_grid_zone(F.col("start_lon"), F.col("start_lat")),
        "timestamp_ts": scalars.from_epoch_seconds(F.col("TIMESTAMP").cast("long")),
    })
    trips = map_zones(trips, zone_map, "_source_zone")
    zone = F.coalesce(F.col("mapped_zone").cast("string"), F.col("start_cell"))
    return trips.withColumns({
        "arrondissement_id": zone, "zone_id": zone,
        "year": F.year("timestamp_ts"), "month": F.month("timestamp_ts"),
        "year_month": scalars.year_month(F.col("timestamp_ts")),
    }).drop("_points", "_source_zone", "mapped_zone")


def map_zones(df: DataFrame, zone_map: DataFrame, source_zone: str) -> DataFrame:
    """Left join to the zone map on the source zone, broadcast once its size is checked."""
    m = zone_map.select(F.col("source_zone_id").cast("int").alias("_map_zone"),
                        F.col("arrondissement_id").cast("int").alias("mapped_zone"))
    return df.join(broadcast_if_small(m), F.col(source_zone) == F.col("_map_zone"), "left").drop("_map_zone")


def remap_trips(raw: DataFrame) -> DataFrame:
    """Complete trips with their polyline carried to the target city; unusable ones are dropped."""
    moved = geo.remap_polyline(F.col("POLYLINE"))
    return once(without_missing(raw), "CITY_POLYLINE", moved).where(F.col("CITY_POLYLINE") != "[]")


def typed_yellow(raw: DataFrame) -> DataFrame:
    """Yellow-taxi rows as (zone_id, pickup_ts, miles, km, hour); bad rows dropped."""
    return (
        raw.select(
            F.col("PULocationID").cast("int").alias("zone_id"),
            F.col("tpep_pickup_datetime").alias("pickup_ts"),
            F.col("trip_distance").cast("double").alias("trip_distance_miles"),
        )
        .transform(known, "zone_id", "pickup_ts")
        .transform(positive_distance, "trip_distance_miles")
        .withColumns({"trip_length_km": scalars.miles_to_km(F.col("trip_distance_miles")),
                      "hour": F.hour("pickup_ts")})
    )


def typed_trajectories(curated: DataFrame) -> DataFrame:
    """Curated trips as (zone_id, pickup_ts, km, hour) with the length measured on the polyline."""
    rows = curated.select(
        pick_column(curated, "zone_id", "arrondissement_id").cast("string").alias("zone_id"),
        scalars.from_epoch_seconds(F.col("TIMESTAMP").cast("long")).alias("pickup_ts"), "POLYLINE",
    ).transform(known, "zone_id", "pickup_ts")
    length = geo.polyline_length_km(geo.parse_polyline(F.col("POLYLINE")))
    return known(once(rows, "trip_length_km", length), "trip_length_km").drop("POLYLINE").withColumn(
        "hour", F.hour("pickup_ts"))


# --- profiling ---------------------------------------------------------------------------------


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(column)


def profile(df: DataFrame, column: str) -> DataFrame:
    """count, mean, stddev, min, quartiles, max; exact, quartiles interpolated between their neighbours.

    Moments are the built-in central ones, which keep their digits far from zero. Quartiles are found
    by rank: values and their frequencies are dealt to ranges, ranges are counted, and only the values
    at the wanted ranks meet. No task sees more than its range.
    """
    v = F.col(column).cast("double")
    whole = df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"),
                   F.min(v).alias("min"), F.max(v).alias("max"))
    freq = df.select(v.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    ranges = cut_lineage(freq.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy("_range").agg(F.sum("_n").alias("_sum"))  # one row per partition
    before = sums.withColumn("_before", F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum"))
    total = before.agg(F.sum("_sum")).first()[0] or 0
    wanted = {f"p{p}": (total - 1) * p / 100 for p in (25, 50, 75)}
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy("_range").orderBy("_v"))
    placed = ranges.join(F.broadcast(before), "_range").withColumn("_end", end)
    at = lambda rank: F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_v")))
    low = {name: at(F.lit(math.floor(max(r, 0)))) for name, r in wanted.items()}
    high = {name: at(F.lit(math.ceil(max(r, 0)))) for name, r in wanted.items()}
    quartiles = placed.agg(*[(low[n] + (high[n] - low[n]) * (r - math.floor(r))).alias(n) for n, r in wanted.items()])
    found = quartiles.select(F.struct(*wanted)).scalar()
    return whole.withColumns({n: found[n] for n in wanted}).select(
        "count", "mean", "stddev", "min", "p25", "p50", "p75", "max")


def time_bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
