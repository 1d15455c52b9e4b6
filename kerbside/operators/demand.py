"""Zone demand, supply, KPIs and windowed demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import geo, scalars
from kerbside.session import cut_lineage

# --- counts ------------------------------------------------------------------------------------


def demand_by_zone_hour(trips: DataFrame, ts: str = "pickup_ts", zone: str = "zone_id") -> DataFrame:
    """Trips per zone and hour of day."""
    return (
        trips.where(F.col(zone).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(zone).alias("zone_id"), F.hour(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias("demand_count"))
    )


def demand_by_hour(trips: DataFrame, ts: str = "pickup_ts") -> DataFrame:
    return trips.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("count")).orderBy("hour")


def demand_timeseries(trips: DataFrame, ts: str = "pickup_ts", zone: str = "zone_id",
                      step: str = "hour", parent_res: int | None = None) -> DataFrame:
    """Trips per zone and truncated time; ``parent_res`` coarsens zones that are cell ids."""
    zone_col = F.col(zone)
    if parent_res is not None:
        zone_col = geo.cell_parent(zone_col.cast("string"), parent_res)
    return (
        trips.where(F.col(zone).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.date_trunc(step, ts).alias("time_window"), zone_col.alias("zone_id"))
        .agg(F.count(F.lit(1)).alias("demand"))
    )


def requests_per_zone(trips: DataFrame, zone: str = "zone_id") -> DataFrame:
    return trips.groupBy(F.col(zone).alias("zone_id")).agg(F.count(F.lit(1)).alias("request_count"))


def total_trips(curated: DataFrame, trip: str = "TRIP_ID", zone: str = "zone_id") -> DataFrame:
    """Trips with an id per known zone."""
    return (
        curated.where(F.col(zone).isNotNull())
        .groupBy(F.col(zone).alias("zone_id")).agg(F.count(trip).alias("total_trips"))
    )


def average_trip_length(trips: DataFrame, city: str) -> DataFrame:
    """Mean km and number of trips per zone."""
    return trips.groupBy("zone_id").agg(
        F.avg("trip_length_km").alias("avg_trip_length_km"), F.count(F.lit(1)).alias("trip_count")
    ).select(F.lit(city).alias("city"), "zone_id", "avg_trip_length_km", "trip_count")


def average_duration(curated: DataFrame, polyline: str = "POLYLINE", zone: str = "zone_id") -> DataFrame:
    """Mean minutes per zone; an unreadable polyline has no duration and is left out."""
    seconds = geo.polyline_duration_s(geo.parse_polyline(F.col(polyline)))
    return curated.groupBy(F.col(zone).alias("zone_id")).agg(
        (F.avg(seconds) / 60).alias("avg_trip_duration_minutes"))


def vehicles_per_zone(positions: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct vehicles per zone. Exact counting shuffles on (zone, vehicle), so no zone is hot."""
    count = F.approx_count_distinct("taxi_id") if approximate else F.count_distinct("taxi_id")
    return positions.groupBy("zone_id").agg(count.alias("available_vehicles"))


# --- ranking -----------------------------------------------------------------------------------


def peak_hour(zone_hour: DataFrame) -> DataFrame:
    """Busiest hour per zone, the earlier hour on ties."""
    return zone_hour.groupBy("zone_id").agg(
        F.max_by(F.struct("hour", "demand_count"), F.struct(F.col("demand_count"), -F.col("hour"))).alias("p")
    ).select("zone_id", F.col("p.hour").alias("peak_hour"), F.col("p.demand_count").alias("peak_demand_count"))


def most_requested(counts: DataFrame, city: str) -> DataFrame:
    """Zones with their dense rank by request count.

    Only the distinct counts are ranked in one window: at most sqrt(2 x trips) of them exist, since
    n different counts add up to at least n(n+1)/2 trips. Zones get their rank by an equi join.
    """
    c = counts.withColumn("city", F.lit(city))
    levels = c.select("city", "request_count").distinct().withColumn(
        "rank", F.dense_rank().over(Window.partitionBy("city").orderBy(F.col("request_count").desc())))
    return c.join(levels, ["city", "request_count"]).select("city", "zone_id", "request_count", "rank")


# --- combination -------------------------------------------------------------------------------


def coverage_gaps(zone_demand: DataFrame, vehicles: DataFrame, min_vehicles: int = 2) -> DataFrame:
    """Zones with demand and fewer than ``min_vehicles`` vehicles; no vehicles at all counts."""
    return (
        zone_demand.join(vehicles, "zone_id", "left")
        .where("demand_count > 0").where(F.coalesce("available_vehicles", F.lit(0)) < min_vehicles)
        .select("zone_id", F.col("demand_count").alias("coverage_gap_demand"))
    )


def trip_kpis(curated: DataFrame, trip: str = "TRIP_ID", polyline: str = "POLYLINE",
              zone: str = "zone_id") -> DataFrame:
    """total_trips and avg_trip_duration_minutes per known zone in one pass over the trips."""
    seconds = geo.polyline_duration_s(geo.parse_polyline(F.col(polyline)))
    return curated.where(F.col(zone).isNotNull()).groupBy(F.col(zone).alias("zone_id")).agg(
        F.count(trip).alias("total_trips"), (F.avg(seconds) / 60).alias("avg_trip_duration_minutes"))


def zone_kpis(trips: DataFrame, peak: DataFrame, gaps: DataFrame, city: str, window_start: Column) -> DataFrame:
    """Every zone of any of the KPI frames, absent values 0. Zone ids are compared as text.

    The frames have one row per zone each, so stacking them and taking the only value per column
    is the chain of full outer joins in a single shuffle.
    """
    values = ["total_trips", "avg_trip_duration_minutes", "peak_demand_hour", "coverage_gap_demand"]
    stacked = None
    for f in (trips, peak.select("zone_id", F.col("peak_hour").alias("peak_demand_hour")), gaps):
        f = f.withColumn("zone_id", F.col("zone_id").cast("string"))
        stacked = f if stacked is None else stacked.unionByName(f, allowMissingColumns=True)
    return stacked.groupBy("zone_id").agg(*[F.max(v).alias(v) for v in values]).select(
        F.lit(city).alias("city"), "zone_id", window_start.alias("window_start"), *values).fillna(0, subset=values)


def all_cities(*frames: DataFrame) -> DataFrame:
    """Union by name of per-city KPI frames; zone ids become text so both kinds fit."""
    out = None
    for f in frames:
        f = f.withColumn("zone_id", F.col("zone_id").cast("string"))
        out = f if out is None else out.unionByName(f)
    return out


def densify(demand: DataFrame, step: str = "1 hour", value: str = "demand") -> DataFrame:
    """Every zone at every step between the first and the last time of the whole frame, gaps 0.

    Each zone expands the global range itself (bounds are a scalar subquery), then zeros and counts
    are summed. There is neither a cross join nor a driver round trip. The counts (zones x steps at
    most) are written once, so the trips behind them are read once.
    """
    demand = cut_lineage(demand)
    bounds = demand.agg(F.min("time_window").alias("lo"), F.max("time_window").alias("hi"))
    spine = demand.select("zone_id").distinct().select(
        "zone_id",
        F.explode(F.sequence(bounds.select("lo").scalar(), bounds.select("hi").scalar(),
                             F.expr(f"INTERVAL {step}"))).alias("time_window"),
        F.lit(0).cast("long").alias(value),
    )
    both = demand.select("zone_id", "time_window", F.col(value).cast("long").alias(value)).unionByName(spine)
    return both.groupBy("zone_id", "time_window").agg(F.sum(value).alias(value))


# --- event-time windows ------------------------------------------------------------------------


def demand_events(pings: DataFrame, requests: DataFrame) -> DataFrame:
    """One tagged stream of both kinds: ts, zone_id, taxi_id (null for requests). Batch or stream."""
    gps = pings.select(F.col("ts"), F.col("zone_id").cast("int").alias("zone_id"), "taxi_id",
                       F.lit("gps").alias("kind"))
    trips = requests.select(F.col("requested_at").alias("ts"), F.col("origin_zone").cast("int").alias("zone_id"),
                            F.lit(None).cast("string").alias("taxi_id"), F.lit("trip").alias("kind"))
    return gps.unionByName(trips)


def aggregate_demand(events: DataFrame, width: str = "30 seconds") -> DataFrame:
    """Distinct vehicles, pending requests and ratio per zone and tumbling window. Batch or stream.

    Two aggregations: first per (window, zone, vehicle), then per (window, zone). A busy zone is
    spread over its vehicles, and stream state holds a counter per vehicle instead of a set per zone.
    """
    per_vehicle = events.groupBy(F.window("ts", width).alias("w"), "zone_id", "taxi_id").agg(
        F.sum(F.when(F.col("kind") == "trip", 1).otherwise(0)).alias("requests"))
    per_zone = per_vehicle.groupBy(F.window(F.window_time("w"), width).alias("w"), "zone_id").agg(
        F.sum(F.when(F.col("taxi_id").isNotNull(), 1).otherwise(0)).cast("int").alias("active_vehicles"),
        F.sum("requests").cast("int").alias("pending_requests"),
    )
    return per_zone.select(
        F.lit(S.CITY_NAME).alias("city"), "zone_id", F.col("w.start").alias("window_start"),
        "active_vehicles", "pending_requests",
        scalars.demand_ratio(F.col("pending_requests"), F.col("active_vehicles")).alias("ratio"),
    )


def closed_windows(demand: DataFrame, watermark: Column, width: str = "30 seconds") -> DataFrame:
    """Windows that end at or before the watermark, i.e. what an append-mode stream has emitted."""
    return demand.where(F.col("window_start") + F.expr(f"INTERVAL {width}") <= watermark)
