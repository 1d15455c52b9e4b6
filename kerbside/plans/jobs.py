"""The batch jobs end to end: read, operate, write."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside import sinks
from kerbside.operators import curate, demand, forecast
from kerbside.session import cut_lineage, prepare
from kerbside.sources import files


def curate_trips_job(spark: SparkSession, trips_csv: str, out: str, zone_map: str | None = None) -> None:
    """Raw trip CSV to the curated table by month."""
    prepare(spark)
    zmap = files.read_zone_mapping(spark, zone_map) if zone_map else files.default_zone_map(spark)
    sinks.write_curated(curate.curate_trips(files.read_trips_csv(spark, trips_csv), zmap), out)


def yellow_demand_job(spark: SparkSession, yellow: str, out: str) -> None:
    """Yellow-taxi trips to demand per zone and hour of day."""
    prepare(spark)
    rows = files.read_parquet(spark, yellow, S.YELLOW_RAW)
    sinks.write_table(demand.demand_by_zone_hour(rows, "tpep_pickup_datetime", "PULocationID"), out)


def yellow_hourly_job(spark: SparkSession, yellow: str, out: str, since: str = "2024-01-01") -> None:
    """Yellow-taxi trips since a day to demand per zone and hour; paths may be globs."""
    prepare(spark)
    rows = curate.since(files.read_parquet(spark, yellow, S.YELLOW_RAW), "tpep_pickup_datetime", since)
    sinks.write_table(demand.demand_timeseries(rows, "tpep_pickup_datetime", "PULocationID"), out)


def remap_job(spark: SparkSession, trips_csv: str, out: str) -> None:
    """Raw trips with their polylines carried to the target city."""
    prepare(spark)
    sinks.write_table(curate.remap_trips(files.read_trips_csv(spark, trips_csv)), out)


def zone_kpi_job(spark: SparkSession, curated: str, yellow: str, positions: str, out: str,
                 window_start: Column | None = None, city: str = S.CITY_NAME) -> None:
    """Zone KPIs. The trips are read once; peak hour and coverage gaps share one demand aggregate."""
    prepare(spark)
    zone_hour = cut_lineage(demand.demand_by_zone_hour(
        files.read_parquet(spark, yellow, S.YELLOW_RAW), "tpep_pickup_datetime", "PULocationID"))
    totals = zone_hour.groupBy("zone_id").agg(F.sum("demand_count").alias("demand_count"))
    vehicles = demand.vehicles_per_zone(files.read_serving_table(spark, positions))
    kpis = demand.zone_kpis(
        demand.trip_kpis(files.read_parquet(spark, curated)), demand.peak_hour(zone_hour),
        demand.coverage_gaps(totals, vehicles), city, F.current_timestamp() if window_start is None else window_start)
    sinks.write_kpi(kpis, out)


def city_kpi_job(spark: SparkSession, yellow: str, curated: str, out: str,
                 yellow_city: str = "NYC", source_city: str = "Porto") -> None:
    """Mean length, most requested zones and peak hour of both cities, three tables by city.

    Per city the trips are reduced once to (zone, hour): count and kilometres; all three KPIs follow
    from that small frame.
    """
    prepare(spark)
    parts = {
        yellow_city: curate.typed_yellow(files.read_parquet(spark, yellow, S.YELLOW_RAW)),
        source_city: curate.typed_trajectories(files.read_parquet(spark, curated)),
    }
    length, requested, peaks = [], [], []
    for city, trips in parts.items():
        base = cut_lineage(trips.groupBy("zone_id", "hour").agg(
            F.count(F.lit(1)).alias("demand_count"), F.sum("trip_length_km").alias("km")))
        zone = base.groupBy("zone_id").agg(
            F.sum("demand_count").alias("trip_count"), (F.sum("km") / F.sum("demand_count")).alias("avg_trip_length_km"))
        length.append(zone.select(F.lit(city).alias("city"), "zone_id", "avg_trip_length_km", "trip_count"))
        requested.append(demand.most_requested(zone.select("zone_id", F.col("trip_count").alias("request_count")), city))
        peaks.append(demand.peak_hour(base).select(F.lit(city).alias("city"), "zone_id", "peak_hour", "peak_demand_count"))
    for name, frames in (("avg_trip_length", length), ("most_requested", requested), ("peak_hours", peaks)):
        sinks.write_kpi(demand.all_cities(*frames), f"{out}/{name}")


def forecast_job(spark: SparkSession, curated: str, zones: DataFrame, weather: DataFrame | None,
                 model_path: str, ratio: float = 0.8) -> tuple[PipelineModel, DataFrame]:
    """Curated trips to a saved model; returns it with one row of errors next to the baseline."""
    prepare(spark)
    trips = files.read_parquet(spark, curated)
    zone = curate.pick_column(trips, "zone_id", "arrondissement_id").cast("string")
    hourly = demand.demand_timeseries(
        trips.select(zone.alias("zone_id"), F.timestamp_seconds(F.col("TIMESTAMP").cast("long")).alias("pickup_ts")),
        parent_res=7)
    features = cut_lineage(forecast.build_features(demand.densify(hourly), zones, weather))
    train, test = forecast.temporal_split(features, ratio)
    model = forecast.train(train)
    forecast.save_model(model, model_path)
    return model, forecast.compare_with_baseline(model.transform(test))
