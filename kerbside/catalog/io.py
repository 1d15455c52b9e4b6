"""Readers and writers: every query writes data of the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside import sinks
from kerbside.catalog.base import query, rounded
from kerbside.catalog.matching import positions
from kerbside.functions import events, geo
from kerbside.operators import curate, demand, forecast, tables
from kerbside.plans import bindings as B
from kerbside.session import scratch_path
from kerbside.sources import files
from kerbside.streaming import gps


@query("SELECT cast(trip_id AS varchar) AS trip_id, call_type, cast(epoch(pickup_ts) AS bigint) AS ts, missing_data, cast(n_points AS int) AS n FROM trips_hist",
       B.TRIPS)
def trips_csv_round_trip(spark, d):
    """Raw trip CSV, declared types."""
    path = scratch_path(spark, "trips_csv")
    B.raw_trips(spark, d).write.option("header", True).option("escape", '"').csv(path)
    t = files.read_trips_csv(spark, path)
    return t.select(F.col("TRIP_ID").alias("trip_id"), F.col("CALL_TYPE").alias("call_type"), F.col("TIMESTAMP").alias("ts"),
                    F.col("MISSING_DATA").alias("missing_data"), F.size(F.from_json("POLYLINE", S.POLYLINE)).alias("n"))


@query("SELECT call_type, count(*) AS trips FROM trips_hist WHERE NOT missing_data GROUP BY 1", B.TRIPS)
def trips_csv_as_text(spark, d):
    """The same file with every column as text, as an untyped scan sees it."""
    path = scratch_path(spark, "trips_text")
    B.raw_trips(spark, d).write.option("header", True).option("escape", '"').csv(path)
    t = curate.without_missing(files.read_trips_csv(spark, path, typed=False))
    return t.groupBy(F.col("CALL_TYPE").alias("call_type")).agg(F.count(F.lit(1)).alias("trips"))


@query("SELECT cast(s_suppkey AS int) AS source_zone_id, cast(s_suppkey%16+1 AS int) AS arrondissement_id, s_name AS zone_type, "
       "s_acctbal AS lon, cast(s_nationkey AS double) AS lat FROM supplier")
def zone_mapping_csv(spark, d):
    """Columns bind by position, whatever the header says."""
    path = scratch_path(spark, "zone_map")
    B.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("a"), (F.col("s_suppkey") % 16 + 1).alias("other_name"), F.col("s_name").alias("c"),
        F.col("s_acctbal").alias("d"), F.col("s_nationkey").alias("e")).write.option("header", True).csv(path)
    return files.read_zone_mapping(spark, path)


@query("SELECT PULocationID, pickup_ts AS tpep_pickup_datetime, miles AS trip_distance FROM (SELECT zone_id AS PULocationID, pickup_ts, miles FROM yellow "
       "WHERE pickup_ts >= TIMESTAMP '1998-01-01')", B.TRIPS, B.YELLOW)
def yellow_scan(spark, d):
    """Declared Parquet scan with a pushed-down date floor."""
    path = scratch_path(spark, "yellow")
    B.yellow_raw(spark, d).write.parquet(path)
    return curate.since(files.read_parquet(spark, path, S.YELLOW_RAW), "tpep_pickup_datetime", "1998-01-01")


@query("SELECT cast(year(pickup_ts) AS int) AS year, count(*) AS trips FROM trips_hist WHERE year(pickup_ts) BETWEEN 1996 AND 1999 GROUP BY 1", B.TRIPS)
def glob_scan(spark, d):
    """Yearly folders picked by a glob."""
    path = scratch_path(spark, "by_year")
    t = B.trips_hist(spark, d).withColumn("year", F.year("pickup_ts"))
    t.write.partitionBy("year").parquet(path)
    return spark.read.option("basePath", path).parquet(f"{path}/year=199[6-9]").groupBy("year").agg(F.count(F.lit(1)).alias("trips"))


@query("SELECT concat(year(pickup_ts), '-', month(pickup_ts)) AS year_month, count(*) AS trips FROM (SELECT * FROM trips_hist WHERE NOT missing_data "
       "QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY pickup_ts, taxi_id) = 1) GROUP BY 1", B.TRIPS)
def curated_by_month(spark, d):
    """Curated table partitioned by month, files capped by rows."""
    path = scratch_path(spark, "curated")
    sinks.write_curated(curate.curate_trips(B.raw_trips(spark, d), files.default_zone_map(spark)), path)
    t = files.read_parquet(spark, path)
    return t.groupBy(F.col("year_month").cast("string").alias("year_month")).agg(F.count(F.lit(1)).alias("trips"))


@query("SELECT 'Yellow' AS city, zone_id, round(avg(miles*1.60934e0),4) AS avg_trip_length_km, count(*) AS trip_count "
       "FROM yellow WHERE zone_id IS NOT NULL AND miles>0 GROUP BY 2", B.TRIPS, B.YELLOW)
def kpi_by_city_table(spark, d):
    path = scratch_path(spark, "kpi")
    sinks.write_kpi(demand.average_trip_length(curate.typed_yellow(B.yellow_raw(spark, d)), "Yellow"), path)
    return rounded(files.read_parquet(spark, path), 4, "avg_trip_length_km")


@query("SELECT zone_id, cast(hour(pickup_ts) AS int) AS hour, count(*) AS demand_count FROM trips_hist GROUP BY 1, 2", B.TRIPS)
def plain_overwrite(spark, d):
    """Written twice: the second run replaces the first."""
    path = scratch_path(spark, "demand")
    for _ in range(2):
        sinks.write_table(demand.demand_by_zone_hour(B.trips_hist(spark, d)), path)
    return files.read_serving_table(spark, path)


@query(f"SELECT zone_id, taxi_id, max(event_id) AS event_id FROM (SELECT *, {B.sql_grid('lat', 'lon')} AS zone_id FROM pings "
       "WHERE event_id%3<>0 OR ts >= TIMESTAMP '2024-01-15') GROUP BY 1, 2", B.pings_sql())
def upsert_partitions(spark, d):
    """Newest ping per (zone, taxi) merged into a table by zone; run twice, same table."""
    path = scratch_path(spark, "positions")
    p = B.zoned(B.pings(spark, d)).select("zone_id", "taxi_id", "event_id", "ts")
    keys = ["zone_id", "taxi_id"]
    tables.latest_per_key(p.where("event_id % 3 <> 0"), keys, ["event_id"]).write.partitionBy("zone_id").parquet(path)
    new = p.where("ts >= '2024-01-15'")
    for _ in range(2):
        sinks.upsert_table(spark, path, tables.latest_per_key(new, keys, ["event_id"]), keys, ["event_id"], ["zone_id"])
    return spark.read.parquet(path).select("zone_id", "taxi_id", "event_id")


@query("SELECT taxi_id, max(event_id) AS event_id FROM pings GROUP BY 1", B.pings_sql())
def keyed_batches(spark, d):
    """Batches appended (one of them replayed), read as last write per key, folded into a new version."""
    path, folded = scratch_path(spark, "log"), scratch_path(spark, "folded")
    p = B.pings(spark, d).select("taxi_id", "event_id", "ts")
    for batch in (0, 1, 1, 2):
        sinks.append_batch(tables.latest_per_key(p.where(F.col("event_id") % 3 == batch), ["taxi_id"], ["event_id"]), path, batch)
    sinks.compact(spark, path, folded, ["taxi_id"], ["event_id"])
    return sinks.read_keyed(spark, folded, ["taxi_id"], ["event_id"]).select("taxi_id", "event_id")


@query("SELECT event_id, cast(event_id%3 AS int) AS batch_id FROM pings WHERE event_id%3=0 OR (event_id%3=1 AND event_id%2=0)", B.pings_sql())
def batch_replayed_smaller(spark, d):
    """Batches by sub-partition, tried again with fewer rows and sub-partitions, or none: only the last try counts."""
    path = scratch_path(spark, "replayed")
    p = B.pings(spark, d).select("event_id").withColumn("part", F.col("event_id") % 5)
    batch = lambda n: p.where(F.col("event_id") % 3 == n)
    sinks.append_batch(batch(0), path, 0, ["part"])
    sinks.append_batch(batch(1), path, 1, ["part"])
    sinks.append_batch(batch(1).where("event_id % 2 = 0"), path, 1, ["part"])
    sinks.append_batch(batch(2), path, 2, ["part"])
    sinks.append_batch(batch(2).where("false"), path, 2, ["part"])
    return spark.read.parquet(path).select("event_id", "batch_id")


@query(f"SELECT zone_id, taxi_id, max(event_id) AS event_id FROM (SELECT *, {B.sql_grid('lat', 'lon', 'reject')} AS zone_id FROM pings "
       "WHERE event_id%3<>0 OR ts >= TIMESTAMP '2024-01-15') GROUP BY 1, 2", B.pings_sql(0.0213))
def upsert_null_partitions(spark, d):
    """Newest ping per (zone, taxi) in a table whose null partition holds the pings outside the city."""
    path = scratch_path(spark, "with_outside")
    p = B.pings(spark, d, 0.0213)
    p = p.select(geo.grid_zone(F.col("lat"), F.col("lon"), "reject").alias("zone_id"), "taxi_id", "event_id", "ts")
    keys = ["zone_id", "taxi_id"]
    tables.latest_per_key(p.where("event_id % 3 <> 0"), keys, ["event_id"]).write.partitionBy("zone_id").parquet(path)
    new = p.where("ts >= '2024-01-15'")
    for _ in range(2):
        sinks.upsert_table(spark, path, tables.latest_per_key(new, keys, ["event_id"]), keys, ["event_id"], ["zone_id"])
    return spark.read.parquet(path).select("zone_id", "taxi_id", "event_id")


@query("SELECT taxi_id, max(event_id) AS event_id FROM pings GROUP BY 1", B.pings_sql())
def batches_folded_in_place(spark, d):
    """Old batches of a growing table folded twice and swept, later ones kept; last write per key."""
    path = scratch_path(spark, "grown")
    p = B.pings(spark, d).select("taxi_id", "event_id")
    for n in range(6):
        sinks.append_batch(p.where(F.col("event_id") % 6 == n), path, n)
        if n in (2, 4):
            sinks.fold_batches(spark, path, n - 1, ["taxi_id"], ["event_id"])
            sinks.sweep(spark, path)
    return sinks.read_keyed(spark, path, ["taxi_id"], ["event_id"]).select("taxi_id", "event_id")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM pings
  WHERE ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 7 DAY FROM pings)""", B.pings_sql())
def days_dropped(spark, d):
    """A table kept for seven days: whole day folders of batches and of a fold go, no row is rewritten."""
    path = scratch_path(spark, "kept")
    p = B.pings(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts")
    oldest = p.agg(F.date_sub(F.max("ts").cast("date"), 7).cast("string")).first()[0]
    for n in range(3):
        sinks.append_batch(p.where(F.col("event_id") % 3 == n).drop("ts"), path, n, ["day"])
    sinks.fold_batches(spark, path, 1, ["event_id", "day"], ["event_id"], ["day"])
    sinks.drop_before(spark, path, "day", oldest)
    return sinks.read_table(spark, path).select("event_id", F.col("day").cast("string").alias("day"))


@query("SELECT taxi_id, epoch_ms(ts) AS timestamp_ms, lat, lon FROM (SELECT taxi_id, make_timestamp(epoch_us(ts)//1000*1000) AS ts, lat, lon FROM pings)",
       B.pings_sql())
def json_events(spark, d):
    """Events written as JSON lines and parsed with the declared schema."""
    path = scratch_path(spark, "events")
    sinks.write_events(ping_events(spark, d), path)
    e = spark.read.schema("value string").text(path).select(events.parse_event(F.col("value"), S.PING_EVENT).alias("e"))
    return e.select("e.taxi_id", F.col("e.timestamp").alias("timestamp_ms"), "e.lat", "e.lon")


def ping_events(spark, d, margin=0.0):
    """Raw ping messages."""
    p = B.pings(spark, d, margin).withColumn("timestamp", F.unix_millis("ts"))
    return events.to_event(p, ["taxi_id", "timestamp", "lat", "lon", "speed", "status"])


@query(f"""SELECT taxi_id, zone_id, zone_name, event_time, lat, lon, speed, status, city FROM (
  SELECT taxi_id, {B.sql_grid('lat', 'lon', 'reject')} AS zone_id, concat('Zone-', cast({B.sql_grid('lat', 'lon', 'reject')} AS varchar)) AS zone_name,
    make_timestamp(epoch_us(ts)//1000*1000) AS event_time, lat, lon, speed, status, 'casablanca' AS city FROM pings) WHERE zone_id IS NOT NULL""",
       B.pings_sql(0.0213))
def normalised_pings(spark, d):
    """Parse, validate, zone by polygon, outside dropped."""
    raw = ping_events(spark, d, 0.0213).withColumn("record_time", F.lit(None).cast("timestamp"))
    return gps.normalise_gps(raw, B.grid_polygons(spark))[0]


def broken_pings(spark, d):
    """Pings of which one in four cannot be used: no JSON, text for a number, no taxi, no time."""
    p = B.pings(spark, d).withColumn("timestamp", F.unix_millis("ts"))
    good = F.to_json(F.struct("taxi_id", "timestamp", "lat", "lon", "speed", "status"))
    k = F.col("event_id") % 16
    value = (
        F.when(k == 0, F.lit("not json")).when(k == 1, F.to_json(F.struct("taxi_id", "timestamp", F.lit("north").alias("lat"), "lon")))
        .when(k == 2, F.to_json(F.struct("timestamp", "lat", "lon"))).when(k == 3, F.to_json(F.struct("taxi_id", "lat", "lon")))
        .otherwise(good))
    return p.select("event_id", value.alias("value"), F.lit(None).cast("timestamp").alias("record_time"), good.alias("original"))


@query("""SELECT event_id, CASE WHEN event_id%16<2 THEN 'unreadable record' WHEN event_id%16=2 THEN 'missing: taxi_id|driver_id'
  ELSE 'missing: timestamp' END AS error FROM pings WHERE event_id%16<4""", B.pings_sql())
def ping_quarantine(spark, d):
    return gps.split_pings(broken_pings(spark, d))[1].select("event_id", "error")


@query("SELECT count(*) AS messages, count(*) AS accounted_for, 0 AS still_bad FROM pings", B.pings_sql())
def quarantine_reprocessed(spark, d):
    """Good and bad rows add up; once repaired, the quarantine reads completely."""
    raw = broken_pings(spark, d)
    good, bad = gps.split_pings(raw)
    repaired = bad.withColumn("value", F.col("original"))
    fixed, still = gps.reprocess_quarantine(repaired)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).scalar()
    return raw.agg(F.count(F.lit(1)).alias("messages")).select(
        "messages", (n(good, "g") + n(fixed, "f")).alias("accounted_for"), n(still, "s").cast("int").alias("still_bad"))


@query(f"SELECT taxi_id, event_id, zone_id FROM (SELECT *, {B.sql_grid('lat', 'lon')} AS zone_id FROM pings) WHERE zone_id = 6 "
       "ORDER BY ts DESC, taxi_id LIMIT 50", B.pings_sql())
def positions_in_zone(spark, d):
    """Newest 50 positions of a zone from a table partitioned by zone."""
    path = scratch_path(spark, "by_zone")
    positions(spark, d).withColumn("city", F.lit(S.CITY_NAME)).write.partitionBy("city", "zone_id").parquet(path)
    t = files.read_serving_table(spark, path)
    return files.positions_in_zone(t, 6, 50, S.CITY_NAME).select("taxi_id", "event_id", "zone_id")


@query(f"""SELECT strftime(time_window, '%Y-%m-%dT%H:%M:%S') AS time_window, zone_id, demand, cast(hour(time_window) AS int) AS hour_of_day
  FROM (SELECT date_trunc('hour', ts) AS time_window, {B.sql_grid('lat', 'lon')} AS zone_id, count(*) AS demand FROM pings GROUP BY 1, 2)
  ORDER BY time_window, zone_id LIMIT 5""", B.pings_sql())
def feature_sample(spark, d):
    """Five rows as JSON, timestamps in ISO form."""
    path = scratch_path(spark, "sample")
    f = forecast.temporal_features(demand.demand_timeseries(B.zoned(B.pings(spark, d)), "ts"))
    sinks.export_sample(f, path, ["time_window", "zone_id"])
    return spark.read.schema("time_window string, zone_id int, demand long, hour_of_day int").json(path)


# Labels in the style of the polygon file.
_LABELS = ["Arrondissement de Sbata", "Arrondissement Hay Hassani", "Arrondissement d'Anfa", "District Neuf"]


@query("""SELECT CASE s_suppkey%4 WHEN 0 THEN 'Sbata' WHEN 1 THEN 'Hay Hassani' WHEN 2 THEN 'Anfa' ELSE 'District Neuf' END AS zone_name,
  cast(CASE s_suppkey%4 WHEN 0 THEN 8 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS int) AS zone_id, count(*) AS zones,
  cast(sum(s_nationkey) AS bigint) AS population, cast(count(*)*7 AS bigint) AS vertices FROM supplier GROUP BY s_suppkey%4""")
def zones_geojson(spark, d):
    """Polygons written as GeoJSON features, one per line, half of them as multipolygons."""
    path = scratch_path(spark, "geojson")
    k = F.col("zone_order")
    area = B.supplier_polygons(spark, d)
    label = F.element_at(F.array(*[F.lit(v) for v in _LABELS]), (k % 4 + 1).cast("int"))
    attrs = B.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("zone_order"), "s_nationkey")
    props = F.to_json(F.struct(label.alias("Arrondissement"), F.lit("P").alias("Prefecture"), F.col("s_nationkey").alias("Population")))
    multi = k % 2 == 0
    geometry = F.concat(F.lit('{"type":"'), F.when(multi, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'),
                        F.when(multi, F.to_json("polygons")).otherwise(F.to_json(F.col("polygons")[0])), F.lit("}"))
    line = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geometry, F.lit("}"))
    area.join(attrs, "zone_order").select(line.alias("value")).write.text(path)
    z = files.read_zones_geojson(spark, path, lines=True)
    return z.groupBy("zone_name", "zone_id").agg(
        F.count(F.lit(1)).alias("zones"), F.sum("population").alias("population"),
        F.sum(F.size(F.col("polygons")[0][0])).alias("vertices"))
