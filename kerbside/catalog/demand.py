"""Curation, demand, supply, KPIs and windowed demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.catalog.base import query, rounded
from kerbside.functions import events, geo, scalars
from kerbside.operators import curate, demand, tables
from kerbside.plans import bindings as B
from kerbside.sources import files

# --- filters and projections -------------------------------------------------------------------


@query("SELECT trip_id, taxi_id, call_type FROM trips_hist WHERE NOT missing_data", B.TRIPS)
def trips_without_missing(spark, d):
    """Flag as text, the way the raw file has it."""
    t = B.trips_hist(spark, d).withColumn("flag", F.initcap(F.col("missing_data").cast("string")))
    return curate.without_missing(t, "flag").select("trip_id", "taxi_id", "call_type")


@query("""SELECT zone_id, pickup_ts, miles AS trip_distance_miles, round(miles*1.60934e0, 6) AS trip_length_km,
  cast(hour(pickup_ts) AS int) AS hour FROM yellow WHERE zone_id IS NOT NULL AND pickup_ts IS NOT NULL AND miles > 0""",
       B.TRIPS, B.YELLOW)
def yellow_typed_rows(spark, d):
    """Not-null guards, positive distance, typed projection, miles to km."""
    return rounded(curate.typed_yellow(B.yellow_raw(spark, d)), 6, "trip_length_km")


@query("SELECT trip_id, zone_id, pickup_ts FROM trips_hist WHERE pickup_ts >= TIMESTAMP '1998-01-01'", B.TRIPS)
def date_floor(spark, d):
    return curate.since(B.trips_hist(spark, d), "pickup_ts", "1998-01-01").select("trip_id", "zone_id", "pickup_ts")


@query("SELECT trip_id, n_points*15/60 AS minutes FROM trips_hist WHERE n_points*15/60 > 0.75 AND n_points*15/60 < 2", B.TRIPS)
def duration_range(spark, d):
    t = B.trips_hist(spark, d).withColumn("minutes", F.col("n_points") * S.SECONDS_PER_POINT / 60)
    return curate.duration_between(t, "minutes", 0.75, 2).select("trip_id", "minutes")


@query("SELECT trip_id, status FROM trips WHERE status = 'MATCHED'", B.TRIPS_STATUS)
def status_filter(spark, d):
    return curate.with_status(B.trips_status(spark, d), " matched ").select("trip_id", "status")


@query("SELECT trip_id, coalesce(taxi_id,'') AS taxi_id, coalesce(eta_seconds,0) AS eta_seconds, "
       "coalesce(dest_zone,1) AS dest_zone FROM trips", B.TRIPS_STATUS)
def null_defaults(spark, d):
    t = B.trips_status(spark, d).select("trip_id", "taxi_id", "eta_seconds", "dest_zone")
    return tables.with_defaults(t, {"taxi_id": "", "eta_seconds": 0, "dest_zone": 1})


@query("SELECT taxi_id AS zone_id, count(*) AS trips FROM trips_hist GROUP BY 1", B.TRIPS)
def optional_zone_column(spark, d):
    """The zone column may be named zone_id or arrondissement_id."""
    t = B.trips_hist(spark, d).drop("zone_id").withColumnRenamed("taxi_id", "arrondissement_id")
    zone = curate.pick_column(t, "zone_id", "arrondissement_id")
    return t.groupBy(zone.alias("zone_id")).agg(F.count(F.lit(1)).alias("trips"))


@query("""SELECT trip_id, taxi_id, pickup_ts FROM trips_hist QUALIFY row_number() OVER
  (PARTITION BY trip_id ORDER BY pickup_ts, taxi_id) = 1""", B.TRIPS)
def trips_deduplicated(spark, d):
    t = B.trips_hist(spark, d).select("trip_id", "taxi_id", "pickup_ts")
    return tables.first_per_key(t, ["trip_id"], ["pickup_ts", "taxi_id"])


@query("SELECT DISTINCT zone_id, call_type FROM trips_hist", B.TRIPS)
def distinct_zones(spark, d):
    return B.trips_hist(spark, d).select("zone_id", "call_type").distinct()


@query("SELECT trip_id, taxi_id FROM trips_hist ORDER BY md5(cast(trip_id AS varchar)), trip_id, taxi_id LIMIT 100", B.TRIPS)
def sampled_trips(spark, d):
    t = B.trips_hist(spark, d).select("trip_id", "taxi_id")
    return t.orderBy(F.md5(F.col("trip_id").cast("string")), "trip_id", "taxi_id").limit(100)


@query(f"""SELECT trip_id, pickup_ts AS timestamp_ts, concat(year(pickup_ts), '-', month(pickup_ts)) AS year_month,
  cast(cast((least(22, greatest(0,least(3,floor((41.15e0-41.14e0)/{0.07 / 4!r}e0)))*6
    + greatest(0,least(5,floor((-8.68e0+8.72e0)/{0.17 / 6!r}e0)))+1)-1)%16+1 AS int) AS varchar) AS zone_id
  FROM polylines WHERE NOT missing_data QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY pickup_ts, taxi_id) = 1""",
       B.TRIPS, B.POLYLINES)
def curated_trips(spark, d):
    """Dedupe, filter, parse, zone by grid, map join, month label; all trips start at one corner."""
    t = curate.curate_trips(B.raw_trips(spark, d), files.default_zone_map(spark))
    return t.select(F.col("TRIP_ID").cast("long").alias("trip_id"), "timestamp_ts", "year_month", "zone_id")


@query("""SELECT trip_id, taxi_id, m.arr AS mapped_zone, m.kind AS zone_type FROM trips_hist t LEFT JOIN
  (SELECT z AS s, (z-1)%16+1 AS arr, CASE WHEN z%2=1 THEN 'residential' ELSE 'commercial' END AS kind
   FROM (SELECT unnest(range(1,23)) AS z)) m ON cast(t.taxi_id AS bigint) % 30 = m.s""", B.TRIPS)
def zone_map_join(spark, d):
    """Left join to the zone map; keys without entry stay null."""
    t = B.trips_hist(spark, d).withColumn("source_zone", (F.col("taxi_id").cast("long") % 30).cast("int"))
    zmap = files.default_zone_map(spark)
    kinds = zmap.select(F.col("source_zone_id").alias("source_zone"), "zone_type")
    return curate.map_zones(t, zmap, "source_zone").join(F.broadcast(kinds), "source_zone", "left").select(
        "trip_id", "taxi_id", "mapped_zone", "zone_type")


# --- profiling ---------------------------------------------------------------------------------


@query("SELECT call_type, count(*) AS count FROM trips_hist GROUP BY 1 ORDER BY 1", B.TRIPS)
def call_type_breakdown(spark, d):
    return curate.breakdown(B.trips_hist(spark, d), "call_type")


@query("""SELECT count(*) AS count, round(avg(m),6) AS mean, round(stddev_samp(m),6) AS stddev, min(m) AS min,
  quantile_cont(m,0.25) AS p25, quantile_cont(m,0.5) AS p50, quantile_cont(m,0.75) AS p75, max(m) AS max
  FROM (SELECT n_points*15/60 AS m FROM trips_hist)""", B.TRIPS)
def duration_profile(spark, d):
    t = B.points(B.trips_hist(spark, d)).select(
        (geo.point_count(F.col("points")) * S.SECONDS_PER_POINT / 60).alias("m"))
    return rounded(curate.profile(t, "m"), 6, "mean", "stddev")


@query("SELECT min(pickup_ts) AS min_ts, max(pickup_ts) AS max_ts FROM trips_hist", B.TRIPS)
def time_bounds(spark, d):
    return curate.time_bounds(B.trips_hist(spark, d), "pickup_ts")


@query("SELECT count(*) AS rows, count(DISTINCT zone_id) AS zones FROM trips_hist", B.TRIPS)
def row_and_zone_counts(spark, d):
    return B.trips_hist(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("zone_id").alias("zones"))


# --- demand ------------------------------------------------------------------------------------

_ZONED = f"zoned AS (SELECT *, {B.sql_grid('lat', 'lon')} AS zone_id FROM pings)"


@query("SELECT zone_id, cast(hour(pickup_ts) AS int) AS hour, count(*) AS demand_count FROM yellow "
       "WHERE zone_id IS NOT NULL GROUP BY 1, 2", B.TRIPS, B.YELLOW)
def demand_by_zone_hour(spark, d):
    y = B.yellow_raw(spark, d)
    return demand.demand_by_zone_hour(y, "tpep_pickup_datetime", "PULocationID")


@query("SELECT cast(hour(pickup_ts) AS int) AS hour, count(*) AS count FROM trips_hist GROUP BY 1 ORDER BY 1", B.TRIPS)
def demand_by_hour(spark, d):
    return demand.demand_by_hour(B.trips_hist(spark, d))


@query("SELECT date_trunc('hour', pickup_ts) AS time_window, cast(zone_id AS varchar) AS zone_id, count(*) AS demand "
       "FROM trips_hist GROUP BY 1, 2", B.TRIPS)
def demand_timeseries(spark, d):
    """Zone ids that are no cells pass through the coarsening unchanged."""
    return demand.demand_timeseries(B.trips_hist(spark, d), parent_res=7)


@query("SELECT zone_id, round(avg(miles*1.60934e0),4) AS avg_trip_length_km, count(*) AS trip_count, 'Yellow' AS city "
       "FROM yellow WHERE zone_id IS NOT NULL AND miles>0 GROUP BY 1", B.TRIPS, B.YELLOW)
def average_trip_length(spark, d):
    return rounded(demand.average_trip_length(curate.typed_yellow(B.yellow_raw(spark, d)), "Yellow"), 4, "avg_trip_length_km")


_LEG = B.sql_haversine("points[i][2]", "points[i][1]", "points[i+1][2]", "points[i+1][1]", S.EARTH_RADIUS_KM)


@query(f"""SELECT cast(zone_id AS varchar) AS zone_id, 'Source' AS city, count(*) AS trip_count, round(avg(km),4) AS avg_trip_length_km FROM (
  SELECT zone_id, list_sum(list_transform(range(1, n_points), lambda i: {_LEG})) AS km FROM polylines) GROUP BY zone_id""",
       B.TRIPS, B.POLYLINES)
def average_trajectory_length(spark, d):
    """Length measured on the polyline text."""
    t = B.points(B.trips_hist(spark, d)).select(
        "zone_id", F.unix_seconds("pickup_ts").alias("TIMESTAMP"), F.to_json("points").alias("POLYLINE"))
    return rounded(demand.average_trip_length(curate.typed_trajectories(t), "Source"), 4, "avg_trip_length_km")


@query("SELECT zone_id, count(*) AS request_count FROM trips_hist GROUP BY 1", B.TRIPS)
def requests_per_zone(spark, d):
    return demand.requests_per_zone(B.trips_hist(spark, d))


@query("SELECT zone_id, count(id) AS total_trips FROM (SELECT CASE WHEN trip_id%50<>0 THEN zone_id END AS zone_id, "
       "CASE WHEN trip_id%11<>0 THEN trip_id END AS id FROM trips_hist) WHERE zone_id IS NOT NULL GROUP BY 1", B.TRIPS)
def total_trips(spark, d):
    t = B.trips_hist(spark, d).select(
        F.when(F.col("trip_id") % 50 != 0, F.col("zone_id")).alias("zone_id"),
        F.when(F.col("trip_id") % 11 != 0, F.col("trip_id")).alias("TRIP_ID"))
    return demand.total_trips(t)


@query("SELECT zone_id, round(avg(CASE WHEN trip_id%17<>0 THEN n_points*15 END)/60, 6) AS avg_trip_duration_minutes "
       "FROM trips_hist GROUP BY 1", B.TRIPS)
def average_duration(spark, d):
    """Every 17th polyline is unreadable and has no duration."""
    t = B.points(B.trips_hist(spark, d)).select("zone_id", F.when(
        F.col("trip_id") % 17 != 0, F.to_json("points")).otherwise(F.lit("not json")).alias("POLYLINE"))
    return rounded(demand.average_duration(t), 6, "avg_trip_duration_minutes")


@query("SELECT zone_id, count(DISTINCT taxi_id) AS available_vehicles FROM zoned GROUP BY 1", B.pings_sql(), _ZONED)
def vehicles_per_zone(spark, d):
    return demand.vehicles_per_zone(B.zoned(B.pings(spark, d)))


@query("""SELECT zone_id, hour AS peak_hour, demand_count AS peak_demand_count FROM (
  SELECT zone_id, cast(hour(ts) AS int) AS hour, count(*) AS demand_count FROM zoned GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY demand_count DESC, hour) = 1""", B.pings_sql(), _ZONED)
def peak_hour_by_zone(spark, d):
    return demand.peak_hour(demand.demand_by_zone_hour(B.zoned(B.pings(spark, d)), "ts"))


@query("SELECT 'Yellow' AS city, zone_id, request_count, cast(dense_rank() OVER (ORDER BY request_count DESC) AS int) AS rank "
       "FROM (SELECT taxi_id AS zone_id, count(*) AS request_count FROM trips_hist GROUP BY 1)", B.TRIPS)
def most_requested(spark, d):
    return demand.most_requested(demand.requests_per_zone(B.trips_hist(spark, d), "taxi_id"), "Yellow")


_GAPS = """gaps AS (SELECT d.zone_id, d.n AS coverage_gap_demand FROM (SELECT zone_id, count(*) AS n FROM trips_hist GROUP BY 1) d
  LEFT JOIN (SELECT zone_id, count(*) AS v FROM (SELECT zone_id FROM zoned
    QUALIFY row_number() OVER (PARTITION BY taxi_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1) s USING (zone_id)
  WHERE coalesce(v, 0) < 3)"""


def _gaps(spark, d):
    last = tables.latest_per_key(B.zoned(B.pings(spark, d)).select("taxi_id", "zone_id", "ts", "event_id"),
                                 ["taxi_id"], ["ts", "event_id"])
    vehicles = demand.vehicles_per_zone(last)
    counts = demand.requests_per_zone(B.trips_hist(spark, d)).withColumnRenamed("request_count", "demand_count")
    return demand.coverage_gaps(counts, vehicles, 3)


@query("SELECT zone_id, coverage_gap_demand FROM gaps", B.TRIPS, B.pings_sql(), _ZONED, _GAPS)
def coverage_gaps(spark, d):
    """Demand zones where fewer than three vehicles were last seen."""
    return _gaps(spark, d)


@query("""SELECT 'casablanca' AS city, cast(zone_id AS varchar) AS zone_id, TIMESTAMP '2024-02-01' AS window_start,
  coalesce(t.n, 0) AS total_trips, round(coalesce(t.m, 0), 6) AS avg_trip_duration_minutes, coalesce(p.h, 0) AS peak_demand_hour,
  coalesce(g.coverage_gap_demand, 0) AS coverage_gap_demand
  FROM (SELECT cast(taxi_id AS int) AS zone_id, count(*) AS n, avg(n_points*15)/60 AS m FROM trips_hist GROUP BY 1) t
  FULL JOIN (SELECT zone_id, cast(hour(ts) AS int) AS h FROM zoned GROUP BY zone_id, hour(ts)
    QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY count(*) DESC, hour(ts)) = 1) p USING (zone_id)
  FULL JOIN gaps g USING (zone_id)""", B.TRIPS, B.pings_sql(), _ZONED, _GAPS)
def zone_kpis(spark, d):
    t = B.points(B.trips_hist(spark, d)).withColumn("zone_id", F.col("taxi_id").cast("int")).select(
        "zone_id", F.col("trip_id").alias("TRIP_ID"), F.to_json("points").alias("POLYLINE"))
    peak = demand.peak_hour(demand.demand_by_zone_hour(B.zoned(B.pings(spark, d)), "ts"))
    out = demand.zone_kpis(demand.trip_kpis(t), peak, _gaps(spark, d), S.CITY_NAME,
                           F.lit("2024-02-01").cast("timestamp"))
    return rounded(out, 6, "avg_trip_duration_minutes")


@query("SELECT 'A' AS city, cast(zone_id AS varchar) AS zone_id, count(*) AS request_count FROM trips_hist GROUP BY 2 "
       "UNION ALL SELECT 'B', cast(taxi_id AS varchar), count(*) FROM trips_hist GROUP BY 2", B.TRIPS)
def all_cities_union(spark, d):
    """Per-city frames with integer and text zone ids under one schema, columns in any order."""
    t = B.trips_hist(spark, d)
    a = demand.requests_per_zone(t).select(F.lit("A").alias("city"), "zone_id", "request_count")
    b = demand.requests_per_zone(t, "taxi_id").select("request_count", "zone_id", F.lit("B").alias("city"))
    return demand.all_cities(a, b)


_GRID = """grid AS (SELECT z.zone_id, s.tw AS time_window, coalesce(c.n, 0) AS demand FROM
  (SELECT DISTINCT zone_id FROM zoned) z CROSS JOIN (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM pings),
    (SELECT date_trunc('hour', max(ts)) FROM pings), INTERVAL 1 HOUR)) AS tw) s
  LEFT JOIN (SELECT zone_id, date_trunc('hour', ts) AS tw, count(*) AS n FROM zoned GROUP BY 1, 2) c
    ON c.zone_id = z.zone_id AND c.tw = s.tw)"""


@query("SELECT zone_id, time_window, demand FROM grid", B.pings_sql(), _ZONED, _GRID)
def dense_demand_grid(spark, d):
    return demand.densify(demand.demand_timeseries(B.zoned(B.pings(spark, d)), "ts"))


@query("SELECT event_id, generate_series AS t FROM (SELECT event_id, unnest(generate_series(date_trunc('hour', ts), ts, INTERVAL 10 MINUTE)) "
       "AS generate_series FROM pings)", B.pings_sql())
def exploded_time_steps(spark, d):
    steps = F.sequence(F.date_trunc("hour", "ts"), F.col("ts"), F.expr("INTERVAL 10 MINUTES"))
    return B.pings(spark, d).select("event_id", F.explode(steps).alias("t"))


# --- windows -----------------------------------------------------------------------------------

WINDOWS = f"""w AS (SELECT zone_id, ws, count(DISTINCT taxi_id) AS v, count(*) FILTER (taxi_id IS NULL) AS r FROM (
    SELECT {B.sql_grid('lat', 'lon')} AS zone_id, taxi_id, time_bucket(INTERVAL 30 SECOND, ts) AS ws FROM pings
    UNION ALL SELECT origin_zone, NULL, time_bucket(INTERVAL 30 SECOND, requested_at) FROM requests) GROUP BY zone_id, ws)"""
_WINDOW_COLUMNS = """'casablanca' AS city, zone_id, ws AS window_start, cast(v AS int) AS active_vehicles,
  cast(r AS int) AS pending_requests, round(cast(r AS double)/greatest(v,1), 6) AS ratio"""


@query(f"SELECT {_WINDOW_COLUMNS} FROM w", B.pings_sql(), B.REQUESTS, WINDOWS)
def demand_windows(spark, d):
    ev = demand.demand_events(B.zoned(B.pings(spark, d)), B.requests(spark, d))
    return rounded(demand.aggregate_demand(ev), 6, "ratio")


@query(f"""SELECT {_WINDOW_COLUMNS} FROM w WHERE ws + INTERVAL 30 SECOND <= (SELECT least((SELECT max(ts) FROM pings),
  (SELECT max(requested_at) FROM requests)) - INTERVAL 180 SECOND)""", B.pings_sql(), B.REQUESTS, WINDOWS)
def closed_demand_windows(spark, d):
    """Windows behind a watermark of 180 s on the slower input."""
    p, r = B.zoned(B.pings(spark, d)), B.requests(spark, d)
    mark = F.least(p.agg(F.max("ts")).scalar(), r.agg(F.max("requested_at")).scalar()) - F.expr("INTERVAL 180 SECONDS")
    out = demand.aggregate_demand(demand.demand_events(p, r))
    return rounded(demand.closed_windows(out, mark), 6, "ratio")


@query("""SELECT zone_id, ws AS window_start, ratio FROM (SELECT zone_id, ws, round(cast(r AS double)/greatest(v,1),6) AS ratio FROM w)
  QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY ws DESC) = 1""", B.pings_sql(), B.REQUESTS, WINDOWS)
def latest_demand_per_zone(spark, d):
    """Newest window of every zone, one row per key."""
    ev = demand.demand_events(B.zoned(B.pings(spark, d)), B.requests(spark, d))
    w = rounded(demand.aggregate_demand(ev), 6, "ratio").select("zone_id", "window_start", "ratio")
    return tables.latest_per_key(w, ["zone_id"], ["window_start"])


# --- scalar functions --------------------------------------------------------------------------


@query("""SELECT event_id, make_timestamp(epoch_us(ts)//1000*1000) AS from_millis,
  make_timestamp(cast(floor(epoch(ts)) AS bigint)*1000000) AS from_seconds, cast(hour(ts) AS int) AS hour,
  cast(dayofweek(ts)+1 AS int) AS dow, concat(year(ts), '-', month(ts)) AS year_month, strftime(ts, '%Y-%m-%d') AS bucket,
  date_trunc('hour', ts) AS truncated, CASE WHEN dayofweek(ts) IN (0,6) THEN 1 ELSE 0 END AS weekend,
  CASE WHEN dayofweek(ts)=5 THEN 1 ELSE 0 END AS friday FROM events""")
def calendar_functions(spark, d):
    ts = F.col("ts")
    e = B.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select(
        "event_id", scalars.from_epoch_millis(F.unix_millis(ts)).alias("from_millis"),
        scalars.from_epoch_seconds(F.unix_seconds(ts)).alias("from_seconds"), F.hour(ts).alias("hour"),
        F.dayofweek(ts).alias("dow"), scalars.year_month(ts).alias("year_month"), scalars.date_bucket(ts).alias("bucket"),
        F.date_trunc("hour", ts).alias("truncated"), scalars.is_weekend(ts).alias("weekend"),
        scalars.is_friday(ts).alias("friday"))


_LOCAL = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Africa/Casablanca')"


def _start(unit: str) -> str:
    return f"(date_trunc('{unit}', {_LOCAL}) AT TIME ZONE 'Africa/Casablanca' AT TIME ZONE 'UTC')"


@query(f"""SELECT event_id, {_start('day')} AS day_start, {_start('week')} AS week_start, {_start('month')} AS month_start,
  strftime({_LOCAL}, '%Y-%m-%d') AS local_bucket FROM events""")
def local_period_starts(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    at = lambda unit: scalars.local_period_start(F.col("ts"), S.CITY_TIME_ZONE, unit)
    return e.select("event_id", at("day").alias("day_start"), at("week").alias("week_start"),
                    at("month").alias("month_start"), scalars.date_bucket(F.col("ts"), S.CITY_TIME_ZONE).alias("local_bucket"))


_NAMES = list(S.ZONE_IDS)


@query("""SELECT event_id, CASE event_id%4 WHEN 0 THEN 'Anfa' WHEN 1 THEN 'El Maarif' WHEN 2 THEN 'Aîn-Chock'
    ELSE concat('District ', event_id%7) END AS name,
  CASE event_id%4 WHEN 0 THEN 2 WHEN 1 THEN 16 WHEN 2 THEN 9 ELSE 0 END AS zone_id FROM events""")
def zone_names_and_ids(spark, d):
    """Long labels to clean names and ids; unknown labels stay and get 0."""
    n = F.col("event_id")
    label = (
        F.when(n % 4 == 0, F.lit("arrondissement d'Anfa (x)")).when(n % 4 == 1, F.lit("Anfa, Maarif side"))
        .when(n % 4 == 2, F.lit("district of Ain Chok")).otherwise(F.concat(F.lit("District "), (n % 7).cast("string"))))
    name = scalars.clean_zone_name(label)
    return B.table(spark, d, "events").select("event_id", name.alias("name"), scalars.zone_id_of(name).alias("zone_id"))


@query("""SELECT event_id, CASE WHEN t IS NULL OR t < 10 THEN 'cold' WHEN t < 25 THEN 'mild' ELSE 'hot' END AS bucket,
  CASE WHEN hour(ts) < 8 THEN 'cold' WHEN hour(ts) < 18 THEN 'mild' ELSE 'hot' END AS hour_bucket,
  CASE WHEN value/100 > 0.1 THEN 1 ELSE 0 END AS rain,
  CASE WHEN value/25 < 0.8 THEN 'green' WHEN value/25 <= 1.2 THEN 'yellow' ELSE 'red' END AS color,
  round(cast(event_id%9 AS double)/greatest(user_id%4,1), 6) AS ratio, round(value*1.60934e0, 6) AS km,
  CASE WHEN hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 THEN 21 + user_id%3 WHEN hour(ts) <= 5 THEN 2 ELSE 9 END AS heuristic
  FROM (SELECT *, CASE WHEN event_id%10<>0 THEN value - 10 END AS t FROM events)""")
def weather_and_demand_functions(spark, d):
    e = B.table(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 10 != 0, F.col("value") - 10))
    hour = F.hour("ts")
    return e.select(
        "event_id", scalars.temperature_bucket(F.col("t")).alias("bucket"),
        scalars.hour_temperature_bucket(hour).alias("hour_bucket"), scalars.rain_flag(F.col("value") / 100).alias("rain"),
        scalars.ratio_color(F.col("value") / 25).alias("color"),
        F.round(scalars.demand_ratio(F.col("event_id") % 9, F.col("user_id") % 4), 6).alias("ratio"),
        F.round(scalars.miles_to_km(F.col("value")), 6).alias("km"),
        scalars.heuristic_demand(F.col("user_id"), hour).alias("heuristic"))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS int) AS k, CASE WHEN event_id%6=0 THEN NULL ELSE event_type END AS kind, "
       "CASE WHEN event_id%6=0 THEN 0 ELSE len(event_type) END AS kind_length FROM events")
def json_round_trip(spark, d):
    """Parse, build and parse again; malformed text gives null."""
    e = B.table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    built = events.to_event(e, ["event_id", "k", "event_type"])
    broken = F.when(F.get_json_object("value", "$.event_id").cast("long") % 6 == 0, F.lit("{oops")).otherwise(F.col("value"))
    back = built.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"),
                        F.get_json_object("value", "$.k").cast("int").alias("k"),
                        F.from_json(broken, "event_type string")["event_type"].alias("kind"))
    return back.withColumn("kind_length", F.coalesce(F.length("kind"), F.lit(0)))


@query("SELECT event_id, coalesce(CASE WHEN event_id%3=0 THEN value END, 0) AS filled, TRY_CAST(substr(event_type,1,1) AS int) AS bad_cast "
       "FROM events WHERE event_id%5 <> 0")
def null_handling(spark, d):
    e = B.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("filled"),
        F.when(F.col("event_id") % 5 != 0, F.lit(1)).alias("needed"),
        F.substring("event_type", 1, 1).try_cast("int").alias("bad_cast"))
    return e.na.fill(0, subset=["filled"]).na.drop(subset=["needed"]).drop("needed")
