"""Nearest-neighbour joins and as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.catalog.base import query
from kerbside.operators import proximity, tables, timeline
from kerbside.plans import bindings as B
from kerbside.streaming import matching as stream_matching

_LATEST = f"""latest AS (SELECT taxi_id, arg_max(zone_id, ts) AS zone_id, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon,
  arg_max(status, ts) AS status, max(ts) AS ts FROM (SELECT *, {B.sql_grid('lat', 'lon')} AS zone_id FROM pings) GROUP BY taxi_id)"""


def positions(spark, d, margin=0.0):
    return B.zoned(B.pings(spark, d, margin)).withColumnRenamed("ts", "event_time")


# more vehicles than the 40 taxis: one per (taxi, day), so that dense cells occur
def fleet(spark, d):
    p = B.pings(spark, d)
    unit = F.concat("taxi_id", F.lit("_"), F.dayofmonth("ts").cast("string"))
    return tables.latest_per_key(p.select(unit.alias("driver_id"), "ts", "lat", "lon"), ["driver_id"], ["ts", "lat", "lon"])


_FLEET = """fleet AS (SELECT concat(taxi_id, '_', cast(day(ts) AS varchar)) AS driver_id, arg_max(lat, ts) AS lat,
  arg_max(lon, ts) AS lon, max(ts) AS ts FROM pings GROUP BY 1)"""


@query("SELECT taxi_id, zone_id, lat, lon, status FROM latest", B.pings_sql(), _LATEST)
def latest_positions(spark, d):
    return stream_matching.fleet_snapshot(positions(spark, d)).select("taxi_id", "zone_id", "lat", "lon", "status")


_PLAT, _PLON = B.sql_center("origin_zone")
_PICK = f"""pick AS (SELECT *, CASE WHEN origin_lat IS NULL OR origin_lon IS NULL THEN {_PLAT} ELSE origin_lat END AS plat,
  CASE WHEN origin_lat IS NULL OR origin_lon IS NULL THEN {_PLON} ELSE origin_lon END AS plon FROM requests)"""


@query(f"""SELECT r.trip_id, m.taxi_id AS driver_id, r.rider_id, round(m.d, 1) AS distance_meters,
  CASE WHEN m.taxi_id IS NOT NULL THEN greatest(30, cast(floor(m.d/{30000 / 3600!r}e0) AS int)) END AS eta_seconds,
  r.origin_zone, r.destination_zone, m.zone_id AS matched_zone,
  CASE WHEN m.taxi_id IS NULL THEN 'NO_TAXI_AVAILABLE' ELSE 'MATCHED' END AS status
  FROM requests r LEFT JOIN (SELECT trip_id, taxi_id, zone_id, d FROM (
    SELECT p.trip_id, v.taxi_id, v.zone_id, {B.sql_haversine('plat', 'plon', 'v.lat', 'v.lon')} AS d FROM pick p JOIN latest v
    ON v.status='available' AND abs((p.origin_zone-1)%4 - (v.zone_id-1)%4) <= 1 AND abs((p.origin_zone-1)//4 - (v.zone_id-1)//4) <= 1)
    QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY d, taxi_id) = 1) m USING (trip_id)""",
       B.pings_sql(), B.REQUESTS, _LATEST, _PICK)
def match_nearest(spark, d):
    snapshot = stream_matching.fleet_snapshot(positions(spark, d))
    return proximity.match_nearest(B.requests(spark, d), snapshot)


@query(f"""SELECT search_id, driver_id, round(d, 2) AS distance_meters, lat, lon, cast(rank AS int) AS rank FROM (
  SELECT r.trip_id AS search_id, f.driver_id, f.lat, f.lon, {B.sql_haversine('origin_lat', 'origin_lon', 'f.lat', 'f.lon')} AS d,
    row_number() OVER (PARTITION BY r.trip_id ORDER BY {B.sql_haversine('origin_lat', 'origin_lon', 'f.lat', 'f.lon')}, f.driver_id) AS rank
  FROM requests r JOIN fleet f ON {B.sql_haversine('origin_lat', 'origin_lon', 'f.lat', 'f.lon')} <= 2000)
  WHERE rank <= 50""", B.pings_sql(), B.REQUESTS, _FLEET)
def nearby_drivers(spark, d):
    searches = B.requests(spark, d).select(
        F.col("trip_id").alias("search_id"), F.col("origin_lat").alias("lat"), F.col("origin_lon").alias("lon"))
    return proximity.nearby(searches, fleet(spark, d), 2000.0, 50)


_JLAT, _JLON = B.sql_center("coalesce(nullif(greatest(least(origin_zone-3,17),0),17),0)")
_J = f"""j AS (SELECT *, CASE WHEN origin_lat IS NOT NULL THEN origin_lat ELSE zlat END AS plat,
    CASE WHEN origin_lat IS NOT NULL THEN origin_lon ELSE zlon END AS plon
  FROM (SELECT *, {_PLAT.replace('origin_zone', 'z')} AS zlat, {_PLON.replace('origin_zone', 'z')} AS zlon
        FROM (SELECT *, CASE WHEN origin_zone-3 BETWEEN 1 AND 16 THEN origin_zone-3 ELSE 1 END AS z FROM requests)))"""


@query(f"""SELECT r.trip_id, m.driver_id, round(m.d, 2) AS distance_meters,
  CASE WHEN m.driver_id IS NOT NULL THEN greatest(30, cast(floor(round(m.d,2)/{30000 / 3600!r}e0) AS int)) END AS eta_seconds,
  r.origin_zone-3 AS origin_zone, r.destination_zone FROM requests r LEFT JOIN (
    SELECT j.trip_id, f.driver_id, {B.sql_haversine('plat', 'plon', 'f.lat', 'f.lon')} AS d FROM j JOIN fleet f
    ON {B.sql_haversine('plat', 'plon', 'f.lat', 'f.lon')} <= 700
    QUALIFY row_number() OVER (PARTITION BY j.trip_id ORDER BY d, f.driver_id) = 1) m USING (trip_id)""",
       B.pings_sql(), B.REQUESTS, _FLEET, _J)
def match_within_radius(spark, d):
    """Exact pickup, zone centre or centre of zone 1; a tight radius so that misses occur."""
    r = B.requests(spark, d).withColumn("origin_zone", F.col("origin_zone") - 3)
    return proximity.match_within_radius(r, fleet(spark, d), 700.0)


@query(f"""SELECT p.event_id AS point_id, arg_min(n.node_id, {B.sql_haversine('p.lat', 'p.lon', 'n.lat', 'n.lon')}) AS node_id,
  round(min({B.sql_haversine('p.lat', 'p.lon', 'n.lat', 'n.lon')}), 3) AS distance_m
  FROM pings p, (SELECT s_suppkey AS node_id, 33.5072e0 + cast((s_suppkey*104729)%9973 AS double)/9973e0*0.1455e0 AS lat,
    -7.6895e0 + cast((s_suppkey*7919)%9973 AS double)/9973e0*0.2887e0 AS lon FROM supplier) n GROUP BY p.event_id""", B.pings_sql())
def snap_to_node(spark, d):
    pts = B.pings(spark, d).select(F.col("event_id").alias("point_id"), "lat", "lon")
    found = proximity.snap_to_node(pts, road_nodes(spark, d))
    return found.withColumn("distance_m", F.round("distance_m", 3))


def road_nodes(spark, d):
    k = F.col("s_suppkey")
    return B.table(spark, d, "supplier").select(
        k.alias("node_id"), (F.lit(33.5072) + ((k * 104729) % 9973).cast("double") / 9973.0 * 0.1455).alias("lat"),
        (F.lit(-7.6895) + ((k * 7919) % 9973).cast("double") / 9973.0 * 0.2887).alias("lon"))


_NODES = """nodes AS (SELECT s_suppkey AS node_id, 33.5072e0 + cast((s_suppkey*104729)%9973 AS double)/9973e0*0.1455e0 AS lat,
    -7.6895e0 + cast((s_suppkey*7919)%9973 AS double)/9973e0*0.2887e0 AS lon FROM supplier)"""


@query(f"""SELECT o.trip_id, o.node_id AS origin_node, e.node_id AS dest_node FROM
  (SELECT trip_id, node_id FROM rides, nodes n QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY
     {B.sql_haversine('start_lat', 'start_lon', 'n.lat', 'n.lon')}, node_id) = 1) o JOIN
  (SELECT trip_id, node_id FROM rides, nodes n QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY
     {B.sql_haversine('end_lat', 'end_lon', 'n.lat', 'n.lon')}, node_id) = 1) e USING (trip_id) WHERE o.node_id <> e.node_id""",
       B.REQUESTS, _NODES, f"""rides AS (SELECT trip_id, origin_lat AS start_lat, origin_lon AS start_lon,
  origin_lat+0.01e0 AS end_lat, origin_lon+0.012e0 AS end_lon FROM requests WHERE origin_lat IS NOT NULL)""")
def snapped_trips(spark, d):
    """Both ends snapped; trips whose ends share a node are dropped."""
    r = B.requests(spark, d).where("origin_lat IS NOT NULL").select(
        "trip_id", F.col("origin_lat").alias("start_lat"), F.col("origin_lon").alias("start_lon"),
        (F.col("origin_lat") + 0.01).alias("end_lat"), (F.col("origin_lon") + 0.012).alias("end_lon"))
    return proximity.snap_trips(r, road_nodes(spark, d))


@query(f"""SELECT r.trip_id, r.origin_zone, p.taxi_id AS asof_taxi_id, p.status AS asof_status, p.lat AS asof_lat
  FROM requests r ASOF LEFT JOIN (SELECT *, {B.sql_grid('lat', 'lon')} AS zone_id FROM pings) p
  ON r.origin_zone = p.zone_id AND r.requested_at >= p.ts""", B.pings_sql(), B.REQUESTS)
def as_of_positions(spark, d):
    """The last ping known in the request's zone when the request came."""
    r = B.requests(spark, d).withColumn("zone_id", F.col("origin_zone"))
    p = positions(spark, d)
    out = timeline.as_of_join(r, p, ["zone_id"], "requested_at", "event_time", ["taxi_id", "status", "lat"],
                              right_order=["event_id"])
    return out.select("trip_id", "origin_zone", "asof_taxi_id", "asof_status", "asof_lat")


@query(f"""SELECT r.trip_id, CASE WHEN p.ts > r.requested_at - INTERVAL 3 HOUR THEN p.taxi_id END AS asof_taxi_id
  FROM requests r ASOF LEFT JOIN (SELECT *, {B.sql_grid('lat', 'lon')} AS zone_id FROM pings) p
  ON r.origin_zone = p.zone_id AND r.requested_at >= p.ts""", B.pings_sql(), B.REQUESTS)
def as_of_positions_alive(spark, d):
    """The same with a time to live on positions."""
    r = B.requests(spark, d).withColumn("zone_id", F.col("origin_zone"))
    return timeline.as_of_join(r, positions(spark, d), ["zone_id"], "requested_at", "event_time", ["taxi_id"],
                               right_order=["event_id"], bucket="6 hours", max_age="3 HOURS").select("trip_id", "asof_taxi_id")


@query("""SELECT driver_id, lat, lon FROM (SELECT user_id AS driver_id, arg_max(33.5072e0 + cast((event_id*104729)%10000 AS double)/1e4*0.1455e0, ts) AS lat,
    arg_max(-7.6895e0 + cast((event_id*7919)%10000 AS double)/1e4*0.2887e0, ts) AS lon, max(ts) AS ts
    FROM events WHERE event_type IN ('view','click','error') GROUP BY user_id) p
  LEFT JOIN (SELECT user_id AS driver_id, max(ts) AS gone FROM events WHERE event_type='signup' GROUP BY user_id) g USING (driver_id)
  WHERE gone IS NULL OR gone < ts""")
def driver_index(spark, d):
    """Latest point per driver, without the drivers that left since."""
    e = B.table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("driver_id"),
                                           F.col("ts").cast("timestamp").alias("ts"))
    p = B.pings(spark, d).select("event_id", "lat", "lon").join(e.drop("event_type"), "event_id")
    left = e.where("event_type = 'signup'").select("driver_id", F.col("ts").alias("departed_at"))
    return proximity.driver_index(p, left).select("driver_id", "lat", "lon")


@query("""SELECT driver_id, seq, lat, prev_lat, prev_lon FROM (
  SELECT *, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon FROM driver_events
  WHERE kind = 'ping' WINDOW w AS (PARTITION BY driver_id ORDER BY ts, seq))""", B.DRIVER_EVENTS)
def previous_positions(spark, d):
    p = B.driver_events(spark, d).where("kind = 'ping'")
    out = timeline.previous_row(p, ["driver_id"], ["ts", "seq"], ["lat", "lon"])
    return out.select("driver_id", "seq", "lat", "prev_lat", "prev_lon")
