"""Trips and drivers: life cycle, odometer, lists, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.catalog.base import query
from kerbside.operators import demand, tables, trips
from kerbside.plans import bindings as B

# --- requests ----------------------------------------------------------------------------------


@query(f"""SELECT 'casablanca' AS city, strftime(requested_at, '%Y-%m-%d') AS date_bucket, requested_at AS created_at, trip_id,
  CASE WHEN cast(substr(trip_id,2) AS bigint)%5=0 THEN 'unknown' ELSE rider_id END AS rider_id,
  CASE WHEN origin_zone-2 BETWEEN 1 AND 16 THEN origin_zone-2 ELSE coalesce({B.sql_grid('origin_lat', 'origin_lon')},1) END AS origin_zone,
  CASE WHEN destination_zone+3 BETWEEN 1 AND 16 THEN destination_zone+3 ELSE 1 END AS dest_zone, 'REQUESTED' AS status FROM requests""",
       B.REQUESTS)
def requested_trips(spark, d):
    """Zones from the request, from coordinates or the default; blank riders are unknown."""
    r = B.requests(spark, d)
    key = F.expr("substring(trip_id, 2)").cast("long")
    r = r.withColumns({
        "rider_id": F.when(key % 5 == 0, F.lit(" ")).otherwise(F.col("rider_id")),
        "origin_zone": F.col("origin_zone") - 2, "destination_zone": F.col("destination_zone") + 3,
        "dest_lat": F.lit(None).cast("double"), "dest_lon": F.lit(None).cast("double")})
    return trips.request_trips(r, F.col("requested_at"))


# --- odometer and life cycle -------------------------------------------------------------------

_DELTA = B.sql_haversine("plat", "plon", "lat", "lon")


@query(f"""SELECT driver_id AS trip_id, round(CASE WHEN sum(dm) > 0 THEN sum(dm)/1000 ELSE 5.0 END, 3) AS distance_km,
  round((epoch_us(max(ts))//1000 - epoch_us(min(ts))//1000)/60000, 2) AS duration_min, count(*) AS pings FROM (
  SELECT driver_id, ts, coalesce({_DELTA}, 0) AS dm FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
    FROM driver_events WHERE kind='ping' WINDOW w AS (PARTITION BY driver_id ORDER BY ts, seq))) GROUP BY 1""", B.DRIVER_EVENTS)
def odometer(spark, d):
    """Kilometres and minutes per trip; the drivers stand in for trips."""
    p = B.driver_events(spark, d).where("kind = 'ping'").withColumn("trip_id", F.col("driver_id"))
    return trips.odometer(p)


LIFECYCLE = f"""slot AS (SELECT *, lag(kind) OVER w AS pk, lag(trip_id) OVER w AS pt, lag(client_id) OVER w AS pc FROM driver_events
    WHERE kind IN ('assign','accept','reject') WINDOW w AS (PARTITION BY driver_id ORDER BY ts, seq)),
  answered AS (SELECT driver_id, ts, seq, kind, pt AS trip_id, pc AS client_id FROM slot WHERE kind<>'assign' AND pk='assign'),
  rides AS (SELECT driver_id, ts, seq, kind, trip_id, client_id FROM answered WHERE kind='accept'
    UNION ALL SELECT driver_id, ts, seq, kind, NULL, NULL FROM driver_events WHERE kind IN ('start','complete')),
  active AS (SELECT driver_id, ts, seq, kind, t.kind AS last_kind, t.trip_id AS trip_id, t.client_id AS client_id FROM (
    SELECT driver_id, ts, seq, kind, last_value(CASE WHEN kind<>'start' THEN {{'kind': kind, 'trip_id': trip_id, 'client_id': client_id}} END
      IGNORE NULLS) OVER (PARTITION BY driver_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM rides)
    WHERE kind <> 'accept' AND t.kind='accept'),
  statuses AS (SELECT trip_id, driver_id, ts, seq, kind, client_id FROM answered UNION ALL SELECT trip_id, driver_id, ts, seq, kind, client_id FROM active),
  marks AS (SELECT * FROM statuses WHERE kind <> 'reject'),
  pings AS (SELECT driver_id, ts, seq, coalesce({_DELTA}, 0) AS dm FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
    FROM driver_events WHERE kind='ping' WINDOW w AS (PARTITION BY driver_id ORDER BY ts, seq))),
  ridden AS (SELECT driver_id, m.trip_id AS trip_id, m.seq AS start_seq, sum(dm) AS metres FROM (
    SELECT driver_id, dm, last_value(m IGNORE NULLS) OVER (PARTITION BY driver_id ORDER BY ts, seq) AS m, is_ping FROM (
      SELECT driver_id, ts, seq, dm, NULL AS m, true AS is_ping FROM pings
      UNION ALL SELECT driver_id, ts, seq, NULL, {{'kind': kind, 'trip_id': trip_id, 'seq': seq}}, false FROM marks))
    WHERE is_ping AND m.kind = 'start' GROUP BY 1, 2, 3),
  done AS (SELECT c.trip_id, c.driver_id, c.client_id, c.ts, s.ts AS start_ts, s.seq AS start_seq FROM
    (SELECT * FROM active WHERE kind='complete') c LEFT JOIN (SELECT * FROM active WHERE kind='start') s
    ON s.driver_id=c.driver_id AND s.trip_id=c.trip_id AND s.ts<=c.ts
    QUALIFY row_number() OVER (PARTITION BY c.driver_id, c.trip_id, c.seq ORDER BY s.ts DESC) = 1)"""


@query("""SELECT trip_id, driver_id, ts, seq, CASE kind WHEN 'accept' THEN 'ACCEPTED' WHEN 'reject' THEN 'REJECTED'
  WHEN 'start' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status FROM statuses""", B.DRIVER_EVENTS, LIFECYCLE)
def trip_lifecycle_statuses(spark, d):
    return trips.trip_lifecycle(B.driver_events(spark, d))[0]


COMPLETION_ROWS = """SELECT done.trip_id, done.driver_id, coalesce(client_id, 'unknown') AS client_id, done.ts AS completed_at,
  round(CASE WHEN metres > 0 THEN metres/1000 ELSE 5.0 END, 3) AS distance_km,
  round(coalesce((epoch_us(done.ts)//1000 - epoch_us(start_ts)//1000)/60000, 5.0), 2) AS duration_min, 1.0e0 AS surge
  FROM done LEFT JOIN ridden USING (driver_id, trip_id, start_seq)"""


@query(COMPLETION_ROWS, B.DRIVER_EVENTS, LIFECYCLE)
def trip_completions(spark, d):
    """Completed rides with distance since the start, minutes and the defaults."""
    return trips.trip_lifecycle(B.driver_events(spark, d))[1]


@query("""SELECT seq, driver_id, m.trip_id AS trip_id FROM (SELECT seq, driver_id, is_ping,
    last_value(m IGNORE NULLS) OVER (PARTITION BY driver_id ORDER BY ts, seq) AS m FROM (
      SELECT driver_id, ts, seq, NULL AS m, true AS is_ping FROM pings
      UNION ALL SELECT driver_id, ts, seq, {'kind': kind, 'trip_id': trip_id}, false FROM marks))
  WHERE is_ping AND m.kind IN ('accept','start')""", B.DRIVER_EVENTS, LIFECYCLE)
def trip_feed(spark, d):
    """Pings of drivers on a trip, with that trip."""
    e = B.driver_events(spark, d)
    statuses, _ = trips.trip_lifecycle(e)
    activity = statuses.where("status <> 'REJECTED'").select(
        "driver_id", F.col("ts").alias("changed_at"), "seq",
        F.when(F.col("status") != "COMPLETED", F.col("trip_id")).alias("active_trip"))
    return trips.trip_feed(e.where("kind = 'ping'").select("driver_id", "ts", "seq", "lat", "lon"), activity).select(
        "seq", "driver_id", "trip_id")


# --- status view, lists, statistics -------------------------------------------------------------


@query("""SELECT t.trip_id, coalesce(m.driver_id, t.taxi_id) AS taxi_id, coalesce(m.eta, t.eta_seconds) AS eta_seconds,
  CASE WHEN s.st IS NOT NULL THEN s.st WHEN m.driver_id IS NOT NULL THEN 'MATCHED' ELSE t.status END AS status FROM trips t
  LEFT JOIN (SELECT cast(l_orderkey AS varchar) AS trip_id, concat('d', arg_max(l_suppkey, (l_shipdate, l_suppkey, l_partkey, l_linenumber))) AS driver_id,
     cast(arg_max(l_partkey, (l_shipdate, l_suppkey, l_partkey, l_linenumber)) % 500 + 30 AS int) AS eta FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) m USING (trip_id)
  LEFT JOIN (SELECT cast(l_orderkey AS varchar) AS trip_id, arg_max(CASE WHEN l_linenumber%4=2 THEN 'ACCEPTED' ELSE 'IN_PROGRESS' END,
     (l_shipdate, l_linenumber)) AS st FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) s USING (trip_id)""", B.TRIPS_STATUS)
def trip_status_view(spark, d):
    """Trips with last match (odd lines) and last status (even lines), which comes a century after the matches."""
    item = B.table(spark, d, "lineitem")
    trip = F.col("l_orderkey").cast("string").alias("trip_id")
    m = item.where("l_linenumber % 2 = 1").select(
        trip, F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("driver_id"),
        (F.col("l_partkey") % 500 + 30).cast("int").alias("eta_seconds"),
        F.struct("l_shipdate", "l_suppkey", "l_partkey", "l_linenumber").alias("at"))
    m = tables.latest_per_key(m, ["trip_id"], ["at"]).withColumn("ts", F.col("at.l_shipdate").cast("timestamp"))
    s = item.where("l_linenumber % 2 = 0").select(
        trip, F.when(F.col("l_linenumber") % 4 == 2, "ACCEPTED").otherwise("IN_PROGRESS").alias("status"),
        (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 36525 DAYS")).alias("ts"), F.col("l_linenumber").alias("seq"))
    return trips.trip_status_view(B.trips_status(spark, d), m.drop("at"), s).select(
        "trip_id", "taxi_id", "eta_seconds", "status")


_LISTED = """trip_id, status, coalesce(taxi_id,'') AS taxi_id, rider_id, coalesce(eta_seconds,0) AS eta_seconds, origin_zone,
  coalesce(dest_zone,1) AS dest_zone, created_at"""
_LIST = ["trip_id", "status", "taxi_id", "rider_id", "eta_seconds", "origin_zone", "dest_zone", "created_at"]
_BUSY_DAY = "(SELECT date_bucket FROM trips GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def busy_day(t):
    """Day with the most trips, as text; one row."""
    top = t.groupBy("date_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "date_bucket")
    return top.first()["date_bucket"]


@query(f"SELECT {_LISTED} FROM trips WHERE date_bucket = {_BUSY_DAY} AND status = 'COMPLETED' ORDER BY created_at DESC, trip_id LIMIT 50",
       B.TRIPS_STATUS)
def admin_trips(spark, d):
    t = B.trips_status(spark, d)
    return trips.admin_trips(t, busy_day(t), "completed").select(*_LIST)


@query(f"SELECT {_LISTED} FROM trips WHERE date_bucket = {_BUSY_DAY} ORDER BY created_at DESC, trip_id LIMIT 20", B.TRIPS_STATUS)
def latest_trips_panel(spark, d):
    t = B.trips_status(spark, d)
    return trips.admin_trips(t, busy_day(t), limit=20).select(*_LIST)


@query("SELECT trip_id, status, origin_zone FROM trips WHERE rider_id = 'c17' AND date_bucket BETWEEN "
       "strftime((SELECT cast(max(date_bucket) AS date) FROM trips WHERE rider_id='c17') - 2, '%Y-%m-%d') AND "
       "(SELECT max(date_bucket) FROM trips WHERE rider_id='c17') ORDER BY created_at DESC LIMIT 50", B.TRIPS_STATUS)
def client_trips(spark, d):
    """The three days up to the client's last trip."""
    t = B.trips_status(spark, d)
    today = t.where("rider_id = 'c17'").agg(F.max("date_bucket").alias("m")).first()["m"] or "1970-01-01"
    return trips.client_trips(t, "c17", today).select("trip_id", "status", "origin_zone")


@query("SELECT trip_id, CASE WHEN cast(trip_id AS bigint)%3=0 THEN 'MATCHED' ELSE status END AS status, "
       "CASE WHEN cast(trip_id AS bigint)%3=0 THEN 1 ELSE 0 END AS _recent FROM trips", B.TRIPS_STATUS)
def trip_overlay(spark, d):
    """Cached rows first, then the stored rows not among them."""
    t = B.trips_status(spark, d).select("trip_id", "status")
    cached = t.where(F.col("trip_id").cast("long") % 3 == 0).withColumn("status", F.lit("MATCHED"))
    return tables.overlay(cached, t, "trip_id")


_CLASS = "CASE WHEN status IN ('MATCHED','ACCEPTED') THEN 'm' WHEN status='IN_PROGRESS' THEN 'i' WHEN status='COMPLETED' THEN 'c' " \
         "WHEN status IN ('CANCELLED','REJECTED') THEN 'x' ELSE 'r' END"


@query(f"""SELECT date_bucket AS date, count(*) AS total_trips, count(*) FILTER ({_CLASS}='r') AS requested,
  count(*) FILTER ({_CLASS}='m') AS matched, count(*) FILTER ({_CLASS}='i') AS in_progress, count(*) FILTER ({_CLASS}='c') AS completed,
  count(*) FILTER ({_CLASS}='x') AS cancelled, coalesce(cast(sum(eta_seconds) FILTER ({_CLASS} IN ('m','c') AND eta_seconds>0) AS bigint)
    // count(*) FILTER ({_CLASS} IN ('m','c') AND eta_seconds>0), 0) AS avg_wait_seconds FROM trips GROUP BY 1""", B.TRIPS_STATUS)
def trip_stats(spark, d):
    """All days; no cap on the trips of a day."""
    return trips.trip_stats(B.trips_status(spark, d))


@query(f"SELECT count(*) AS total_trips, round(avg(eta_seconds),6) AS avg_eta FROM trips WHERE date_bucket = {_BUSY_DAY}", B.TRIPS_STATUS)
def day_panel(spark, d):
    t = B.trips_status(spark, d)
    return trips.day_panel(t, busy_day(t)).withColumn("avg_eta", F.round("avg_eta", 6))


# --- drivers -----------------------------------------------------------------------------------

_STATES = f"""pos AS (SELECT driver_id, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon, max(ts) AS ts FROM driver_events WHERE kind='ping' GROUP BY 1),
  ended AS (SELECT driver_id, arg_max_null(CASE WHEN kind<>'complete' THEN trip_id END, ts) AS active_trip FROM marks GROUP BY 1),
  pend AS (SELECT driver_id, arg_max_null(CASE WHEN kind='assign' THEN trip_id END, ts) AS pending_trip FROM driver_events
    WHERE kind IN ('assign','accept','reject') GROUP BY 1)"""


def driver_sources(spark, d):
    """(status, positions, active, pending, index) of the drivers at the end of the events."""
    e = B.driver_events(spark, d)
    statuses, _ = trips.trip_lifecycle(e)
    turns = statuses.where("status <> 'REJECTED'").select("driver_id", "trip_id", "status", "ts", "seq")
    last = tables.latest_per_key(turns, ["driver_id"], ["ts", "seq"])
    slot = e.where(F.col("kind").isin("assign", "accept", "reject")).select("driver_id", "trip_id", "kind", "ts", "seq")
    pending = tables.latest_per_key(slot, ["driver_id"], ["ts", "seq"]).where("kind = 'assign'").select("driver_id", "trip_id")
    ping = e.where("kind = 'ping'").select("driver_id", "lat", "lon", "ts", "seq")
    latest = tables.latest_per_key(ping, ["driver_id"], ["ts", "seq"]).drop("seq")
    key = F.expr("substring(driver_id, 2)").cast("long")
    return (
        last.select("driver_id", F.when(F.col("status") == "COMPLETED", "AVAILABLE").otherwise("BUSY").alias("status")),
        latest.where(key % 3 != 0), last.where("status <> 'COMPLETED'").select("driver_id", "trip_id"), pending,
        latest.where(key % 2 == 0),
    )


_HAS_LOCAL = "cast(substr(driver_id,2) AS bigint)%3<>0"
_HAS_INDEX = "cast(substr(driver_id,2) AS bigint)%2=0"
_ALL_STATES = f"""states AS (SELECT driver_id, ended.driver_id IS NOT NULL AS turned, active_trip, pending_trip,
  CASE WHEN {_HAS_LOCAL} OR {_HAS_INDEX} THEN lat END AS lat, CASE WHEN {_HAS_LOCAL} OR {_HAS_INDEX} THEN lon END AS lon,
  CASE WHEN {_HAS_LOCAL} THEN pos.ts END AS last_seen, pos.ts IS NOT NULL AND {_HAS_LOCAL} AS local_pos,
  pos.ts IS NOT NULL AND {_HAS_INDEX} AS index_pos
  FROM (SELECT driver_id FROM ended UNION SELECT driver_id FROM pend WHERE pending_trip IS NOT NULL
        UNION SELECT driver_id FROM pos WHERE {_HAS_LOCAL} OR {_HAS_INDEX}) ids
  LEFT JOIN ended USING (driver_id) LEFT JOIN pend USING (driver_id) LEFT JOIN pos USING (driver_id))"""


@query("""SELECT driver_id, CASE WHEN active_trip IS NOT NULL THEN 'BUSY' ELSE 'AVAILABLE' END AS status, active_trip, pending_trip, lat, lon, last_seen
  FROM states WHERE active_trip IS NULL ORDER BY driver_id LIMIT 20 OFFSET 20""", B.DRIVER_EVENTS, LIFECYCLE, _STATES, _ALL_STATES)
def list_drivers(spark, d):
    """Second page of the available drivers."""
    return trips.list_drivers(trips.driver_states(*driver_sources(spark, d)), "available", 1, 20)


@query("""SELECT s.driver_id, CASE WHEN active_trip IS NOT NULL THEN 'BUSY' WHEN turned THEN 'AVAILABLE'
    WHEN index_pos AND NOT local_pos THEN 'AVAILABLE' ELSE 'OFFLINE' END AS status, active_trip, pending_trip, lat, lon,
  coalesce(t.recent, '') AS recent FROM states s LEFT JOIN (SELECT driver_id, string_agg(trip_id || ':' || kind, ',' ORDER BY ts DESC) AS recent
    FROM (SELECT * FROM statuses QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY ts DESC, trip_id) <= 10) GROUP BY 1) t USING (driver_id)""",
       B.DRIVER_EVENTS, LIFECYCLE, _STATES, _ALL_STATES)
def driver_details(spark, d):
    """Status, position and the ten newest trip events nested, here shown as text."""
    statuses, _ = trips.trip_lifecycle(B.driver_events(spark, d))
    kinds = F.create_map(*[F.lit(v) for v in ("ACCEPTED", "accept", "REJECTED", "reject", "IN_PROGRESS", "start", "COMPLETED", "complete")])
    history = statuses.select("driver_id", "trip_id", kinds[F.col("status")].alias("status"), F.col("ts").alias("created_at"))
    out = trips.driver_details(trips.driver_states(*driver_sources(spark, d)), history)
    text = F.array_join(F.transform("recent_trips", lambda t: F.concat_ws(":", t["trip_id"], t["status"])), ",")
    return out.withColumn("recent", text).drop("recent_trips")


@query("""SELECT driver_id, lat, lon, CASE WHEN active_trip IS NOT NULL THEN 'BUSY' ELSE 'AVAILABLE' END AS status FROM states
  WHERE local_pos OR index_pos""", B.DRIVER_EVENTS, LIFECYCLE, _STATES, _ALL_STATES)
def live_positions(spark, d):
    """Index rows, overridden by local rows of the same driver."""
    status, local, active, _, index = driver_sources(spark, d)
    stale = index.withColumns({"lat": F.col("lat") + F.when(F.expr("substring(driver_id, 2)").cast("long") % 3 != 0, 1.0).otherwise(0.0)})
    return trips.live_positions(stale, local, active, status)


# --- keyed tables ------------------------------------------------------------------------------


@query("""SELECT taxi_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM (SELECT * FROM pings WHERE event_id%4<>0
  UNION ALL SELECT * FROM pings WHERE event_id%4=0) GROUP BY 1""", B.pings_sql())
def upserted_positions(spark, d):
    """Older and newer rows in both halves: the last write wins, wherever it stands."""
    p = B.pings(spark, d).select("taxi_id", "event_id", "ts")
    return tables.upsert(p.where("event_id % 4 <> 0"), p.where("event_id % 4 = 0"), ["taxi_id"], ["ts"])


@query("SELECT event_id, taxi_id FROM pings WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00'",
       B.pings_sql())
def retention(spark, d):
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return tables.apply_retention(B.pings(spark, d).where(F.col("ts") <= as_of), "ts", "24 HOURS", as_of).select("event_id", "taxi_id")


@query("SELECT call_type, zone_id, n FROM (SELECT call_type, zone_id, count(*) AS n FROM trips_hist GROUP BY 1, 2) ORDER BY n DESC, zone_id, call_type LIMIT 7 OFFSET 7",
       B.TRIPS)
def second_page(spark, d):
    t = B.trips_hist(spark, d).groupBy("call_type", "zone_id").agg(F.count(F.lit(1)).alias("n"))
    return tables.page(t, [F.col("n").desc(), F.col("zone_id"), F.col("call_type")], 1, 7)[0]


@query("SELECT time_window, zone_id, demand FROM (SELECT date_trunc('day', pickup_ts) AS time_window, taxi_id AS zone_id, count(*) AS demand "
       "FROM trips_hist WHERE pickup_ts >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)", B.TRIPS)
def daily_demand_since(spark, d):
    """Date floor, then demand per day."""
    from kerbside.operators import curate
    t = curate.since(B.trips_hist(spark, d), "pickup_ts", "1998-01-01")
    return demand.demand_timeseries(t, zone="taxi_id", step="day")
