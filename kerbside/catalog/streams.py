"""Streaming jobs on a replay of the tables.

The replay is written in two halves along event time, and the job runs to the end of what is there
after each half, from the same checkpoint. So every query also covers a restart with kept state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside import schemas as S
from kerbside import sinks
from kerbside.catalog.base import query, rounded
from kerbside.catalog.billing import BILLED, COMPLETIONS, completion_events
from kerbside.catalog.demand import _WINDOW_COLUMNS, _ZONED, WINDOWS
from kerbside.catalog.matching import _LATEST, _PICK, positions
from kerbside.catalog.trips import COMPLETION_ROWS, LIFECYCLE
from kerbside.functions import events
from kerbside.plans import bindings as B
from kerbside.session import scratch_path
from kerbside.streaming import archive, billing, common, demand, gps, lifecycle, matching


def replay(inputs: list[tuple[DataFrame, str, str]], fmt: str, start: Callable[[], StreamingQuery]) -> None:
    """inputs: (frame, event-time column, folder). Write and process the earlier, then the later half."""
    cuts = []
    for df, ts, _ in inputs:
        b = df.agg(F.unix_micros(F.min(ts)).alias("lo"), F.unix_micros(F.max(ts)).alias("hi"))
        cuts.append(b.select(F.timestamp_micros(((F.col("lo") + F.col("hi")) / 2).cast("long"))).scalar())
    cut = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    for early in (True, False):
        for df, ts, path in inputs:
            half = df.where(F.col(ts) <= cut) if early else df.where(F.col(ts) > cut)
            out = half.select("value") if fmt == "text" else half
            out.write.mode("append").format(fmt).save(path)
        start().awaitTermination()


def ping_messages(spark: SparkSession, d: str, margin: float = 0.0) -> DataFrame:
    p = B.pings(spark, d, margin).withColumn("timestamp", F.unix_millis("ts"))
    fields = F.struct("taxi_id", "timestamp", "lat", "lon", "speed", "status")
    return p.select("ts", F.to_json(fields).alias("value"))


def request_messages(spark: SparkSession, d: str) -> DataFrame:
    r = B.requests(spark, d)
    fields = F.struct("trip_id", "rider_id", "origin_zone", "destination_zone", "origin_lat", "origin_lon",
                      F.unix_millis("requested_at").alias("requested_at"))
    return r.select(F.col("requested_at").alias("ts"), F.to_json(fields).alias("value"))


_MILLIS = "make_timestamp(epoch_us(ts)//1000*1000)"


@query(f"""SELECT taxi_id, zone_id, concat('Zone-', cast(zone_id AS varchar)) AS zone_name, {_MILLIS} AS event_time, status FROM (
  SELECT *, {B.sql_grid('lat', 'lon', 'reject')} AS zone_id FROM pings) WHERE zone_id IS NOT NULL""", B.pings_sql(0.0213))
def stream_positions(spark, d):
    """GPS job: parse, polygon zones, outside dropped, positions table."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"gps_{n}") for n in ("in", "out", "ck"))
    zones = B.grid_polygons(spark)
    replay([(ping_messages(spark, d, 0.0213), "ts", src)], "text", lambda: gps.start_gps_job(
        common.read_event_files(spark, src), out, ck, zones, every=None))
    return spark.read.parquet(f"{out}/positions").select("taxi_id", "zone_id", "zone_name", "event_time", "status")


@query(f"""SELECT taxi_id, {B.sql_grid('lat', 'lon')} AS zone_id, {_MILLIS} AS event_time, 'available' AS status FROM pings""", B.pings_sql(0.0213))
def stream_ingested_pings(spark, d):
    """Driver pings: outside points clamped, always available."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"ingest_{n}") for n in ("in", "out", "ck"))
    replay([(ping_messages(spark, d, 0.0213), "ts", src)], "text", lambda: gps.start_gps_job(
        common.read_event_files(spark, src), out, ck, ingest=True, every=None))
    return spark.read.parquet(f"{out}/positions").select("taxi_id", "zone_id", "event_time", "status")


@query(f"""SELECT taxi_id, n AS positions, n AS events, zone_id, event_time, round(metres, 1) AS metres, n AS measured FROM (
  SELECT taxi_id, count(*) AS n, arg_max(zone_id, (ts, lat, lon)) AS zone_id, max(ts) AS event_time, sum(step) AS metres FROM (
    SELECT *, coalesce({B.sql_haversine('plat', 'plon', 'lat', 'lon')}, 0) AS step FROM (
      SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM (
        SELECT taxi_id, lat, lon, {B.sql_grid('lat', 'lon')} AS zone_id, {_MILLIS} AS ts FROM pings)
      WINDOW w AS (PARTITION BY taxi_id ORDER BY ts, lat, lon)))
  GROUP BY 1)""", B.pings_sql(0.0213))
def stream_ping_fan_out(spark, d):
    """One read of driver pings feeds positions, events, driver index and odometer; all four per taxi."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"fan_{n}") for n in ("in", "out", "ck"))
    replay([(ping_messages(spark, d, 0.0213), "ts", src)], "text", lambda: gps.start_ingest_job(
        spark, common.read_event_files(spark, src), out, ck, every=None, ttl="3650 DAYS", keep_days=None))
    count = lambda df, name: df.groupBy("taxi_id").agg(F.count(F.lit(1)).alias(name))
    told, _ = gps.split_pings(spark.read.parquet(f"{out}/events").select("value", F.lit(None).cast("timestamp").alias("record_time")))
    index = sinks.read_keyed(spark, f"{out}/driver_index", ["taxi_id"], gps.LAST).select("taxi_id", "zone_id", "event_time")
    way = spark.read.parquet(f"{out}/odometer").groupBy("taxi_id").agg(
        F.round(F.sum("metres"), 1).alias("metres"), F.sum("pings").alias("measured"))
    return count(spark.read.parquet(f"{out}/positions"), "positions").join(count(told, "events"), "taxi_id", "full").join(
        index, "taxi_id", "full").join(way, "taxi_id", "full")


@query(f"""SELECT {_WINDOW_COLUMNS.replace("'casablanca' AS city, ", "")}, concat('Zone-', cast(zone_id AS varchar)) AS zone_name FROM w
  WHERE ws + INTERVAL 30 SECOND <= (SELECT make_timestamp(epoch_us(least((SELECT max(ts) FROM pings), (SELECT max(requested_at) FROM requests)))//1000*1000)
    - INTERVAL 180 SECOND)""", B.pings_sql(), B.REQUESTS, WINDOWS)
def stream_demand_windows(spark, d):
    """Two inputs with their own watermarks, two chained aggregations, windows behind the watermark."""
    common.configure(spark)
    gps_in, req_in, out, ck = (scratch_path(spark, f"demand_{n}") for n in ("gps", "req", "out", "ck"))
    zones = B.grid_polygons(spark)

    def start():
        # the grid normaliser gives the same zones as the polygons, without outside points here
        pos, _ = gps.normalise_gps(common.read_event_files(spark, gps_in))
        req, _ = demand.requests_from_events(common.read_event_files(spark, req_in))
        return demand.start_demand_job(demand.demand_stream(pos, req), zones, out, ck, every=None)

    replay([(ping_messages(spark, d), "ts", gps_in), (request_messages(spark, d), "ts", req_in)], "text", start)
    t = spark.read.parquet(f"{out}/demand_zones")
    return rounded(t, 6, "ratio").select("zone_id", "zone_name", "window_start", "active_vehicles", "pending_requests", "ratio")


_ETA = f"CASE WHEN m.taxi_id IS NOT NULL THEN greatest(30, cast(floor(m.d/{30000 / 3600!r}e0) AS int)) END"


@query(f"""SELECT r.trip_id, m.taxi_id AS driver_id, r.rider_id, round(m.d, 1) AS distance_meters, m.zone_id AS matched_zone,
  {_ETA} AS eta_seconds, r.origin_zone, r.destination_zone, true AS has_time, m.taxi_id AS trip_taxi, {_ETA} AS trip_eta,
  CASE WHEN m.taxi_id IS NULL THEN 'NO_TAXI_AVAILABLE' ELSE 'MATCHED' END AS status
  FROM requests r LEFT JOIN (SELECT trip_id, taxi_id, zone_id, d FROM (
    SELECT p.trip_id, v.taxi_id, v.zone_id, {B.sql_haversine('plat', 'plon', 'v.lat', 'v.lon')} AS d FROM pick p JOIN latest v
    ON v.status='available' AND abs((p.origin_zone-1)%4 - (v.zone_id-1)%4) <= 1 AND abs((p.origin_zone-1)//4 - (v.zone_id-1)//4) <= 1)
    QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY d, taxi_id) = 1) m USING (trip_id)""",
       B.pings_sql(), B.REQUESTS, _LATEST, _PICK)
def stream_match_events(spark, d):
    """One event per request, matched or not, against a written positions table."""
    common.configure(spark)
    src, out, ck, fleet = (scratch_path(spark, f"match_{n}") for n in ("in", "out", "ck", "fleet"))
    sinks.append_batch(positions(spark, d), fleet, 0)
    replay([(request_messages(spark, d), "ts", src)], "text", lambda: matching.start_match_job(
        common.read_event_files(spark, src), lambda: spark.read.parquet(fleet), out, ck, every=None, ttl=None))
    # through the same check as any consumer's: nothing may go to quarantine
    raw = spark.read.parquet(f"{out}/events").select("value")
    good, _ = events.split_valid(raw, S.MATCH_EVENT, [["trip_id"], ["status"], ["matched_at"]])
    e, rows = F.col("event"), spark.read.parquet(f"{out}/trips").select("trip_id", F.col("taxi_id").alias("trip_taxi"),
                                                                         F.col("eta_seconds").alias("trip_eta"))
    told = good.select(*[e[c].alias(c) for c in ("trip_id", "driver_id", "rider_id", "distance_meters", "eta_seconds",
                                                  "origin_zone", "destination_zone", "matched_zone", "status")],
                       (F.timestamp_millis(e["matched_at"]) > F.lit("2024-01-01").cast("timestamp")).alias("has_time"))
    return told.join(rows, "trip_id", "left")


@query(f"""SELECT r.trip_id, m.taxi_id AS driver_id, round(m.d, 1) AS distance_meters, m.zone_id AS matched_zone
  FROM requests r LEFT JOIN (SELECT trip_id, taxi_id, zone_id, d FROM (
    SELECT p.trip_id, v.taxi_id, v.zone_id, {B.sql_haversine('plat', 'plon', 'v.lat', 'v.lon')} AS d
    FROM pick p JOIN requests q USING (trip_id) JOIN (
      SELECT *, lead(ts) OVER (PARTITION BY taxi_id ORDER BY ts, event_id) AS gone FROM zoned) v
    ON v.ts <= date_trunc('second', q.requested_at) AND (v.gone IS NULL OR v.gone > date_trunc('second', q.requested_at))
    AND v.ts > date_trunc('second', q.requested_at) - INTERVAL 24 HOUR AND v.status='available'
    AND abs((p.origin_zone-1)%4 - (v.zone_id-1)%4) <= 1 AND abs((p.origin_zone-1)//4 - (v.zone_id-1)//4) <= 1)
    QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY d, taxi_id) = 1) m USING (trip_id)""",
       B.pings_sql(), B.REQUESTS, _ZONED, _PICK)
def stream_matches_as_of(spark, d):
    """Each request against the fleet of its own second, though one of the batch lies a year ahead."""
    common.configure(spark)
    src, out, ck, fleet = (scratch_path(spark, f"asof_{n}") for n in ("in", "out", "ck", "fleet"))
    sinks.append_batch(positions(spark, d), fleet, 0)
    ahead = B.requests(spark, d).limit(1).select(F.col("requested_at").alias("ts"), F.to_json(F.struct(
        F.lit("ahead").alias("trip_id"), "rider_id", "origin_zone", "destination_zone", "origin_lat", "origin_lon",
        (F.unix_millis("requested_at") + 365 * 86_400_000).alias("requested_at"))).alias("value"))
    replay([(request_messages(spark, d).unionByName(ahead), "ts", src)], "text", lambda: matching.start_match_job(
        common.read_event_files(spark, src), lambda: spark.read.parquet(fleet), out, ck, every=None))
    good, _ = events.split_valid(spark.read.parquet(f"{out}/events").select("value"), S.MATCH_EVENT, [["trip_id"]])
    e = F.col("event")
    return good.where(e["trip_id"] != "ahead").select(
        *[e[c].alias(c) for c in ("trip_id", "driver_id", "distance_meters", "matched_zone")])


@query("""SELECT taxi_id, arg_max(zone_id, (ts, event_id)) AS zone_id, max(ts) AS event_time FROM zoned
  WHERE ts <= TIMESTAMP '2024-01-15' AND ts >= TIMESTAMP '2024-01-15' - INTERVAL 6 HOUR GROUP BY 1""", B.pings_sql(), _ZONED)
def fleet_without_stale_taxis(spark, d):
    """The fleet as the matcher sees it at a point in time: later pings unknown, silent taxis gone."""
    rows = positions(spark, d)
    return matching.fleet_snapshot(rows, F.lit("2024-01-15").cast("timestamp"), "6 HOURS").select("taxi_id", "zone_id", "event_time")


@query("""SELECT trip_id, rider_id, strftime(requested_at, '%Y-%m-%d') AS date_bucket, origin_zone, destination_zone AS dest_zone, 'REQUESTED' AS status
  FROM requests""", B.REQUESTS)
def stream_requested_trips(spark, d):
    """New trip rows by city and day."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"request_{n}") for n in ("in", "out", "ck"))
    replay([(request_messages(spark, d), "ts", src)], "text", lambda: matching.start_request_job(
        common.read_event_files(spark, src), out, ck, every=None))
    t = spark.read.parquet(f"{out}/trips")
    return t.select("trip_id", "rider_id", F.col("date_bucket").cast("string").alias("date_bucket"), "origin_zone", "dest_zone", "status")


@query("""SELECT trip_id, rider_id, origin_zone, destination_zone, origin_lat, origin_lon, 33.5 + destination_zone/100 AS dest_lat,
  CAST(NULL AS DOUBLE) AS dest_lon, epoch_us(requested_at)//1000 AS requested_at, CASE WHEN origin_zone%2=0 THEN 'B' ELSE 'A' END AS call_type
  FROM requests""", B.REQUESTS)
def stream_request_events(spark, d):
    """What the request job publishes, read as the next job reads it: every declared field survives."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"published_{n}") for n in ("in", "out", "ck"))
    r = B.requests(spark, d).withColumns({
        "dest_lat": 33.5 + F.col("destination_zone") / 100,
        "call_type": F.when(F.col("origin_zone") % 2 == 0, "B")})
    fields = F.struct("trip_id", "rider_id", "origin_zone", "destination_zone", "origin_lat", "origin_lon", "dest_lat",
                      "call_type", F.unix_millis("requested_at").alias("requested_at"))
    replay([(r.select(F.col("requested_at").alias("ts"), F.to_json(fields).alias("value")), "ts", src)], "text",
           lambda: matching.start_request_job(common.read_event_files(spark, src), out, ck, every=None))
    good, _ = events.split_valid(spark.read.parquet(f"{out}/events").select("value"), S.TRIP_REQUEST_EVENT, [["trip_id"], ["requested_at"]])
    e = F.col("event")
    return good.select(*[e[c].alias(c) for c in ("trip_id", "rider_id", "origin_zone", "destination_zone", "origin_lat",
                                                 "origin_lon", "dest_lat", "dest_lon", "requested_at", "call_type")])


def _lifecycle(spark, d):
    """Driver events in three deliveries: every third event of the hour before the middle comes with the
    second half, one batch after newer events of its driver; at last a tick lets the watermark pass all."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"life_{n}") for n in ("in", "out", "ck"))
    e = B.driver_events(spark, d)
    b = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        F.timestamp_micros(((F.unix_micros("lo") + F.unix_micros("hi")) / 2).cast("long")).alias("cut"), "hi").first()
    late = (F.col("ts") > F.lit(b["cut"]) - F.expr("INTERVAL 1 HOUR")) & (F.col("seq") % 3 == 0)
    early = (F.col("ts") <= F.lit(b["cut"])) & ~late
    tick = e.limit(1).select(*[
        {"driver_id": F.lit(""), "kind": F.lit(lifecycle.TICK), "ts": F.lit(b["hi"]) + F.expr("INTERVAL 1 DAY")}.get(
            f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in e.schema])
    for rows in (e.where(early), e.where(~early), tick):
        rows.write.mode("append").parquet(src)
        stream = spark.readStream.schema(e.schema).parquet(src)
        writer = lifecycle.lifecycle_stream(stream, "2 hours").writeStream.outputMode("append").format("parquet").option("path", out)
        common.job(writer, ck, None).start().awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT trip_id, driver_id, ts, seq, CASE kind WHEN 'accept' THEN 'ACCEPTED' WHEN 'reject' THEN 'REJECTED'
  WHEN 'start' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status FROM statuses""", B.DRIVER_EVENTS, LIFECYCLE)
def stream_lifecycle_statuses(spark, d):
    """Keyed state machine in event-time order; same rows as the batch form, though some events come one batch late."""
    return _lifecycle(spark, d).select("trip_id", "driver_id", "ts", "seq", "status")


@query(COMPLETION_ROWS, B.DRIVER_EVENTS, LIFECYCLE)
def stream_completions(spark, d):
    """Odometer and minutes accumulated in state."""
    return _lifecycle(spark, d).where("status = 'COMPLETED'").select(
        "trip_id", "driver_id", "client_id", F.col("ts").alias("completed_at"), "distance_km", "duration_min", "surge")


@query("SELECT trip_id, driver_id, client_id, distance_km, duration_min, total_fare, status, created_at FROM billed", B.TRIPS, COMPLETIONS, BILLED)
def stream_billing(spark, d):
    """Billed once per trip across batches, bad messages aside."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"bill_{n}") for n in ("in", "out", "ck"))
    replay([(completion_events(spark, d), "record_time", src)], "text", lambda: billing.start_billing_job(
        spark, common.read_event_files(spark, src), out, ck, every=None))
    return spark.read.parquet(f"{out}/billing").select(
        "trip_id", "driver_id", "client_id", "distance_km", "duration_min", "total_fare", "status", "created_at")


@query("SELECT count(*) AS messages, count(DISTINCT trip_id) AS trips FROM completions WHERE cast(trip_id AS bigint) > 0", B.TRIPS, COMPLETIONS)
def stream_archive(spark, d):
    """Raw topic to JSON lines by hour of arrival, read back whole."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"archive_{n}") for n in ("in", "out", "ck"))
    replay([(completion_events(spark, d), "record_time", src)], "text", lambda: archive.start_archive_job(
        common.read_event_files(spark, src), "trip.completed", out, ck, every=None))
    raw = spark.read.schema("value string").text(f"{out}/topic=*/year=*/month=*/day=*/hour=*").withColumn(
        "record_time", F.lit(None).cast("timestamp"))
    good, _ = billing.completions_from_events(raw)
    return good.agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("trip_id").alias("trips"))


@query("SELECT trip_id, min(completed_at) AS first FROM completions GROUP BY 1", B.TRIPS, COMPLETIONS)
def stream_deduplicated(spark, d):
    """Copies of a trip dropped inside a watermark wide enough for the whole replay."""
    common.configure(spark)
    src, out, ck = (scratch_path(spark, f"dedupe_{n}") for n in ("in", "out", "ck"))

    def start():
        good, _ = billing.completions_from_events(common.read_event_files(spark, src))
        once = billing.without_repeats(good, "36500 days").select("trip_id")
        return common.job(once.writeStream.format("parquet").option("path", out), ck, None).start()

    replay([(completion_events(spark, d), "record_time", src)], "text", start)
    first = B.trips_hist(spark, d).groupBy(F.col("trip_id").cast("string").alias("trip_id")).agg(F.min("pickup_ts").alias("first"))
    return spark.read.parquet(out).join(first, "trip_id", "left")


@query("SELECT cast(count(*) AS bigint) AS messages, count(DISTINCT taxi_id) AS taxis FROM pings", B.pings_sql())
def topic_replay(spark, d):
    """A folder of messages from its beginning, as a batch."""
    src = scratch_path(spark, "topic")
    sinks.write_events(ping_messages(spark, d).select("value"), src)
    raw = common.replay_event_files(spark, src)
    good, _ = gps.split_pings(raw)
    return good.agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("taxi_id").alias("taxis"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'gps' AS kind FROM pings UNION ALL SELECT 'trip' FROM requests) GROUP BY 1", B.pings_sql(), B.REQUESTS)
def stream_tagged_union(spark, d):
    """Two streams under one schema with a tag."""
    from kerbside.operators import demand as demand_ops

    common.configure(spark)
    gps_in, req_in, out, ck = (scratch_path(spark, f"union_{n}") for n in ("gps", "req", "out", "ck"))

    def start():
        pos, _ = gps.normalise_gps(common.read_event_files(spark, gps_in))
        req, _ = demand.requests_from_events(common.read_event_files(spark, req_in))
        both = demand_ops.demand_events(pos.withColumnRenamed("event_time", "ts"), req)
        return common.job(both.writeStream.format("parquet").option("path", out), ck, None).start()

    replay([(ping_messages(spark, d), "ts", gps_in), (request_messages(spark, d), "ts", req_in)], "text", start)
    return spark.read.parquet(out).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
