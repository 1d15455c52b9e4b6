"""Trips: requests, life cycle, odometer, status views, lists and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import geo, scalars
from kerbside.operators import curate, tables, timeline
from kerbside.session import cut_lineage


# --- requests ----------------------------------------------------------------------------------


def request_trips(requests: DataFrame, created_at: Column, user: Column | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """New trip rows from requests, columns to ``keep`` behind them. Batch or stream.

    Zones: explicit 1..16, else from coordinates, else 1. Rider: given, else the signed-in user,
    else "unknown".
    """
    blank_to_null = lambda c: F.when(F.trim(c) != "", c)
    rider = [blank_to_null(F.col("rider_id"))]
    if user is not None:
        rider.append(blank_to_null(user))
    return requests.select(
        F.lit(S.CITY_NAME).alias("city"), scalars.date_bucket(created_at).alias("date_bucket"),
        created_at.alias("created_at"), "trip_id", F.coalesce(*rider, F.lit("unknown")).alias("rider_id"),
        geo.resolve_zone(F.col("origin_zone"), F.col("origin_lat"), F.col("origin_lon")).alias("origin_zone"),
        geo.resolve_zone(F.col("destination_zone"), F.col("dest_lat"), F.col("dest_lon")).alias("dest_zone"),
        F.lit("REQUESTED").alias("status"), *(keep or []),
    )


def request_events(requests: DataFrame, created_at: Column, user: Column | None = None) -> DataFrame:
    """What a request publishes: the fields of ``TRIP_REQUEST_EVENT``, zones and rider resolved.

    Absent coordinates stay absent; the call type is the given one, else "A".
    """
    places = ["origin_lat", "origin_lon", "dest_lat", "dest_lon"]
    given = requests if "call_type" in requests.columns else requests.withColumn("call_type", F.lit(None).cast("string"))
    out = request_trips(given, created_at, user, keep=[*places, "call_type"])
    return out.select("trip_id", "rider_id", "origin_zone", F.col("dest_zone").alias("destination_zone"), *places,
                      F.unix_millis("created_at").alias("requested_at"), F.coalesce("call_type", F.lit("A")).alias("call_type"))


def matched_trips(matches: DataFrame, matched_at: Column) -> DataFrame:
    """Trip rows of matched requests: who comes, and in how many seconds."""
    return matches.where("status = 'MATCHED'").select(
        F.lit(S.CITY_NAME).alias("city"), scalars.date_bucket(matched_at).alias("date_bucket"),
        matched_at.alias("created_at"), "trip_id", "rider_id", F.col("driver_id").alias("taxi_id"), "origin_zone",
        F.col("destination_zone").alias("dest_zone"), "status", "eta_seconds")


# --- odometer ----------------------------------------------------------------------------------


def ping_deltas(pings: DataFrame, keys: list[str], order: list[str], bucket: str = "1 hour",
                cuts: timeline.Cuts | None = None) -> DataFrame:
    """Pings with the metres since the previous ping of the same key; 0 for the first."""
    with_prev = timeline.previous_row(pings, keys, order, ["lat", "lon"], bucket, cuts=cuts)
    return with_prev.withColumn("delta_m", F.coalesce(
        geo.haversine_m(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))


def odometer(pings: DataFrame, trip: str = "trip_id", ts: str = "ts", tiebreak: str = "seq") -> DataFrame:
    """Kilometres and minutes per trip from its pings. Nothing accumulated counts as 5.0 km."""
    deltas = ping_deltas(pings, [trip], [ts, tiebreak])
    km = F.sum("delta_m") / 1000
    minutes = (F.unix_millis(F.max(ts)) - F.unix_millis(F.min(ts))) / 60000
    return deltas.groupBy(trip).agg(
        F.round(F.when(km > 0, km).otherwise(F.lit(5.0)), 3).alias("distance_km"),
        F.round(minutes, 2).alias("duration_min"), F.count(F.lit(1)).alias("pings"))


# --- life cycle --------------------------------------------------------------------------------


def trip_lifecycle(events: DataFrame, bucket: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(status events, completion events) of the driver state machine, as ordered lookups.

    events: driver_id, ts, seq, kind, trip_id, client_id, lat, lon; kind is one of assign, accept,
    reject, start, complete, ping. Same rules as the streaming form: accept and reject need a
    pending trip, start and complete an active one, everything else is ignored.

    The pending slot is set by assign and emptied by accept or reject, so accept is valid exactly
    when the event before it among {assign, accept, reject} is an assign. The active slot follows
    from valid accepts and completes in the same way. No per-driver loop is needed.
    """
    order = ["ts", "seq"]
    cuts = timeline.count_cuts(events, ["driver_id"], "ts", bucket)  # fits every subset of the events
    base = ["driver_id", "ts", "seq", "kind", "trip_id", "client_id"]
    slot = events.where(F.col("kind").isin("assign", "accept", "reject")).select(*base)
    slot = timeline.previous_row(slot, ["driver_id"], order, ["kind", "trip_id", "client_id"], cuts=cuts)
    answered = slot.where((F.col("kind") != "assign") & (F.col("prev_kind") == "assign")).select(
        "driver_id", "ts", "seq", F.col("kind"), F.col("prev_trip_id").alias("trip_id"),
        F.col("prev_client_id").alias("client_id"))
    answered = cut_lineage(answered)  # used by three branches below, and small next to the pings
    accepted = answered.where("kind = 'accept'")
    rejected = answered.where("kind = 'reject'")

    rides = events.where(F.col("kind").isin("start", "complete")).select(
        "driver_id", "ts", "seq", "kind", F.lit(None).cast("string").alias("trip_id"),
        F.lit(None).cast("string").alias("client_id"))
    turns = accepted.unionByName(rides.where("kind = 'complete'"))
    active = timeline.as_of_join(
        rides.select("driver_id", "ts", "seq", "kind"), turns, ["driver_id"], "ts", "ts",
        ["kind", "trip_id", "client_id"], right_order=["seq"], left_order=["seq"], strict=True, cuts=cuts,
    ).where("asof_kind = 'accept'")
    active = active.select("driver_id", "ts", "seq", "kind", F.col("asof_trip_id").alias("trip_id"),
                           F.col("asof_client_id").alias("client_id"))
    active = cut_lineage(active)

    label = F.create_map(*[F.lit(v) for v in (
        "accept", "ACCEPTED", "reject", "REJECTED", "start", "IN_PROGRESS", "complete", "COMPLETED")])
    statuses = accepted.unionByName(rejected).unionByName(active).select(
        "trip_id", "driver_id", label[F.col("kind")].alias("status"), "ts", "seq")

    starts = active.where("kind = 'start'").select(
        "driver_id", "trip_id", F.col("ts").alias("start_ts"), F.col("seq").alias("start_seq"))
    # a ping counts for the ride whose start is the last turn of its driver
    marks = (accepted.unionByName(active)).select("driver_id", "ts", "seq", "kind", "trip_id")
    pings = ping_deltas(events.where("kind = 'ping'").select("driver_id", "ts", "seq", "lat", "lon"),
                        ["driver_id"], order, cuts=cuts)
    counted = timeline.as_of_join(
        pings.select("driver_id", "ts", "seq", "delta_m"), marks.withColumn("mark_seq", F.col("seq")),
        ["driver_id"], "ts", "ts", ["kind", "trip_id", "mark_seq"], right_order=["seq"],
        left_order=["seq"], cuts=cuts,
    ).where("asof_kind = 'start'")
    ridden = counted.groupBy("driver_id", F.col("asof_trip_id").alias("trip_id"),
                             F.col("asof_mark_seq").alias("start_seq")).agg(F.sum("delta_m").alias("metres"))

    done = active.where("kind = 'complete'").select("driver_id", "trip_id", "client_id", "ts", "seq")
    done = timeline.as_of_join(done, starts, ["driver_id", "trip_id"], "ts", "start_ts", ["start_seq"],
                               right_order=["start_seq"], left_order=["seq"], prefix="",
                               cuts=timeline.Cuts(bucket))  # a trip has few turns
    done = done.join(ridden, ["driver_id", "trip_id", "start_seq"], "left")
    return statuses, done.select(
        "trip_id", "driver_id", F.coalesce("client_id", F.lit("unknown")).alias("client_id"),
        F.col("ts").alias("completed_at"), *completion_metrics(F.col("start_ts"), F.col("ts"), F.col("metres")),
        F.lit(1.0).alias("surge"))


def completion_metrics(start_ts: Column, end_ts: Column, metres: Column) -> list[Column]:
    """distance_km (5.0 when nothing was measured) and duration_min (5.0 without a start)."""
    minutes = (F.unix_millis(end_ts) - F.unix_millis(start_ts)) / 60000
    return [
        F.round(F.when(metres > 0, metres / 1000).otherwise(F.lit(5.0)), 3).alias("distance_km"),
        F.round(F.coalesce(minutes, F.lit(5.0)), 2).alias("duration_min"),
    ]


# --- status views ------------------------------------------------------------------------------


def trip_status_view(trips: DataFrame, matches: DataFrame, statuses: DataFrame) -> DataFrame:
    """Trips with the fields of their last match and their last status; unknown trips are ignored.

    matches: trip_id, driver_id, eta_seconds, ts. statuses: trip_id, status, ts, seq.
    """
    m = matches.groupBy("trip_id").agg(
        F.max_by(F.struct("driver_id", "eta_seconds"), F.struct("ts", "driver_id")).alias("m"),
        F.max("ts").alias("m_ts"))
    s = statuses.groupBy("trip_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("s"), F.max("ts").alias("s_ts"))
    later_status = F.col("s").isNotNull() & (F.col("m_ts").isNull() | (F.col("s_ts") >= F.col("m_ts")))
    return trips.join(m, "trip_id", "left").join(s, "trip_id", "left").withColumns({
        "taxi_id": F.coalesce("m.driver_id", "taxi_id"),
        "eta_seconds": F.coalesce("m.eta_seconds", "eta_seconds"),
        "status": F.when(later_status, F.col("s")).when(F.col("m").isNotNull(), "MATCHED").otherwise(F.col("status")),
    }).drop("m", "m_ts", "s", "s_ts")


def trip_feed(pings: DataFrame, activity: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Pings of drivers on a trip, with that trip.

    activity: driver_id, changed_at, seq, active_trip (null when the driver becomes free).
    """
    out = timeline.as_of_join(pings, activity, ["driver_id"], "ts", "changed_at", ["active_trip"],
                              right_order=["seq"], bucket=bucket)
    return out.where(F.col("asof_active_trip").isNotNull()).withColumnRenamed(
        "asof_active_trip", "trip_id").drop("asof_changed_at")


# --- lists and statistics ----------------------------------------------------------------------

LIST_DEFAULTS = {"status": "", "taxi_id": "", "rider_id": "", "eta_seconds": 0, "origin_zone": 1, "dest_zone": 1}


def admin_trips(stored: DataFrame, day: str, status: str | None = None, recent: DataFrame | None = None,
                limit: int | None = 50) -> DataFrame:
    """Trips of a day, optionally of one status; rows not yet stored come first, then newest first."""
    pick = lambda df: curate.with_status(df.where(F.col("date_bucket") == day), status)
    rows = pick(stored).withColumn("_recent", F.lit(0))
    if recent is not None:
        rows = tables.overlay(pick(stored), pick(recent).select(*stored.columns), "trip_id")
        rows = rows.withColumn("_recent", 1 - F.col("_recent"))  # stored rows win, cached ones fill in
    rows = tables.with_defaults(rows, {**LIST_DEFAULTS, **({"fare": 0} if "fare" in rows.columns else {})})
    ordered = rows.orderBy(F.col("_recent").desc(), F.col("created_at").desc(), "trip_id").drop("_recent")
    return ordered if limit is None else ordered.limit(limit)


def client_trips(stored: DataFrame, client: str, today: str, days: int = 3, limit: int = 50,
                 recent: DataFrame | None = None) -> DataFrame:
    """A client's trips of the last ``days`` UTC days; the day filter prunes partitions."""
    first = F.date_format(F.date_sub(F.lit(today).cast("date"), days - 1), "yyyy-MM-dd")
    rows = stored.where(F.col("date_bucket").between(first, F.lit(today)) & (F.col("rider_id") == client))
    rows = rows.withColumn("_recent", F.lit(0))
    if recent is not None:
        mine = recent.where(F.col("rider_id") == client).select(*stored.columns)
        rows = tables.overlay(rows.drop("_recent"), mine, "trip_id").withColumn("_recent", 1 - F.col("_recent"))
    rows = tables.with_defaults(rows, LIST_DEFAULTS)
    return rows.orderBy(F.col("_recent").desc(), F.col("created_at").desc(), "trip_id").limit(limit).drop("_recent")


def trip_stats(trips: DataFrame, day: str | None = None) -> DataFrame:
    """Trips per status class and mean wait in whole seconds, per day."""
    rows = trips if day is None else trips.where(F.col("date_bucket") == day)
    status = F.upper(F.coalesce("status", F.lit("")))
    group = (
        F.when(status.isin("MATCHED", "ACCEPTED"), "matched").when(status == "IN_PROGRESS", "in_progress")
        .when(status == "COMPLETED", "completed").when(status.isin("CANCELLED", "REJECTED"), "cancelled")
        .otherwise("requested")
    )
    waits = F.col("_class").isin("matched", "completed") & (F.col("eta_seconds") > 0)
    n = lambda name: F.count(F.when(F.col("_class") == name, 1)).alias(name)
    wait_sum = F.coalesce(F.sum(F.when(waits, F.col("eta_seconds").cast("long"))), F.lit(0))
    wait_n = F.count(F.when(waits, 1))
    return rows.withColumn("_class", group).groupBy(F.col("date_bucket").alias("date")).agg(
        F.count(F.lit(1)).alias("total_trips"), n("requested"), n("matched"), n("in_progress"),
        n("completed"), n("cancelled"),
        F.when(wait_n > 0, F.floor(wait_sum / wait_n)).otherwise(F.lit(0)).cast("long").alias("avg_wait_seconds"))


def day_panel(trips: DataFrame, day: str) -> DataFrame:
    """Trips of a day and their mean ETA."""
    return trips.where(F.col("date_bucket") == day).agg(
        F.count(F.lit(1)).alias("total_trips"), F.avg("eta_seconds").alias("avg_eta"))


# --- drivers -----------------------------------------------------------------------------------


def driver_states(status: DataFrame, positions: DataFrame, active: DataFrame, pending: DataFrame,
                  index: DataFrame) -> DataFrame:
    """Every driver known to any of the five sources, with status, trips and position.

    One row per driver in every source: status (driver_id, status), positions and index
    (driver_id, lat, lon, ts), active and pending (driver_id, trip_id).
    """
    parts = [
        status.select("driver_id", "status"),
        positions.select("driver_id", F.struct("lat", "lon", "ts").alias("_pos")),
        active.select("driver_id", F.col("trip_id").alias("active_trip")),
        pending.select("driver_id", F.col("trip_id").alias("pending_trip")),
        index.select("driver_id", F.struct("lat", "lon").alias("_idx")),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    # one row per driver in every part: the only value per column, in a single shuffle
    out = stacked.groupBy("driver_id").agg(
        *[F.max(c).alias(c) for c in ("status", "_pos", "active_trip", "pending_trip", "_idx")])
    return out.select(
        "driver_id",
        F.when(F.col("active_trip").isNotNull(), "BUSY").otherwise(F.col("status")).alias("known_status"),
        "active_trip", "pending_trip",
        F.when(F.col("_pos").isNotNull(), F.col("_pos.lat")).otherwise(F.col("_idx.lat")).alias("lat"),
        F.when(F.col("_pos").isNotNull(), F.col("_pos.lon")).otherwise(F.col("_idx.lon")).alias("lon"),
        F.col("_pos.ts").alias("last_seen"),
        (F.col("_pos").isNull() & F.col("_idx").isNotNull()).alias("from_index"),
    )


def list_drivers(states: DataFrame, status: str | None = None, page_no: int = 0, size: int = 20) -> DataFrame:
    """Page of drivers by id; a driver without status counts as available."""
    rows = states.withColumn("status", F.coalesce("known_status", F.lit("AVAILABLE")))
    rows = curate.with_status(rows, status).select(
        "driver_id", "status", "active_trip", "pending_trip", "lat", "lon", "last_seen")
    return tables.page(rows, [F.col("driver_id")], page_no, size)[0]


def driver_details(states: DataFrame, trips: DataFrame, recent: int = 10) -> DataFrame:
    """Driver with status, position and the newest trips nested.

    A driver without status is offline, or available when only the index knows the position.
    Ranking keeps ``recent`` rows per driver before the shuffle, so the list is bounded.
    """
    newest = Window.partitionBy("driver_id").orderBy(F.col("created_at").desc(), "trip_id")
    last = (
        trips.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= recent)
        .groupBy("driver_id").agg(F.array_sort(F.collect_list(F.struct("_n", "trip_id", "status"))).alias("_trips"))
    )
    status = F.coalesce("known_status", F.when(F.col("from_index"), "AVAILABLE"), F.lit("OFFLINE"))
    return states.join(last, "driver_id", "left").select(
        "driver_id", status.alias("status"), "active_trip", "pending_trip", "lat", "lon",
        F.coalesce(F.transform("_trips", lambda t: F.struct(t["trip_id"].alias("trip_id"), t["status"].alias("status"))),
                   F.array().cast("array<struct<trip_id:string,status:string>>")).alias("recent_trips"))


def live_positions(index: DataFrame, local: DataFrame, active: DataFrame, status: DataFrame) -> DataFrame:
    """Index positions, overridden by the local row of the same driver."""
    busy = active.select("driver_id", F.lit(True).alias("_busy"))
    rows = tables.overlay(local.select("driver_id", "lat", "lon"), index.select("driver_id", "lat", "lon"), "driver_id")
    rows = rows.join(busy, "driver_id", "left").join(status.select("driver_id", "status"), "driver_id", "left")
    own = F.when(F.col("_recent") == 1, F.col("status"))
    return rows.select("driver_id", "lat", "lon",
                       F.when(F.col("_busy"), "BUSY").otherwise(F.coalesce(own, F.lit("AVAILABLE"))).alias("status"))
