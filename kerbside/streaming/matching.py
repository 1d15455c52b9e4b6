"""Match trip requests against the latest known positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside import schemas as S
from kerbside import sinks
from kerbside.functions import events
from kerbside.operators import proximity, tables, timeline, trips
from kerbside.session import broadcast_if_small, cut_lineage
from kerbside.streaming import common
from kerbside.streaming.demand import requests_from_events


def fleet_snapshot(positions: DataFrame, as_of=None, ttl: str = "24 HOURS") -> DataFrame:
    """One row per taxi, its newest position no older than the table keeps, at or before ``as_of``."""
    rows = positions
    if as_of is not None:
        rows = tables.apply_retention(rows.where(F.col("event_time") <= as_of), "event_time", ttl, as_of)
    return tables.latest_per_key(rows.select("taxi_id", "event_time", "zone_id", "lat", "lon", "status"),
                                 ["taxi_id"], ["event_time", "zone_id", "lat", "lon", "status"])


def fleets_at(positions: DataFrame, instants: DataFrame, ttl: str = "24 HOURS") -> DataFrame:
    """The fleet at every instant of ``instants`` (instant, whole seconds): one row per instant and taxi
    whose newest position at or before it is no older than ``ttl``.

    A position stands from its second to the taxi's next one, or until the table forgets it; the
    instants inside are joined by hour, so nothing is paired with instants far from it.
    """
    age = F.expr(f"cast(INTERVAL {ttl} AS INTERVAL SECOND)")
    keep = F.unix_seconds(F.timestamp_seconds(F.lit(0)) + age)
    rows = positions.select("taxi_id", "event_time", "zone_id", "lat", "lon", "status",
                            F.ceil(F.unix_micros("event_time") / 1_000_000).cast("long").alias("since"))
    span = instants.agg(F.min("instant").alias("lo"), F.max("instant").alias("hi"))
    lo, hi = (F.lit(x) for x in span.first())
    rows = rows.where((F.col("since") <= hi) & (F.col("event_time") > F.timestamp_seconds(lo) - age))
    rows = tables.latest_per_key(rows, ["taxi_id", "since"], ["event_time", "zone_id", "lat", "lon", "status"])
    after = timeline.previous_row(rows.select("taxi_id", (-F.col("since")).alias("back")).withColumn(
        "at", F.timestamp_seconds("back")), ["taxi_id"], ["at"], ["back"], "1 day")
    rows = rows.join(after.select("taxi_id", (-F.col("back")).alias("since"), (-F.col("prev_back")).alias("next")), ["taxi_id", "since"])
    until = F.least(F.col("since") + keep, F.coalesce("next", F.col("since") + keep))  # exclusive
    hour = lambda c: F.floor(c / 3600).cast("long")
    first, last = F.greatest(F.col("since"), lo), F.least(F.col("until") - 1, hi)
    rows = rows.withColumn("until", until).where(first <= last).withColumn("hour", F.explode(F.sequence(hour(first), hour(last))))
    found = rows.join(broadcast_if_small(instants.select("instant", hour(F.col("instant")).alias("hour"))), "hour")
    found = found.where((F.col("since") <= F.col("instant")) & (F.col("instant") < F.col("until"))
                        & (F.col("event_time") > F.timestamp_seconds("instant") - age))
    return found.select("instant", "taxi_id", "event_time", "zone_id", "lat", "lon", "status")


def match_events(matches: DataFrame) -> DataFrame:
    """One message per request, matched or not, as ``MATCH_EVENT`` declares it, keyed by trip."""
    return events.to_event(matches.withColumn("matched_at", F.unix_millis("matched_at")),
                           S.MATCH_EVENT.fieldNames(), key="trip_id")


def start_match_job(raw_requests: DataFrame, read_positions: Callable[[], DataFrame], out: str,
                    checkpoint: str, every: str | None = "5 seconds", ttl: str | None = "24 HOURS") -> StreamingQuery:
    """Per micro-batch: matches, their trip rows, one event per request, quarantine for bad ones.

    ``read_positions`` opens the positions table anew for every batch; only rows between the first and
    the last request and ``ttl`` before them are read. A request sees the fleet as of its own second:
    positions up to it and no older than ``ttl``, so a vehicle that fell silent isn't sent and a request
    with a wrong clock changes no other's match. ``None`` takes the newest position of any age.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch, matches = batch.persist(), None
        try:
            good, bad = requests_from_events(batch)
            unique = tables.first_per_key(good, ["trip_id"], ["requested_at", "rider_id"])
            if ttl is None:
                found = proximity.match_nearest(unique, fleet_snapshot(read_positions()))
            else:
                unique = unique.withColumn("instant", F.unix_seconds("requested_at"))
                instants = cut_lineage(unique.select("instant").distinct().where("instant is not null"))
                found = proximity.match_nearest(unique, fleets_at(read_positions(), instants, ttl), "instant")
            matches = found.withColumn("matched_at", F.current_timestamp()).persist()
            sinks.append_batch(matches.where("status = 'MATCHED'"), f"{out}/matches", batch_id)
            sinks.append_batch(trips.matched_trips(matches, F.col("matched_at")), f"{out}/trips", batch_id,
                               ["city", "date_bucket"])
            sinks.append_batch(match_events(matches), f"{out}/events", batch_id)
            sinks.append_batch(bad, f"{out}/quarantine", batch_id)
        finally:
            batch.unpersist()
            if matches is not None:
                matches.unpersist()

    return common.job(raw_requests.writeStream.foreachBatch(write), checkpoint, every).start()


def start_request_job(raw_requests: DataFrame, out: str, checkpoint: str,
                      every: str | None = "60 seconds") -> StreamingQuery:
    """New trip rows and one event per request, keyed by origin zone."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = events.split_valid(batch, S.TRIP_REQUEST_EVENT, [["trip_id"]])
            e = F.col("event")
            same = ["trip_id", "origin_zone", "destination_zone", "origin_lat", "origin_lon", "dest_lat", "dest_lon", "call_type"]
            fields = good.select(
                *[e[c].alias(c) for c in same], F.coalesce(e["rider_id"], e["client_id"]).alias("rider_id"),
                events.event_time(e["requested_at"], F.col("record_time")).alias("created_at"))
            created = F.col("created_at")
            sinks.append_batch(trips.request_trips(fields, created), f"{out}/trips", batch_id, ["city", "date_bucket"])
            sinks.append_batch(events.to_event(trips.request_events(fields, created), key="origin_zone"),
                               f"{out}/events", batch_id)
            sinks.append_batch(bad, f"{out}/quarantine", batch_id)
        finally:
            batch.unpersist()

    return common.job(raw_requests.writeStream.foreachBatch(write), checkpoint, every).start()
