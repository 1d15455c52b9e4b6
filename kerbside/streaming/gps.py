"""GPS stream: normalise pings, quarantine bad records, driver ingest."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside import schemas as S
from kerbside import sinks
from kerbside.functions import events, geo
from kerbside.operators import tables, timeline
from kerbside.operators import zones as zone_ops
from kerbside.session import broadcast_if_small
from kerbside.streaming import common

REQUIRED = [["taxi_id", "driver_id"], ["timestamp"], ["lat"], ["lon"]]
POSITION = ["city", "zone_id", "zone_name", "event_time", "taxi_id", "lat", "lon", "speed", "status"]


def split_pings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw records (value, record_time) to (pings, quarantine). Batch or stream."""
    good, bad = events.split_valid(raw, S.PING_EVENT, REQUIRED)
    e = F.col("event")
    pings = good.select(
        F.coalesce(e["taxi_id"], e["driver_id"]).alias("taxi_id"),
        events.event_time(e["timestamp"], F.col("record_time")).alias("event_time"),
        e["lat"].alias("lat"), e["lon"].alias("lon"),
        F.coalesce(e["speed"], F.lit(0.0)).alias("speed"),
        F.coalesce(e["status"], F.lit("available")).alias("status"),
    )
    return pings, bad


def normalise_gps(raw: DataFrame, zones: DataFrame | zone_ops.ZoneCover | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions inside the city, quarantine). Zones by polygon, or by grid without polygons."""
    pings, bad = split_pings(raw)
    placed = (zone_ops.assign_zone_grid(pings) if zones is None
              else zone_ops.assign_zone_polygon(pings, zones, how="inner"))
    return placed.withColumn("city", F.lit(S.CITY_NAME)).select(*POSITION), bad


def ingest_pings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Driver pings: outside points go to the nearest zone, named ``Zone-n``, always available."""
    pings, bad = split_pings(raw)
    placed = zone_ops.assign_zone_grid(pings, mode="clamp")
    return placed.withColumns({"city": F.lit(S.CITY_NAME), "status": F.lit("available")}).select(*POSITION), bad


def enriched_events(positions: DataFrame) -> DataFrame:
    """Message per position, keyed by taxi."""
    return events.to_event(
        positions.withColumn("timestamp", F.unix_millis("event_time")),
        ["taxi_id", "timestamp", "lat", "lon", "speed", "status", "zone_id", "zone_name"], key="taxi_id")


def start_gps_job(raw: DataFrame, out: str, checkpoint: str, zones: DataFrame | None = None,
                  ingest: bool = False, every: str | None = "60 seconds") -> StreamingQuery:
    """Per micro-batch: positions table, enriched events, quarantine, each replaced on a replay.

    The zones' cover is built here, once; a micro-batch only joins with it.
    """
    cover = None if zones is None or ingest else zone_ops.zone_cover(zones)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = ingest_pings(batch) if ingest else normalise_gps(batch, cover)
            sinks.append_batch(good, f"{out}/positions", batch_id, ["city"])
            sinks.append_batch(enriched_events(good), f"{out}/events", batch_id)
            sinks.append_batch(bad, f"{out}/quarantine", batch_id)
        finally:
            batch.unpersist()

    return common.job(raw.writeStream.foreachBatch(write), checkpoint, every).start()


LAST = ["event_time", "lat", "lon"]


def last_known(spark: SparkSession, index: str, before: int, taxis: DataFrame, ttl: str) -> DataFrame | None:
    """(taxi_id, event_time, lat, lon): the newest position that batches before ``before`` left of these
    taxis, none older than ``ttl`` before the taxi's first ping now. Their hash folders are named in a filter.

    taxis: taxi_id, bucket, first_ping.
    """
    buckets = [r["bucket"] for r in taxis.select("bucket").distinct().collect()]  # at most common.BUCKETS
    try:
        stored = sinks.read_table(spark, index)
    except AnalysisException:  # nothing written yet
        return None
    stored = stored.where(F.col("bucket").isin(buckets) & (F.col("batch_id") < before))
    stored = stored.join(broadcast_if_small(taxis.select("taxi_id", "first_ping"), 1_000_000), "taxi_id")
    stored = stored.where(F.col("event_time") > F.col("first_ping") - F.expr(f"INTERVAL {ttl}"))
    return tables.latest_per_key(stored.select("taxi_id", *LAST), ["taxi_id"], LAST)


def way_since(pings: DataFrame, known: DataFrame | None) -> DataFrame:
    """(taxi_id, metres, pings) added by new pings: from the last known position on, in order of time.

    Pings that aren't newer than the last known one come too late to count.
    """
    rows = pings.select("taxi_id", *LAST)
    if known is not None:
        seen = broadcast_if_small(known.select("taxi_id", F.struct(*LAST).alias("_known")), 1_000_000)
        rows = rows.join(seen, "taxi_id", "left").where(
            F.col("_known").isNull() | (F.struct(*LAST) > F.col("_known"))).drop("_known")
        rows = rows.withColumn("_new", F.lit(1)).unionByName(known.select("taxi_id", *LAST).withColumn("_new", F.lit(0)))
    else:
        rows = rows.withColumn("_new", F.lit(1))
    steps = timeline.previous_row(rows, ["taxi_id"], LAST, ["lat", "lon"])
    steps = steps.where("_new = 1").withColumn("_m", F.coalesce(
        geo.haversine_m(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))
    return steps.groupBy("taxi_id").agg(F.sum("_m").alias("metres"), F.count(F.lit(1)).alias("pings"))


def start_ingest_job(spark: SparkSession, raw: DataFrame, out: str, checkpoint: str, every: str | None = "60 seconds",
                     ttl: str = "24 HOURS", keep_days: int | None = 1, fold_every: int = 500) -> StreamingQuery:
    """Driver pings to all their readers, from one read of a micro-batch: positions table, events, driver
    index (newest position per taxi, by hash folder), odometer (metres per taxi and batch), quarantine.

    What the odometer measures from is the index as earlier batches left it, so a replayed batch gives
    the same rows. A taxi that was silent for ``ttl`` starts anew. Every ``fold_every`` batches the index
    is folded, and days of positions older than ``keep_days`` go as folders.
    """
    positions, index, way = (f"{out}/{n}" for n in ("positions", "driver_index", "odometer"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch, good = batch.persist(), None
        try:
            good, bad = ingest_pings(batch)
            good = good.withColumns({"bucket": common.bucket_of("taxi_id"), "day": F.date_format("event_time", "yyyy-MM-dd")}).persist()
            taxis = good.groupBy("taxi_id", "bucket").agg(F.min("event_time").alias("first_ping"))
            known = last_known(spark, index, batch_id, taxis, ttl)
            sinks.append_batch(good.drop("bucket"), positions, batch_id, ["city", "day"])
            sinks.append_batch(enriched_events(good), f"{out}/events", batch_id)
            sinks.append_batch(way_since(good, known), way, batch_id)
            newest = tables.latest_per_key(good.select("taxi_id", *LAST, "zone_id", "bucket"), ["taxi_id"], LAST)
            sinks.append_batch(newest, index, batch_id, ["bucket"])
            sinks.append_batch(bad, f"{out}/quarantine", batch_id)
        finally:
            batch.unpersist()
            if good is not None:
                good.unpersist()
        sinks.keep_house(spark, index, batch_id, fold_every, ["taxi_id", "bucket"], LAST, ["bucket"])
        if keep_days is not None and batch_id and batch_id % fold_every == 0:
            oldest = (datetime.now(timezone.utc) - timedelta(days=keep_days)).date().isoformat()
            sinks.drop_before(spark, positions, "day", oldest)

    return common.job(raw.writeStream.foreachBatch(write), checkpoint, every).start()


def reprocess_quarantine(quarantine: DataFrame, zones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Dead letters through the same split again: (now readable, still bad)."""
    return normalise_gps(quarantine.select("value", "record_time"), zones)
