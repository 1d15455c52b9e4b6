"""Windowed demand over the position and request streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside import schemas as S
from kerbside import sinks
from kerbside.functions import events
from kerbside.operators import demand as demand_ops
from kerbside.operators import zones as zone_ops
from kerbside.streaming import common

LATENESS = "180 seconds"


def requests_from_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw records to (requests with requested_at as a time, quarantine)."""
    good, bad = events.split_valid(raw, S.TRIP_REQUEST_EVENT, [["trip_id"]])
    fields = events.request_fields(F.col("event"))
    fields["requested_at"] = events.event_time(fields["requested_at"], F.col("record_time"))
    return good.select(*[c.alias(n) for n, c in fields.items()]), bad


def demand_stream(positions: DataFrame, requests: DataFrame, lateness: str = LATENESS,
                  width: str = "30 seconds") -> DataFrame:
    """Demand per zone and window, appended once the watermark passes the window's end.

    positions: event_time, zone_id, taxi_id; requests: requested_at, origin_zone. Each input has its
    own watermark; common.configure decides how they combine. Later records are dropped, empty
    windows give no row.
    """
    gps = positions.withColumnRenamed("event_time", "ts").withWatermark("ts", lateness)
    trips = requests.withWatermark("requested_at", lateness)
    return demand_ops.aggregate_demand(demand_ops.demand_events(gps, trips), width)


def start_demand_job(demand: DataFrame, zones: DataFrame, out: str, checkpoint: str,
                     every: str | None = "60 seconds") -> StreamingQuery:
    """Closed windows to the demand table and as events; zone names come from the dimension."""
    names = zone_ops.zone_names(zones)

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.join(names, "zone_id", "left").withColumn(
            "zone_name", F.coalesce("zone_name", F.lit("Unknown"))).persist()
        try:
            sinks.append_batch(named, f"{out}/demand_zones", batch_id, ["city"])
            sinks.append_batch(events.to_event(named), f"{out}/events", batch_id)
        finally:
            named.unpersist()

    return common.job(demand.writeStream.outputMode("append").foreachBatch(write), checkpoint, every).start()
