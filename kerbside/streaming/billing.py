"""Bill completed trips exactly once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside import schemas as S
from kerbside import sinks
from kerbside.functions import events
from kerbside.operators import billing as billing_ops
from kerbside.session import broadcast_if_small
from kerbside.streaming import common
from kerbside.streaming.common import bucket_of

FOLD_EVERY = 500  # batches after which the folders of ids are folded
REQUIRED = [["trip_id", "tripId"], ["driver_id", "driverId"]]


def completions_from_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw records to (completions, quarantine). Either field spelling, defaults for absent fields."""
    return _split(events.check_events(raw, S.COMPLETION_EVENT, REQUIRED), raw.columns)


def _split(checked: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``completions_from_events`` on records checked before."""
    good, bad = events.split_checked(checked, columns)
    fields = events.completion_fields(F.col("event"))
    fields["completed_at"] = events.event_time(fields["completed_at"], F.col("record_time"))
    return good.select(*[c.alias(n) for n, c in fields.items()]), bad


def without_repeats(completions: DataFrame, within: str = "1 hour") -> DataFrame:
    """Drop copies of a trip that arrive within the watermark; older replays meet the anti join."""
    return completions.withWatermark("completed_at", within).dropDuplicatesWithinWatermark(["trip_id"])


def start_billing_job(spark: SparkSession, raw: DataFrame, out: str, checkpoint: str,
                      every: str | None = "60 seconds") -> StreamingQuery:
    """Per micro-batch: new records, their events, quarantine.

    A batch looks for trips billed by other batches only, so replaying it gives the same records. The ids
    of billed trips are kept beside the records in a fixed number of hash folders, of which a batch reads
    those that its own ids fall into.
    """
    table, ids = f"{out}/billing", f"{out}/billed_ids"

    def write(batch: DataFrame, batch_id: int) -> None:
        checked, rows = events.check_events(batch, S.COMPLETION_EVENT, REQUIRED).persist(), None  # parsed once
        try:
            good, bad = _split(checked, batch.columns)
            existing = billed_before(spark, ids, batch_id, good)
            rows = billing_ops.bill_trips(good, existing, F.col("completed_at")).persist()
            sinks.append_batch(rows, table, batch_id)
            # gathered by bucket, or every task writes a file into each of them
            billed = rows.select("trip_id", bucket_of("trip_id").alias("bucket")).hint("rebalance", "bucket")
            sinks.append_batch(billed, ids, batch_id, ["bucket"])
            sinks.keep_house(spark, ids, batch_id, FOLD_EVERY, ["trip_id", "bucket"], ["trip_id"], ["bucket"])
            sinks.append_batch(billing_ops.billing_events(rows), f"{out}/events", batch_id)
            sinks.append_batch(bad, f"{out}/quarantine", batch_id)
        finally:
            checked.unpersist()
            if rows is not None:
                rows.unpersist()

    return common.job(raw.writeStream.foreachBatch(write), checkpoint, every).start()


def billed_before(spark: SparkSession, ids: str, batch_id: int, batch: DataFrame) -> DataFrame | None:
    """Trips of this batch that other batches billed.

    The buckets of the batch's ids are named in a filter, so the others aren't read; the batch's
    ids then filter what is. At most ``common.BUCKETS`` numbers come to the driver.
    """
    try:
        stored = sinks.read_table(spark, ids)
    except AnalysisException:  # nothing written yet
        return None
    wanted = batch.select("trip_id").distinct()
    buckets = [r["bucket"] for r in batch.select(bucket_of("trip_id").alias("bucket")).distinct().collect()]
    stored = stored.where(F.col("bucket").isin(buckets) & (F.col("batch_id") != batch_id))
    return stored.join(broadcast_if_small(wanted, 1_000_000), "trip_id", "left_semi").select("trip_id")
