"""Billing records, payments, earnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import events, scalars
from kerbside.operators import tables

EARNED = ("CHARGED", "CALCULATED")


def earned(billing: DataFrame) -> DataFrame:
    """Records that count as income, with the time they count for."""
    return billing.where(F.col("status").isin(*EARNED)).withColumn(
        "earned_at", F.coalesce("charged_at", "created_at"))


def bill_trips(completions: DataFrame, existing: DataFrame | None, billed_at: Column) -> DataFrame:
    """Completion events to new billing records; a trip is billed once, whatever is replayed.

    completions: trip_id, driver_id, client_id, distance_km, duration_min, surge, completed_at.
    Among copies of one trip the earliest completion counts.
    """
    rows = tables.first_per_key(
        completions.where(F.col("trip_id").isNotNull()), ["trip_id"],
        ["completed_at", "driver_id", "client_id", "distance_km", "duration_min", "surge"])
    if existing is not None:
        rows = tables.skip_existing(rows, existing, "trip_id")
    client = F.when(F.trim("client_id") != "", F.col("client_id"))
    money = scalars.fare(F.col("distance_km"), F.col("duration_min"), F.col("surge"))
    return rows.select(
        "trip_id", "driver_id", F.coalesce(client, F.lit("unknown")).alias("client_id"),
        F.col("distance_km").cast("decimal(8,3)").alias("distance_km"),
        F.col("duration_min").cast("decimal(6,2)").alias("duration_min"),
        *[c.alias(n) for n, c in money.items()],
        F.lit(S.CURRENCY).alias("currency"), F.lit("CALCULATED").alias("status"),
        F.lit(0).alias("charge_attempts"), F.lit(None).cast("string").alias("last_charge_error"),
        billed_at.alias("created_at"), F.lit(None).cast("timestamp").alias("charged_at"),
        F.lit(None).cast("timestamp").alias("last_attempted_at"),
    )


def billing_events(records: DataFrame) -> DataFrame:
    """Message per new record, keyed by trip."""
    return events.to_event(records, ["trip_id", "total_fare", "driver_payout", "currency", "status"], key="trip_id")


def billing_summary(billing: DataFrame, tz: str = S.CITY_TIME_ZONE, day: str | None = None) -> DataFrame:
    """Revenue, commission, payouts and trips per local day; one day gives one row, zeros if empty."""
    rows = earned(billing)
    sums = [
        F.coalesce(F.sum("total_fare"), F.lit(0)).cast("decimal(18,2)").alias("revenue"),
        F.coalesce(F.sum("commission"), F.lit(0)).cast("decimal(18,2)").alias("commission"),
        F.coalesce(F.sum("driver_payout"), F.lit(0)).cast("decimal(18,2)").alias("driver_payouts"),
        F.count(F.lit(1)).alias("completed_trips"),
    ]
    if day is None:
        out = rows.groupBy(scalars.date_bucket(F.col("earned_at"), tz).alias("date")).agg(*sums)
    else:
        start, end = scalars.local_day_bounds(day, tz)
        inside = rows.where((F.col("earned_at") >= start) & (F.col("earned_at") < end))
        out = inside.agg(*sums).select(F.lit(day).alias("date"), "*")
    return out.withColumn("currency", F.lit(S.CURRENCY))


def driver_earnings(billing: DataFrame, as_of: Column, tz: str = S.CITY_TIME_ZONE) -> DataFrame:
    """Payout and trips since the start of the local day, week (Monday) and month, in one pass."""
    aggs = []
    for label, unit in (("today", "day"), ("week", "week"), ("month", "month")):
        hit = F.col("earned_at") >= scalars.local_period_start(as_of, tz, unit)
        aggs.append(F.coalesce(F.sum(F.when(hit, F.col("driver_payout"))), F.lit(0)).cast("decimal(18,2)")
                    .alias(f"{label}_earnings"))
        aggs.append(F.count(F.when(hit, 1)).alias(f"{label}_trips"))
    return earned(billing).groupBy("driver_id").agg(*aggs)


def top_drivers(billing: DataFrame, limit: int = 10, tz: str = S.CITY_TIME_ZONE,
                day: str | None = None) -> DataFrame:
    """Drivers by payout of a local day (or of all days); a top-k, so the sort keeps k rows only."""
    rows = earned(billing)
    if day is not None:
        start, end = scalars.local_day_bounds(day, tz)
        rows = rows.where((F.col("earned_at") >= start) & (F.col("earned_at") < end))
    return rows.groupBy("driver_id").agg(
        F.sum("driver_payout").cast("decimal(18,2)").alias("payout"), F.count(F.lit(1)).alias("trips"),
    ).orderBy(F.col("payout").desc(), "driver_id").limit(limit)


def trip_earnings(billing: DataFrame, driver_id, page_no: int = 0, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """Page of a driver's records, newest first, with totals."""
    mine = billing.where(F.col("driver_id") == driver_id)
    rows, totals = tables.page(mine, [F.col("created_at").desc(), F.col("trip_id")], page_no, size)
    money = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    return rows.select(
        F.coalesce(F.col("trip_id").cast("string"), F.lit("")).alias("trip_id"),
        money("total_fare", "decimal(8,2)").alias("total_fare"), money("commission", "decimal(8,2)").alias("commission"),
        money("driver_payout", "decimal(8,2)").alias("payout"), money("distance_km", "decimal(8,3)").alias("distance_km"),
        money("duration_min", "decimal(6,2)").alias("duration_min"),
        F.coalesce("status", F.lit("")).alias("status"), F.coalesce("charged_at", "created_at").alias("charged_at"),
    ), totals


def chargeable(billing: DataFrame, customers: DataFrame) -> DataFrame:
    """Records waiting for a charge whose client has a payment customer, with the amount in hundredths.

    customers: client_id, payment_customer_id.
    """
    client = F.col("client_id").cast("string")
    waiting = billing.where((F.col("status") == "CALCULATED") & (F.trim(client) != "") & (client != "unknown"))
    usable = customers.where(F.trim("payment_customer_id") != "")
    return waiting.join(usable, "client_id").select(
        "trip_id", "client_id", "payment_customer_id",
        scalars.minor_units(F.col("total_fare")).alias("amount_minor"))


def apply_payments(billing: DataFrame, payments: DataFrame) -> DataFrame:
    """Fold payment events into the records.

    payments: trip_id, event_type, payment_id, occurred_at, seq. ``payment_intent.succeeded`` gives
    CHARGED and sets charged_at once; ``charge.refunded`` gives REFUNDED; the last event decides.
    Events without trip or without record change nothing.
    """
    ok = F.col("event_type") == "payment_intent.succeeded"
    folded = (
        payments.where(F.col("event_type").isin("payment_intent.succeeded", "charge.refunded")
                       & F.col("trip_id").isNotNull())
        .groupBy("trip_id").agg(
            F.max_by(F.when(ok, "CHARGED").otherwise("REFUNDED"), F.struct("occurred_at", "seq")).alias("_status"),
            F.min(F.when(ok, F.col("occurred_at"))).alias("_paid"),
            F.max_by("payment_id", F.when(ok, F.struct("occurred_at", "seq"))).alias("payment_id"),
        )
    )
    return billing.join(folded, "trip_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "charged_at": F.coalesce("charged_at", "_paid"),
    }).drop("_status", "_paid")


def apply_charge_attempts(billing: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fold charge attempts into the records that are still CALCULATED.

    attempts: trip_id, attempted_at, error (null = success). Attempts after a success or after the
    fifth failure do not count, as the record has left CALCULATED by then. Success clears the error.
    At equal times failures come first; attempts without a time do not count.

    One scan and one shuffle of the attempts: a record can use no more than the first five of its
    trip, which Spark prunes before the shuffle, and folds them as an array.
    """
    order = [F.col("attempted_at"), F.col("error").isNull(), F.col("error")]
    nth = F.row_number().over(Window.partitionBy("trip_id").orderBy(*order))
    tried = (
        attempts.where(F.col("attempted_at").isNotNull()).withColumn("_nth", nth)
        .where(F.col("_nth") <= S.MAX_CHARGE_ATTEMPTS)
        .groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("_nth", "attempted_at", "error"))).alias("_tried"))
    )
    types = {f.name: f.dataType for f in billing.schema}

    def state(n: Column, status: Column, error: Column, last: Column, charged: Column) -> Column:
        return F.struct(
            n.cast(types["charge_attempts"]).alias("charge_attempts"), status.cast(types["status"]).alias("status"),
            error.cast(types["last_charge_error"]).alias("last_charge_error"),
            last.cast(types["last_attempted_at"]).alias("last_attempted_at"), charged.cast(types["charged_at"]).alias("charged_at"))

    def attempt(record: Column, a: Column) -> Column:
        n, ok = record["charge_attempts"] + 1, a["error"].isNull()
        status = F.when(ok, "CHARGED").when(n >= S.MAX_CHARGE_ATTEMPTS, "CHARGE_FAILED").otherwise("CALCULATED")
        charged = F.when(ok, a["attempted_at"]).otherwise(record["charged_at"])
        return F.when(record["status"] == "CALCULATED", state(n, status, a["error"], a["attempted_at"], charged)).otherwise(record)

    start = state(F.coalesce("charge_attempts", F.lit(0)), F.col("status"), F.col("last_charge_error"),
                  F.col("last_attempted_at"), F.col("charged_at"))
    open_record = (F.col("status") == "CALCULATED") & F.col("_tried").isNotNull()
    folded = billing.join(tried, "trip_id", "left").withColumn(
        "_end", F.when(open_record, F.aggregate("_tried", start, attempt)))
    names = ["charge_attempts", "status", "last_charge_error", "last_attempted_at", "charged_at"]
    return folded.withColumns({
        c: F.when(F.col("_end").isNotNull(), F.col("_end")[c]).otherwise(F.col(c)) for c in names}).drop("_tried", "_end")


def reconciliation_candidates(billing: DataFrame, as_of: Column) -> DataFrame:
    """Uncharged records older than five minutes with attempts left."""
    return billing.where(
        (F.col("status") == "CALCULATED") & (F.col("created_at") < as_of - F.expr("INTERVAL 5 MINUTES"))
        & (F.col("charge_attempts") < S.MAX_CHARGE_ATTEMPTS))
