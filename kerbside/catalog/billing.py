"""Fares, billing records, payments, earnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.catalog.base import query
from kerbside.functions import events, scalars
from kerbside.operators import billing, tables
from kerbside.plans import bindings as B
from kerbside.session import spread
from kerbside.streaming import billing as stream_billing

_MONEY = "total_fare, commission, driver_payout"


@query(f"""SELECT trip_id, cast(5 AS decimal(8,2)) AS base_fare, cast(round(cast(3.5 AS decimal(3,2))*distance_km,2) AS decimal(8,2)) AS distance_fare,
  cast(round(cast(0.5 AS decimal(3,2))*duration_min,2) AS decimal(8,2)) AS time_fare, surge AS surge_multiplier, {_MONEY},
  cast(total_fare*100 AS bigint) AS minor FROM billing""", B.BILLING)
def fares(spark, d):
    return B.billing_hist(spark, d).select(
        "trip_id", "base_fare", "distance_fare", "time_fare", "surge_multiplier", "total_fare", "commission",
        "driver_payout", scalars.minor_units(F.col("total_fare")).alias("minor"))


def _earned(tz: str) -> str:
    return (f"""earned AS (SELECT *, coalesce(charged_at, created_at) AS earned_at,
      (coalesce(charged_at, created_at) AT TIME ZONE 'UTC' AT TIME ZONE '{tz}') AS local_at
      FROM billing WHERE status IN ('CHARGED','CALCULATED'))""")


_CITY_EARNED = _earned(S.CITY_TIME_ZONE)
_SUMS = """cast(coalesce(sum(total_fare),0) AS decimal(18,2)) AS revenue, cast(coalesce(sum(commission),0) AS decimal(18,2)) AS commission,
  cast(coalesce(sum(driver_payout),0) AS decimal(18,2)) AS driver_payouts, count(*) AS completed_trips, 'MAD' AS currency"""


@query(f"SELECT strftime(local_at, '%Y-%m-%d') AS date, {_SUMS} FROM earned GROUP BY 1", B.BILLING, _CITY_EARNED)
def billing_summary_by_day(spark, d):
    return billing.billing_summary(B.billing_hist(spark, d))


@query(f"SELECT '1997-06-15' AS date, {_SUMS} FROM earned WHERE strftime(local_at, '%Y-%m-%d') = '1997-06-15'", B.BILLING, _CITY_EARNED)
def billing_summary_of_day(spark, d):
    return billing.billing_summary(B.billing_hist(spark, d), day="1997-06-15")


@query(f"SELECT '1980-01-01' AS date, {_SUMS} FROM earned WHERE strftime(local_at, '%Y-%m-%d') = '1980-01-01'", B.BILLING, _CITY_EARNED)
def billing_summary_of_empty_day(spark, d):
    return billing.billing_summary(B.billing_hist(spark, d), day="1980-01-01")


def _since(unit: str) -> str:
    tz = S.CITY_TIME_ZONE
    return (f"earned_at >= (date_trunc('{unit}', TIMESTAMP '1998-07-16 12:00:00' AT TIME ZONE 'UTC' AT TIME ZONE '{tz}')"
            f" AT TIME ZONE '{tz}' AT TIME ZONE 'UTC')")


@query("SELECT driver_id, " + ", ".join(
    f"cast(coalesce(sum(driver_payout) FILTER ({_since(u)}),0) AS decimal(18,2)) AS {n}_earnings, count(*) FILTER ({_since(u)}) AS {n}_trips"
    for n, u in (("today", "day"), ("week", "week"), ("month", "month"))) + " FROM earned GROUP BY 1", B.BILLING, _CITY_EARNED)
def driver_earnings(spark, d):
    return billing.driver_earnings(B.billing_hist(spark, d), F.lit("1998-07-16 12:00:00").cast("timestamp"))


@query("SELECT driver_id, cast(sum(driver_payout) AS decimal(18,2)) AS payout, count(*) AS trips FROM earned GROUP BY 1 "
       "ORDER BY payout DESC, driver_id LIMIT 10", B.BILLING, _CITY_EARNED)
def top_drivers(spark, d):
    return billing.top_drivers(B.billing_hist(spark, d), 10)


@query("SELECT driver_id, cast(sum(driver_payout) AS decimal(18,2)) AS payout, count(*) AS trips FROM earned "
       "WHERE strftime(local_at, '%Y-%m-%d') = '1998-07-16' GROUP BY 1 ORDER BY payout DESC, driver_id LIMIT 5", B.BILLING, _CITY_EARNED)
def top_drivers_of_day(spark, d):
    return billing.top_drivers(B.billing_hist(spark, d), 5, day="1998-07-16")


@query("""SELECT cast(trip_id AS varchar) AS trip_id, total_fare, commission, driver_payout AS payout, distance_km, duration_min,
  status, coalesce(charged_at, created_at) AS charged_at FROM billing WHERE driver_id = 7 ORDER BY created_at DESC, trip_id LIMIT 20 OFFSET 20""",
       B.BILLING)
def trip_earnings_page(spark, d):
    """Second page of a driver's earnings, newest first."""
    return billing.trip_earnings(B.billing_hist(spark, d), 7, 1, 20)[0]


@query("SELECT count(*) AS total_elements, cast(ceil(count(*)/20.0) AS bigint) AS total_pages FROM billing WHERE driver_id = 7", B.BILLING)
def trip_earnings_totals(spark, d):
    return billing.trip_earnings(B.billing_hist(spark, d), 7, 1, 20)[1]


@query("SELECT trip_id, driver_id, created_at, total_fare FROM billing ORDER BY driver_id DESC, created_at, trip_id LIMIT 40 OFFSET 2400", B.BILLING)
def deep_page(spark, d):
    """Page 60 of all records: driver, time and id are cut into counted ranges until 64 rows are left to sort."""
    return tables.deep_page(B.billing_hist(spark, d), [("driver_id", True), ("created_at", False), ("trip_id", False)], 60, 40, most=64).select(
        "trip_id", "driver_id", "created_at", "total_fare")


@query("SELECT trip_id, driver_id, created_at, total_fare FROM billing WHERE created_at < TIMESTAMP '1997-01-01' "
       "OR (created_at = TIMESTAMP '1997-01-01' AND trip_id > 500) ORDER BY created_at DESC, trip_id LIMIT 40", B.BILLING)
def page_after(spark, d):
    """The records after a given one, newest first."""
    return tables.page_after(B.billing_hist(spark, d), [("created_at", True), ("trip_id", False)], ("1997-01-01 00:00:00", 500), 40).select(
        "trip_id", "driver_id", "created_at", "total_fare")


@query("SELECT trip_id, driver_id, created_at, total_fare FROM billing WHERE client_id = 17 ORDER BY created_at DESC, trip_id", B.BILLING)
def client_history(spark, d):
    b = B.billing_hist(spark, d).where("client_id = 17")
    return tables.newest_first(b, "created_at", "trip_id").select("trip_id", "driver_id", "created_at", "total_fare")


@query(f"SELECT trip_id, driver_id, {_MONEY}, status FROM billing WHERE trip_id = (SELECT max(trip_id) FROM billing)", B.BILLING)
def billing_by_trip(spark, d):
    """Point lookup by trip id."""
    b = B.billing_hist(spark, d)
    return b.where(F.col("trip_id") == b.agg(F.max("trip_id")).scalar()).select(
        "trip_id", "driver_id", "total_fare", "commission", "driver_payout", "status")


@query("SELECT 'driver' AS viewer, trip_id, driver_id FROM billing WHERE driver_id = 5 OR client_id = 5 UNION ALL "
       "SELECT 'admin', trip_id, driver_id FROM billing", B.BILLING)
def owner_rows(spark, d):
    """A user sees own rows as driver or client, an administrator all."""
    b = B.billing_hist(spark, d)
    mine = tables.owner_rows(b, "5", ["driver_id", "client_id"], False)
    every = tables.owner_rows(b, "5", ["driver_id", "client_id"], True)
    return mine.select(F.lit("driver").alias("viewer"), "trip_id", "driver_id").unionByName(
        every.select(F.lit("admin").alias("viewer"), "trip_id", "driver_id"))


@query("SELECT trip_id FROM billing WHERE trip_id NOT IN (SELECT trip_id FROM billing WHERE trip_id % 3 = 0)", B.BILLING)
def skip_billed(spark, d):
    b = B.billing_hist(spark, d).select("trip_id")
    return tables.skip_existing(b, b.where("trip_id % 3 = 0"), "trip_id")


@query("""SELECT trip_id, cast(b.client_id AS varchar) AS client_id, concat('pay_', c.c_custkey) AS payment_customer_id,
  cast(total_fare*100 AS bigint) AS amount_minor FROM billing b JOIN customer c ON b.client_id = c.c_custkey
  WHERE status = 'CALCULATED' AND c.c_custkey % 3 <> 0""", B.BILLING)
def chargeable(spark, d):
    """Every third customer has no payment id."""
    k = F.col("c_custkey")
    customers = B.table(spark, d, "customer").select(
        k.cast("string").alias("client_id"),
        F.when(k % 3 != 0, F.concat(F.lit("pay_"), k.cast("string"))).otherwise(F.lit(" ")).alias("payment_customer_id"))
    b = B.billing_hist(spark, d).withColumn("client_id", F.col("client_id").cast("string"))
    return billing.chargeable(b, customers)


@query("""SELECT b.trip_id, coalesce(f.st, b.status) AS status, coalesce(b.charged_at, f.paid) AS charged_at, f.pid AS payment_id
  FROM billing b LEFT JOIN (SELECT trip_id, arg_max(st, happened) AS st, min(happened) FILTER (st='CHARGED') AS paid,
      arg_max(pid, happened) FILTER (st='CHARGED') AS pid FROM (
    SELECT trip_id, 'CHARGED' AS st, created_at + INTERVAL 2 HOUR AS happened, concat('pi_', trip_id) AS pid FROM billing WHERE trip_id%3=0
    UNION ALL SELECT trip_id, 'REFUNDED', created_at + INTERVAL 5 HOUR, NULL FROM billing WHERE trip_id%9=0
    UNION ALL SELECT trip_id, 'REFUNDED', created_at + INTERVAL 1 HOUR, NULL FROM billing WHERE trip_id%6=0) GROUP BY 1) f USING (trip_id)""",
       B.BILLING)
def payments_applied(spark, d):
    """Successes, refunds before and after, events without trip, for another trip and of other types."""
    b = B.billing_hist(spark, d)

    def event(cond, kind, hours, pid=None, trip=F.col("trip_id")):
        return b.where(cond).select(
            trip.alias("trip_id"), F.lit(kind).alias("event_type"), (F.lit(None).cast("string") if pid is None else pid).alias("payment_id"),
            (F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS")).alias("occurred_at"), F.lit(0).alias("seq"))

    pid = F.concat(F.lit("pi_"), F.col("trip_id").cast("string"))
    payments = event("trip_id % 3 = 0", "payment_intent.succeeded", 2, pid)
    for extra in (event("trip_id % 9 = 0", "charge.refunded", 5), event("trip_id % 6 = 0", "charge.refunded", 1),
                  event("trip_id % 5 = 0", "customer.updated", 9),
                  event("trip_id % 4 = 0", "payment_intent.succeeded", 9, pid, F.lit(None).cast("long")),
                  event("trip_id % 4 = 0", "payment_intent.succeeded", 9, pid, -F.col("trip_id"))):
        payments = payments.unionByName(extra)
    return billing.apply_payments(b, payments).select("trip_id", "status", "charged_at", "payment_id")


@query("""SELECT b.trip_id, CASE WHEN t.n IS NULL THEN b.charge_attempts ELSE least(b.charge_attempts + t.n,
      CASE WHEN t.ok AND b.charge_attempts + t.n <= greatest(5, b.charge_attempts+1) THEN 99 ELSE greatest(5, b.charge_attempts+1) END) END AS charge_attempts,
    CASE WHEN t.n IS NULL THEN b.status WHEN t.ok AND b.charge_attempts + t.n <= greatest(5, b.charge_attempts+1) THEN 'CHARGED'
      WHEN b.charge_attempts + t.n >= 5 THEN 'CHARGE_FAILED' ELSE 'CALCULATED' END AS status,
    CASE WHEN t.n IS NULL OR (t.ok AND b.charge_attempts + t.n <= greatest(5, b.charge_attempts+1)) THEN NULL ELSE 'declined' END AS last_charge_error
  FROM billing b LEFT JOIN (SELECT trip_id, cast(trip_id%4+1 AS int) AS n, trip_id%3=0 AS ok FROM billing WHERE status='CALCULATED' AND trip_id%5<>0) t
  USING (trip_id)""", B.BILLING)
def charge_attempts_applied(spark, d):
    """One to four attempts per record, the last one successful for every third."""
    b = B.billing_hist(spark, d)
    n = (F.col("trip_id") % 4 + 1).cast("int")
    attempts = b.where("trip_id % 5 <> 0").select(
        "trip_id", "created_at", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("i")).select(
        "trip_id", (F.col("created_at") + F.make_dt_interval(hours=F.col("i"))).alias("attempted_at"),
        F.when((F.col("i") < F.col("n")) | (F.col("trip_id") % 3 != 0), F.lit("declined")).alias("error"))
    return billing.apply_charge_attempts(b, attempts).select("trip_id", "charge_attempts", "status", "last_charge_error")


@query("SELECT trip_id, charge_attempts FROM billing WHERE status='CALCULATED' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 5 MINUTE "
       "AND charge_attempts < 5", B.BILLING)
def reconciliation_candidates(spark, d):
    return billing.reconciliation_candidates(B.billing_hist(spark, d), F.lit("1998-01-01").cast("timestamp")).select(
        "trip_id", "charge_attempts")


# --- completions as JSON, both spellings, with gaps, duplicates and earlier records --------------


def completion_events(spark, d):
    """Raw completion messages; the spelling and the missing fields depend on the trip."""
    t = spread(B.trips_hist(spark, d))
    k = F.col("trip_id")
    sid = k.cast("string")
    km, minutes = F.col("trip_distance_miles"), (F.col("n_points") + F.col("stride")).cast("double")
    at = F.unix_millis("pickup_ts")
    driver = F.col("taxi_id")
    plain = F.to_json(F.struct(
        sid.alias("trip_id"), driver.alias("driver_id"), F.concat(F.lit("c"), driver).alias("client_id"),
        km.alias("distance_km"), minutes.alias("duration_min"), F.lit(1.5).alias("surge"), at.alias("completed_at")))
    other = F.to_json(F.struct(
        sid.alias("tripId"), driver.alias("driverId"), F.concat(F.lit("c"), driver).alias("rider_id"), km.alias("distanceKm"),
        minutes.alias("durationMin"), F.lit(1.25).alias("surge_multiplier"), at.alias("completed_at")))
    bare = F.to_json(F.struct(sid.alias("trip_id"), driver.alias("driver_id"), at.alias("completed_at")))
    broken = F.when(k % 2 == 0, F.lit("not json")).otherwise(F.lit("{}"))
    h = (k + F.floor(k / 10)) % 10
    value = F.when(h < 4, plain).when(h < 7, other).when(h < 9, bare).otherwise(broken)
    return t.select(value.alias("value"), F.col("pickup_ts").alias("record_time"))


COMPLETIONS = """completions AS (SELECT cast(trip_id AS varchar) AS trip_id, taxi_id AS driver_id, pickup_ts AS completed_at,
  CASE WHEN (trip_id+trip_id//10)%10 < 7 THEN concat('c', taxi_id) ELSE 'unknown' END AS client_id,
  CASE WHEN (trip_id+trip_id//10)%10 < 7 THEN trip_distance_miles ELSE 5.0e0 END AS distance_km,
  CASE WHEN (trip_id+trip_id//10)%10 < 7 THEN cast(n_points+stride AS double) ELSE 10.0e0 END AS duration_min,
  CASE WHEN (trip_id+trip_id//10)%10 < 4 THEN 1.5e0 WHEN (trip_id+trip_id//10)%10 < 7 THEN 1.25e0 ELSE 1.0e0 END AS surge
  FROM trips_hist WHERE (trip_id+trip_id//10)%10 < 9)"""


@query("SELECT trip_id, driver_id, client_id, distance_km, duration_min, surge, completed_at FROM completions", B.TRIPS, COMPLETIONS)
def completion_alias_fallback(spark, d):
    return stream_billing.completions_from_events(completion_events(spark, d))[0]


BILLED = """billed AS (SELECT trip_id, driver_id, client_id, cast(distance_km AS decimal(8,3)) AS distance_km,
  cast(duration_min AS decimal(6,2)) AS duration_min,
  cast(round((5 + cast(3.5 AS decimal(3,2))*cast(distance_km AS decimal(8,3)) + cast(0.5 AS decimal(3,2))*cast(duration_min AS decimal(6,2)))
    * cast(surge AS decimal(3,2)), 2) AS decimal(8,2)) AS total_fare, 'CALCULATED' AS status, completed_at AS created_at FROM completions
  QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY completed_at, driver_id) = 1)"""


@query("SELECT trip_id, driver_id, client_id, distance_km, duration_min, total_fare, status, created_at FROM billed "
       "WHERE cast(trip_id AS bigint) % 6 <> 0", B.TRIPS, COMPLETIONS, BILLED)
def trips_billed(spark, d):
    """Parse, dedupe, skip what is billed, fare; two messages in three name a new trip."""
    good, _ = stream_billing.completions_from_events(completion_events(spark, d))
    existing = good.where(F.col("trip_id").cast("long") % 6 == 0).select("trip_id").distinct()
    return billing.bill_trips(good, existing, F.col("completed_at")).select(
        "trip_id", "driver_id", "client_id", "distance_km", "duration_min", "total_fare", "status", "created_at")


@query("SELECT b.trip_id AS key, cast(json_extract_string(to_json({'f': total_fare}), '$.f') AS decimal(8,2)) AS total_fare "
       "FROM billed b", B.TRIPS, COMPLETIONS, BILLED)
def billing_event_messages(spark, d):
    """JSON message per new record, keyed by trip."""
    good, _ = stream_billing.completions_from_events(completion_events(spark, d))
    out = billing.billing_events(billing.bill_trips(good, None, F.col("completed_at")))
    return out.select("key", F.from_json("value", "total_fare decimal(8,2)")["total_fare"].alias("total_fare"))


@query("""SELECT value, error, count(*) AS n FROM (SELECT CASE WHEN trip_id%2=0 THEN 'not json' ELSE '{}' END AS value,
  CASE WHEN trip_id%2=0 THEN 'unreadable record' ELSE 'missing: trip_id|tripId, driver_id|driverId' END AS error
  FROM trips_hist WHERE (trip_id+trip_id//10)%10=9) GROUP BY 1, 2""", B.TRIPS)
def quarantine_split(spark, d):
    _, bad = events.split_valid(completion_events(spark, d), S.COMPLETION_EVENT, stream_billing.REQUIRED)
    return bad.groupBy("value", "error").agg(F.count(F.lit(1)).alias("n"))
