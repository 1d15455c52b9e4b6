from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kerbside.functions import events
from kerbside.operators import billing, trips
from kerbside.streaming import billing as stream_billing
from kerbside.streaming.lifecycle import _FIELDS, OUTPUT, Event, step

T0 = datetime(2024, 1, 1, 8)


@pytest.fixture
def completions(spark):
    rows = [("t1", "d1", "c1", 5.0, 10.0, 1.0, T0), ("t1", "d1", "c1", 5.0, 10.0, 1.0, T0 + timedelta(hours=1)),
            ("t2", "d1", " ", 0.5, 2.0, 1.0, T0), ("t3", "d2", None, 25.0, 45.0, 1.8, T0)]
    return spark.createDataFrame(rows, "trip_id string, driver_id string, client_id string, distance_km double, duration_min double, "
                                       "surge double, completed_at timestamp")


def test_billing_twice_is_billing_once(completions):
    first = billing.bill_trips(completions, None, F.col("completed_at"))
    rows = {r["trip_id"]: r for r in first.collect()}
    assert rows["t1"]["total_fare"] == Decimal("27.50") and rows["t1"]["created_at"] == T0
    assert rows["t2"]["client_id"] == rows["t3"]["client_id"] == "unknown"
    assert rows["t3"]["driver_payout"] == Decimal("175.95")
    assert billing.bill_trips(completions, first, F.col("completed_at")).count() == 0


def record(spark, **more):
    base = {"trip_id": "t", "status": "CALCULATED", "charge_attempts": 0, "last_charge_error": None, "last_attempted_at": None,
            "charged_at": None, **more}
    return spark.createDataFrame([tuple(base.values())], "trip_id string, status string, charge_attempts int, last_charge_error string, "
                                                        "last_attempted_at timestamp, charged_at timestamp")


def attempts(spark, *errors):
    return spark.createDataFrame([("t", T0 + timedelta(minutes=i), e) for i, e in enumerate(errors)],
                                 "trip_id string, attempted_at timestamp, error string")


@pytest.mark.parametrize(("before", "errors", "status", "after", "error"), [
    (4, ["no"], "CHARGE_FAILED", 5, "no"), (0, ["no"], "CALCULATED", 1, "no"), (0, ["no", None], "CHARGED", 2, None),
    (3, ["a", "b", None], "CHARGE_FAILED", 5, "b"), (0, [None, "late"], "CHARGED", 1, None), (0, ["x"] * 9, "CHARGE_FAILED", 5, "x")])
def test_charge_attempts(spark, before, errors, status, after, error):
    r = billing.apply_charge_attempts(record(spark, charge_attempts=before), attempts(spark, *errors)).first()
    assert (r["status"], r["charge_attempts"], r["last_charge_error"]) == (status, after, error)
    assert (r["charged_at"] is not None) == (status == "CHARGED")


def test_settled_records_are_not_charged_again(spark):
    r = billing.apply_charge_attempts(record(spark, status="REFUNDED"), attempts(spark, None)).first()
    assert (r["status"], r["charge_attempts"]) == ("REFUNDED", 0)


def test_charge_attempts_at_one_time_and_without_a_time(spark):
    at = datetime(2024, 1, 1)
    tried = spark.createDataFrame([("t", at, None), ("t", at, "declined"), ("t", None, None), (None, at, None)],
                                  "trip_id string, attempted_at timestamp, error string")
    r = billing.apply_charge_attempts(record(spark), tried).first()
    assert (r["status"], r["charge_attempts"], r["last_charge_error"], r["charged_at"]) == ("CHARGED", 2, None, at)


def test_charge_attempts_are_read_and_shuffled_once(spark, tmp_path):
    many = spark.range(2000).select(F.col("id").cast("string").alias("trip_id"), F.lit(datetime(2024, 1, 1)).alias("attempted_at"),
                                    F.lit("declined").alias("error"))
    many.write.parquet(str(tmp_path / "a"))
    got = billing.apply_charge_attempts(record(spark), spark.read.parquet(str(tmp_path / "a")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") <= 2 and "WindowGroupLimit" in plan


def test_alias_fields_and_bad_records(spark):
    good = ['{"tripId":"a","driverId":"d","distanceKm":2.5,"extra":1}', '{"trip_id":"b","driver_id":"d","rider_id":"r","surge_multiplier":2}']
    bad = ["not json", "{}", '{"trip_id":"c"}', '{"trip_id":"c","driver_id":"d","distance_km":"far"}', None, "x" * 500]
    raw = spark.createDataFrame([(v, T0) for v in good + bad], "value string, record_time timestamp")
    ok, quarantine = stream_billing.completions_from_events(raw)
    rows = {r["trip_id"]: r for r in ok.collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["distance_km"], rows["a"]["duration_min"], rows["a"]["client_id"], rows["a"]["completed_at"]) == (2.5, 10.0, "unknown", T0)
    assert (rows["b"]["client_id"], rows["b"]["surge"]) == ("r", 2.0)
    q = quarantine.collect()
    assert len(q) == len(bad) and all(r["error"] for r in q)
    assert max(len(r["raw"]) for r in q if r["raw"]) == 200 and max(len(r["value"]) for r in q if r["value"]) == 500


def test_event_round_trip(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, n int, z string")
    row = events.to_event(df, key="k").first()
    assert row["key"] == "a" and row["value"] == '{"k":"a","n":1}'


# --- life cycle --------------------------------------------------------------------------------

RIDE = [("assign", "t1"), ("ping", None), ("accept", None), ("start", None), ("ping", None), ("complete", None)]


def life(spark, kinds, lats=None):
    rows = [("d1", T0 + timedelta(minutes=i), i, k, t, "c1" if t else None, 33.5735 + 0.01 * (lats or range(99))[i], -7.5895)
            for i, (k, t) in enumerate(kinds)]
    return spark.createDataFrame(rows, "driver_id string, ts timestamp, seq long, kind string, trip_id string, client_id string, lat double, lon double")


def state_machine(kinds, lats=None):
    s = dict.fromkeys(_FIELDS)
    out = []
    for i, (k, t) in enumerate(kinds):
        at = (T0 + timedelta(minutes=i)).replace(tzinfo=timezone.utc)
        e = Event(int(at.timestamp()) * 1_000_000, i, k, t, "c1" if t else None, 33.5735 + 0.01 * (lats or range(99))[i], -7.5895)
        out += step("d1", s, e)
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in out]


CASES = [
    RIDE, [("start", None), ("complete", None)], [("accept", None)], [("assign", "t1"), ("reject", None), ("accept", None)],
    [("assign", "t1"), ("assign", "t2"), ("accept", None), ("complete", None)],
    [("assign", "t1"), ("accept", None), ("assign", "t2"), ("accept", None), ("start", None), ("ping", None), ("ping", None), ("complete", None), ("complete", None)],
    [("assign", "t1"), ("accept", None), ("start", None), ("ping", None), ("ping", None), ("start", None), ("ping", None), ("complete", None)],
]


@pytest.mark.parametrize("kinds", CASES)
def test_batch_and_stream_rules_agree(spark, kinds):
    statuses, done = trips.trip_lifecycle(life(spark, kinds))
    want = state_machine(kinds)
    assert sorted((r["seq"], r["trip_id"], r["status"]) for r in statuses.collect()) == [(w["seq"], w["trip_id"], w["status"]) for w in want]
    finished = [w for w in want if w["status"] == "COMPLETED"]
    rows = sorted(done.collect(), key=lambda r: r["completed_at"])
    assert [(r["trip_id"], r["client_id"], r["duration_min"]) for r in rows] == [(w["trip_id"], w["client_id"], w["duration_min"]) for w in finished]
    assert [r["distance_km"] for r in rows] == pytest.approx([w["distance_km"] for w in finished])


def test_ride_distance_example():
    done = state_machine(RIDE, lats=[0, 0, 0, 0, 1, 1])[-1]
    assert done["status"] == "COMPLETED" and 1.0 < done["distance_km"] < 1.3 and done["surge"] == 1.0
    assert done["duration_min"] == 2.0


def test_nothing_without_an_active_trip():
    assert state_machine([("start", None), ("complete", None), ("accept", None), ("reject", None)]) == []


def test_trip_without_movement_gets_the_default(spark):
    kinds = [("assign", "t1"), ("accept", None), ("complete", None)]
    assert [(w["distance_km"], w["duration_min"]) for w in state_machine(kinds) if w["status"] == "COMPLETED"] == [(5.0, 5.0)]


def test_status_classes_and_wait(spark):
    rows = [("2024-01-01", s, e) for s, e in [("matched", 100), ("ACCEPTED", 0), ("COMPLETED", 51), ("odd", 9), (None, 9), ("REJECTED", 7)]]
    r = trips.trip_stats(spark.createDataFrame(rows, "date_bucket string, status string, eta_seconds int")).first()
    assert (r["total_trips"], r["requested"], r["matched"], r["in_progress"], r["completed"], r["cancelled"], r["avg_wait_seconds"]) == (6, 2, 2, 0, 1, 1, 75)


def test_admin_list_puts_uncached_first_and_stored_rows_win(spark):
    schema = "date_bucket string, created_at timestamp, trip_id string, status string, taxi_id string, rider_id string, eta_seconds int, origin_zone int, dest_zone int"
    stored = spark.createDataFrame([("2024-01-01", T0, "a", "MATCHED", None, "r", None, 1, None)], schema)
    cached = spark.createDataFrame([("2024-01-01", T0 - timedelta(hours=9), "b", "REQUESTED", None, "r", None, 1, 2),
                                    ("2024-01-01", T0, "a", "REQUESTED", None, "r", None, 1, 2)], schema)
    rows = trips.admin_trips(stored, "2024-01-01", recent=cached).collect()
    assert [(r["trip_id"], r["status"], r["eta_seconds"], r["dest_zone"]) for r in rows] == [("b", "REQUESTED", 0, 2), ("a", "MATCHED", 0, 1)]
