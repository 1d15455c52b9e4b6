import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside import sinks
from kerbside.functions import events
from kerbside.plans import bindings as B
from kerbside.streaming import archive, billing, common, demand, gps, lifecycle, matching

T0 = 1_704_096_000_000  # 2024-01-01 08:00 UTC


@pytest.fixture
def topic(spark, tmp_path):
    """put(lines) adds one file of messages; the file's time grows with every call."""
    common.configure(spark)
    folders = {}

    def put(name, *messages):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        n = folders[name] = folders.get(name, 0) + 1
        target = folder / f"{n:03d}.json"
        lines = [m if isinstance(m, str) else json.dumps(m) for m in messages]
        (tmp_path / f"{name}{n}.tmp").write_text("\n".join(lines) + "\n")
        os.replace(tmp_path / f"{name}{n}.tmp", target)
        os.utime(target, (1_700_000_000 + n * 10, 1_700_000_000 + n * 10))
        return str(folder)

    return put


def ping(taxi, second, lat=33.58, lon=-7.55, **more):
    return {"taxi_id": taxi, "timestamp": T0 + second * 1000, "lat": lat, "lon": lon, "speed": 30.0, "status": "available", **more}


def request(trip, second, zone=11, **more):
    return {"trip_id": trip, "rider_id": "r", "origin_zone": zone, "destination_zone": 2, "requested_at": T0 + second * 1000, **more}


def test_gps_job_quarantine_and_restart(spark, topic, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: gps.start_gps_job(common.read_event_files(spark, src), out, ck, B.grid_polygons(spark), every=None).awaitTermination()
    src = topic("gps", ping("a", 0), "not json", ping("out", 1, lat=40.0), {"lat": 1, "lon": 2, "timestamp": 5}, ping("b", 2, extra="x"))
    run()
    topic("gps", ping("c", 3), {**ping("d", 4), "lat": "north"}, {**ping("e", 5), "timestamp": None}, {"driver_id": "f", **{k: v for k, v in ping("x", 6).items() if k != "taxi_id"}})
    run()
    run()  # nothing new
    pos = spark.read.parquet(f"{out}/positions")
    assert sorted(r["taxi_id"] for r in pos.collect()) == ["a", "b", "c", "f"]
    assert pos.select("zone_id").distinct().first()[0] == 7 or pos.where("zone_id BETWEEN 1 AND 16").count() == 4
    bad = spark.read.parquet(f"{out}/quarantine")
    assert sorted(r["error"] for r in bad.collect()) == ["missing: taxi_id|driver_id", "missing: timestamp", "unreadable record", "unreadable record"]
    ev = [json.loads(r["value"]) for r in spark.read.parquet(f"{out}/events").collect()]
    assert all(e["zone_name"] == f"Zone-{e['zone_id']}" for e in ev) and len(ev) == 4
    fixed, still = gps.reprocess_quarantine(bad)
    assert fixed.count() == 0 and still.count() == 4


def test_late_rows_drop_and_windows_close_behind_the_watermark(spark, topic, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        pos, _ = gps.normalise_gps(common.read_event_files(spark, g))
        req, _ = demand.requests_from_events(common.read_event_files(spark, r))
        demand.start_demand_job(demand.demand_stream(pos, req), B.grid_polygons(spark), out, ck, every=None).awaitTermination()

    g = topic("gps", ping("a", 1), ping("a", 2), ping("b", 3), ping("a", 400))
    r = topic("trips", request("t1", 5), request("t2", 6), request("t3", 400))
    run()
    first = {(x["window_start"].minute * 60 + x["window_start"].second): x for x in spark.read.parquet(f"{out}/demand_zones").collect()}
    assert set(first) == {0}
    topic("gps", ping("late", 10), ping("in_time", 300), ping("a", 900))
    topic("trips", request("t4", 900))
    run()
    rows = spark.read.parquet(f"{out}/demand_zones").orderBy("window_start", "zone_id").collect()
    seen = [(x["window_start"].minute * 60 + x["window_start"].second, x["active_vehicles"], x["pending_requests"], x["ratio"]) for x in rows]
    assert sum(v for s, v, _, _ in seen if s == 0) == 2  # the late ping is not counted
    assert sum(p for s, _, p, _ in seen if s == 0) == 2
    assert [v for s, v, _, _ in seen if s == 300] == [1]
    assert sum(v for s, v, _, _ in seen if s == 390) == 1 and not [s for s, *_ in seen if s >= 720]


def test_billing_job_never_bills_twice(spark, topic, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: billing.start_billing_job(spark, common.read_event_files(spark, src), out, ck, every=None).awaitTermination()
    done = lambda t, **m: {"trip_id": t, "driver_id": "d", "distance_km": 5.0, "duration_min": 10.0, "completed_at": T0, **m}
    src = topic("done", done("t1"), done("t1"), done("t2", surge=2.0), "junk")
    run()
    topic("done", done("t1", distance_km=99.0), done("t3"), {"tripId": "t2", "driverId": "d"})
    run()
    rows = {r["trip_id"]: str(r["total_fare"]) for r in spark.read.parquet(f"{out}/billing").collect()}
    assert rows == {"t1": "27.50", "t2": "55.00", "t3": "27.50"} and spark.read.parquet(f"{out}/billing").count() == 3
    assert spark.read.parquet(f"{out}/events").count() == 3 and spark.read.parquet(f"{out}/quarantine").count() == 1


def test_match_job_sees_the_newest_status(spark, topic, tmp_path):
    out, ck, fleet = (str(tmp_path / n) for n in ("out", "ck", "fleet"))
    schema = "taxi_id string, event_time timestamp, zone_id int, lat double, lon double, status string"
    pos = spark.createDataFrame([("near", 1, 11, 33.598, -7.509, "available"), ("near", 2, 11, 33.598, -7.509, "engaged"),
                                 ("far", 1, 16, 33.64, -7.43, "available")], schema.replace("event_time timestamp", "t int"))
    sinks.append_batch(pos.withColumn("event_time", F.timestamp_seconds("t")).drop("t"), fleet, 0)
    src = topic("trips", request("t1", 0), request("t2", 1, zone=1), request("t1", 2), '{"rider_id":"x"}')
    matching.start_match_job(common.read_event_files(spark, src), lambda: spark.read.parquet(fleet), out, ck, every=None, ttl=None).awaitTermination()
    ev = {e["trip_id"]: e for e in (json.loads(r["value"]) for r in spark.read.parquet(f"{out}/events").collect())}
    assert ev["t1"]["driver_id"] == "far" and ev["t1"]["status"] == "MATCHED" and ev["t1"]["matched_zone"] == 16
    assert ev["t2"]["status"] == "NO_TAXI_AVAILABLE" and "driver_id" not in ev["t2"]
    assert spark.read.parquet(f"{out}/matches").count() == 1 and spark.read.parquet(f"{out}/quarantine").count() == 1


def test_match_events_fit_their_schema_and_silent_taxis_stay(spark, topic, tmp_path):
    out, ck, fleet = (str(tmp_path / n) for n in ("out", "ck", "fleet"))
    pos = spark.createDataFrame([("old", T0 // 1000 - 90_000, 11, 33.598, -7.509, "available"), ("far", T0 // 1000 - 60, 16, 33.64, -7.43, "available")],
                                "taxi_id string, t long, zone_id int, lat double, lon double, status string")
    sinks.append_batch(pos.withColumn("event_time", F.timestamp_seconds("t")).drop("t"), fleet, 0)
    src = topic("trips", request("t1", 0), request("t2", 1, zone=1))
    matching.start_match_job(common.read_event_files(spark, src), lambda: spark.read.parquet(fleet), out, ck, every=None).awaitTermination()
    good, bad = events.split_valid(spark.read.parquet(f"{out}/events").select("value"), S.MATCH_EVENT, [["trip_id"], ["matched_at"]])
    assert bad.isEmpty() and good.count() == 2
    rows = spark.read.parquet(f"{out}/trips").collect()
    assert [(r["trip_id"], r["taxi_id"], r["status"]) for r in rows] == [("t1", "far", "MATCHED")] and rows[0]["eta_seconds"] >= 30


def test_request_events_keep_every_field(spark, topic, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    src = topic("trips", request("t1", 0, zone=3, destination_zone=2, origin_lat=33.51, origin_lon=-7.68, dest_lat=33.6, dest_lon=-7.5, call_type="C"))
    matching.start_request_job(common.read_event_files(spark, src), out, ck, every=None).awaitTermination()
    raw = spark.read.parquet(f"{out}/events").select("value")
    good, bad = events.split_valid(raw, S.TRIP_REQUEST_EVENT, [["trip_id"], ["requested_at"]])
    e = good.first()["event"].asDict()
    assert bad.isEmpty() and (e["origin_zone"], e["destination_zone"], e["call_type"], e["requested_at"]) == (3, 2, "C", T0)
    assert (e["origin_lat"], e["origin_lon"], e["dest_lat"], e["dest_lon"]) == (33.51, -7.68, 33.6, -7.5)


def test_request_job_resolves_zones(spark, topic, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    src = topic("trips", request("t1", 0, zone=77, origin_lat=33.51, origin_lon=-7.68), request("t2", 1, zone=None, rider_id=" "))
    matching.start_request_job(common.read_event_files(spark, src), out, ck, every=None).awaitTermination()
    rows = {r["trip_id"]: (r["origin_zone"], r["rider_id"], str(r["date_bucket"])) for r in spark.read.parquet(f"{out}/trips").collect()}
    assert rows == {"t1": (1, "r", "2024-01-01"), "t2": (1, "unknown", "2024-01-01")}


def test_archive_layout(spark, topic, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    src = topic("raw", ping("a", 0), "even junk is kept")
    run = lambda: archive.start_archive_job(common.read_event_files(spark, src), "raw.gps", out, ck, every=None).awaitTermination()
    run()
    topic("raw", ping("b", 1))
    run()
    folder = "topic=raw.gps/year=2023/month=11/day=14/hour=22"
    lines = [x for f in (tmp_path / "out" / folder).glob("*.txt") for x in f.read_text().splitlines()]
    assert len(lines) == 3 and "even junk is kept" in lines


def test_copies_within_the_watermark_are_dropped(spark, topic, tmp_path):
    done = lambda t, s: {"trip_id": t, "driver_id": "d", "completed_at": T0 + s * 1000}
    src = topic("done", done("a", 0), done("a", 5), done("b", 9))
    good, _ = billing.completions_from_events(common.read_event_files(spark, src))
    q = common.job(billing.without_repeats(good).writeStream.format("parquet").option("path", str(tmp_path / "o")), str(tmp_path / "ck"), None).start()
    q.awaitTermination()
    assert sorted(r["trip_id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]


def test_idle_input_policy(spark):
    common.configure(spark, "ignore")
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "max"
    common.configure(spark)
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "min"


# --- life cycle across batches -------------------------------------------------------------------

DRIVER = "driver_id string, ts timestamp, seq long, kind string, trip_id string, client_id string, lat double, lon double"


@pytest.fixture
def drive(spark, tmp_path):
    """Deliver batches of (driver, second, seq, kind, trip, client, lat, lon), one run each; the status rows."""
    common.configure(spark)

    def run(*batches, **options):
        src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
        for rows in batches:
            rows = [(r[0], *r[1:], *[None] * (8 - len(r))) for r in rows]
            frame = spark.createDataFrame(rows, DRIVER.replace("ts timestamp", "t long"))
            frame.select("driver_id", F.timestamp_seconds(F.lit(T0 // 1000) + F.col("t")).alias("ts"), *frame.columns[2:]).coalesce(1).write.mode("append").parquet(src)
            stream = lifecycle.lifecycle_stream(spark.readStream.schema(DRIVER).parquet(src), **options)
            common.job(stream.writeStream.format("parquet").option("path", out), ck, None).start().awaitTermination()
        got = spark.read.parquet(out).orderBy("driver_id", "ts", "seq").collect()
        return [(r["driver_id"], r["trip_id"], r["status"], int(r["ts"].timestamp()) - T0 // 1000) for r in got], got

    return run


RIDE = [("d", 10, 1, "assign", "t1", "c"), ("d", 20, 2, "accept"), ("d", 30, 3, "start"), ("d", 40, 4, "ping", None, None, 33.5, -7.6),
        ("d", 50, 5, "ping", None, None, 33.51, -7.6), ("d", 60, 6, "complete"), ("d", 70, 7, "assign", "t2", "c2"), ("d", 80, 8, "reject")]
TICK = ("", 100_000, 99, lifecycle.TICK)
ALL = [("d", "t1", "ACCEPTED", 20), ("d", "t1", "IN_PROGRESS", 30), ("d", "t1", "COMPLETED", 60), ("d", "t2", "REJECTED", 80)]


def test_events_one_batch_late_are_handled_in_their_place(drive):
    late = [RIDE[i] for i in (0, 3, 5)]
    rows, got = drive([e for e in RIDE if e not in late], late, [TICK], late_by="2 minutes")
    assert rows == ALL
    done = next(r for r in got if r["status"] == "COMPLETED")
    assert done["client_id"] == "c" and done["duration_min"] == 0.5 and 1.1 < done["distance_km"] < 1.12


def test_rows_wait_for_the_watermark_and_later_events_are_dropped(drive):
    rows, _ = drive(RIDE[:3], [("d", 1000, 9, "ping", None, None, 33.5, -7.6)], RIDE[3:], late_by="2 minutes")
    assert rows == ALL[:2]  # the ride's end came a quarter of an hour late


def test_a_silent_driver_is_forgotten(drive):
    far = 3 * 3600
    rows, _ = drive(RIDE[:3], [("e", far, 9, "assign", "x", "c")], [("d", far + 10, 10, "complete"), ("e", far + 20, 11, "accept")], [TICK],
                    late_by="2 minutes", silence_hours=1)
    assert rows == [*ALL[:2], ("e", "x", "ACCEPTED", far + 20)]  # nothing is left to complete


def test_silence_within_one_delivery_counts_too(drive):
    rows, _ = drive([*RIDE[:3], ("d", 3 * 3600, 9, "complete")], [TICK], late_by="2 minutes", silence_hours=1)
    assert rows == ALL[:2]


class OneDriver:
    """Handle and state variables of one driver, kept here; ``calls`` are what Spark sends to the JVM as messages."""

    def __init__(self):
        self.calls, self.timers, self.entries, self.value = [], [], [], None

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.call("get") or self.value, update=lambda v: self.call("update") or setattr(self, "value", v),
                               clear=lambda: self.call("clear") or setattr(self, "value", None), exists=lambda: self.call("exists") or self.value is not None)

    def getListState(self, name, schema):
        put = lambda v: self.call("put") or setattr(self, "entries", list(v))
        return SimpleNamespace(get=lambda: self.call("list") or iter(self.entries), put=put, appendValue=lambda v: self.call("append") or self.entries.append(v),
                               appendList=lambda v: self.call("append") or self.entries.extend(v), clear=lambda: put([]), exists=lambda: self.call("exists") or bool(self.entries))

    def registerTimer(self, ms):
        self.call("timer")
        self.timers.append(ms)

    def call(self, name):
        self.calls.append(name)


def test_a_driver_costs_few_messages_however_many_events_wait():
    handle, trips = OneDriver(), lifecycle.DriverTrips(10**9)
    trips.init(handle)
    kinds = ["assign", "accept", "start", *["ping"] * 2500, "complete", "assign"]
    event = lambda i, k: {"ts_us": (T0 + i) * 1000, "seq": i, "kind": k, **({"trip_id": f"t{i}"} if k == "assign" else {}), "lat": "33.5", "lon": "-7.6"}
    rows = [Row(driver_id="d", ts=None, ts_us=(T0 + i) * 1000, event=json.dumps(event(i, k))) for i, k in enumerate(kinds)]
    tick = Row(driver_id="d", ts=None, ts_us=T0 * 1000 - 1, event=None)
    assert list(trips.handleInputRows(("d",), iter([tick, *rows[::-1]]), None)) == []
    assert len(handle.entries) == 3 and len(handle.calls) <= 6 and handle.timers == [T0 + 1]
    handle.calls.clear()
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: T0 + len(kinds) - 1)  # the last event still waits
    out = list(trips.handleExpiredTimer(("d",), at, None))
    assert [(r["trip_id"], r["status"], r["duration_min"]) for r in out] == [("t0", "ACCEPTED", None), ("t0", "IN_PROGRESS", None), ("t0", "COMPLETED", 0.04)]
    assert len(handle.calls) <= 6 and len(handle.entries) == 1 and handle.timers[1:] == [T0 + len(kinds), T0 + len(kinds) - 2 + 10**9 + 1]


def test_drivers_of_a_bucket_share_their_messages_and_keep_their_states_apart():
    handle, trips = OneDriver(), lifecycle.DriverTrips(1000)
    trips.init(handle)
    event = lambda d, at, k, **more: {"driver_id": d, "ts_us": (T0 + at) * 1000, "seq": at, "kind": k, **more}
    send = lambda *events: (handle.calls.clear(), list(trips.handleInputRows((7,), iter(
        [Row(bucket=7, ts=None, ts_us=e["ts_us"], event=json.dumps(e)) for e in events]), None)), len(handle.calls))[-1]
    fire = lambda at: (handle.calls.clear(), list(trips.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: T0 + at), None)))[-1]
    drivers = [f"d{i}" for i in range(300)]
    assert send(*[event(d, 1 + i, k, **({"trip_id": "t" + d} if i == 0 else {})) for i, k in enumerate(("assign", "accept")) for d in drivers]) <= 4
    assert [(r["driver_id"], r["trip_id"], r["status"]) for r in sorted(fire(3), key=lambda r: int(r["driver_id"][1:]))] == [(d, "t" + d, "ACCEPTED") for d in drivers]
    assert len(handle.calls) <= 6 and handle.entries == [] and handle.timers == [T0 + 2, T0 + 1003]
    send(event("d5", 900, "start"), event("d6", 1500, "start"))
    assert [r["driver_id"] for r in fire(1003)] == ["d5"]  # the others are silent now; d6 is so before its event
    assert len(handle.calls) <= 6 and handle.timers[2:] == [T0 + 901, T0 + 1501, T0 + 1901]
    assert "d5" in handle.value[0] and "d7" not in handle.value[0]
    assert fire(1004) == [] and handle.calls == ["get"]  # an earlier timer leaves it at that
    assert fire(1600) == [] and fire(2600) == [] and handle.value is None


def test_many_drivers_in_few_buckets(drive):
    many = [("d%02d" % i, *e[1:4], *(("t%d" % i, "c") if e[3] == "assign" else e[4:])) for i in range(40) for e in RIDE[:6]]
    late = many[::3]
    rows, got = drive([*[e for e in many if e not in late], (None, 20, None, "accept"), ("x", 20, None, "accept")], [*late, (None, 5, 1, "assign", "tn", "c")], [TICK],
                      late_by="2 minutes", buckets=2)
    assert rows == [(None, "tn", "ACCEPTED", 20), *[("d%02d" % i, "t%d" % i, s, t) for i in range(40) for _, _, s, t in ALL[:3]]]
    assert got[0]["seq"] is None and {r["distance_km"] for r in got if r["status"] == "COMPLETED"} == {1.112}


def test_times_beyond_frames_do_not_stop_the_stream(drive):
    old, far = -T0 // 1000 - 62_000_000_000, 253_370_764_800 - T0 // 1000  # the years 5 and 9999
    rows, _ = drive([*RIDE, ("x", old, 1, "assign", "o", "c"), ("x", old + 1, 2, "accept")], [TICK], [("d", far, 9, "ping", None, None, 33.5, -7.6)], late_by="2 minutes")
    assert rows == ALL  # a watermark starts at 1970


def test_values_come_through_the_waiting_list_as_they_are(drive):
    trip, far, nan = 'a "t"\n\u00e9\\', 2**62 + 1, float("nan")
    rows, got = drive([("d", 10, far, "assign", trip, "c\t'"), ("d", 20, far + 1, "accept"), ("d", 25, far + 1, "ping", None, None, nan, nan), ("d", 30, far + 2, "start"),
                       ("d", 40, far + 3, "ping", None, None, 1e-7, -7.123456789012345), ("d", 50, far + 4, "ping", None, None, 0.01, -7.123456789012345),
                       ("d", 60, far + 5, "complete"), (None, 10, 1, "assign", "x", None), (None, 20, 2, "reject"), ("d", 70, 1, None)], [TICK], late_by="2 minutes")
    assert rows == [(None, "x", "REJECTED", 20), *[("d", trip, s, t) for s, t in (("ACCEPTED", 20), ("IN_PROGRESS", 30), ("COMPLETED", 60))]]
    assert [r["seq"] for r in got] == [2, far + 1, far + 2, far + 5]
    assert (got[-1]["client_id"], got[-1]["distance_km"]) == ("c\t'", 1.112)


# --- driver pings to all readers -----------------------------------------------------------------


def test_ping_fan_out_measures_across_batches(spark, topic, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: gps.start_ingest_job(spark, common.read_event_files(spark, src), out, ck, every=None).awaitTermination()
    src = topic("pings", ping("a", 0, 33.55), ping("a", 10, 33.56), ping("b", 0, 33.5), "junk")
    run()
    topic("pings", ping("a", 20, 33.57), ping("a", 5, 33.0), ping("b", 90_000, 33.6))  # one too late, one after a day of silence
    run()
    way = {r["taxi_id"]: (round(r["m"]), r["n"]) for r in spark.read.parquet(f"{out}/odometer").groupBy("taxi_id").agg(
        F.sum("metres").alias("m"), F.sum("pings").alias("n")).collect()}
    assert way == {"a": (2224, 3), "b": (0, 2)}
    index = sinks.read_keyed(spark, f"{out}/driver_index", ["taxi_id"], gps.LAST)
    assert {r["taxi_id"]: r["lat"] for r in index.collect()} == {"a": 33.57, "b": 33.6}
    assert spark.read.parquet(f"{out}/positions").count() == 6 == spark.read.parquet(f"{out}/events").count()
    assert spark.read.parquet(f"{out}/quarantine").count() == 1


def test_ping_housekeeping(spark, topic, tmp_path):
    """Folding between batches changes nothing of what is measured; old days of positions go."""
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for n in range(6):
        src = topic("pings", ping("a", 10 * n, 33.55 + 0.01 * n))
        gps.start_ingest_job(spark, common.read_event_files(spark, src), out, ck, every=None, fold_every=2).awaitTermination()
    metres = spark.read.parquet(f"{out}/odometer").agg(F.sum("metres")).first()[0]
    assert round(metres) == round(5 * 1111.95) and len(sinks.batch_ids(spark, f"{out}/driver_index")) <= 4
    assert spark.read.parquet(f"{out}/positions").count() == 1  # of 2024, dropped with every second batch


# --- ids of billed trips -------------------------------------------------------------------------


def test_a_batch_reads_the_folders_of_its_own_ids(spark, tmp_path):
    """The tenth batch of a few trips names as few folders as the second, and finds what was billed."""
    ids = str(tmp_path / "ids")
    batch = lambda n: spark.createDataFrame([(f"trip-{n}-{i}",) for i in range(3)], "trip_id string")
    assert billing.billed_before(spark, ids, 0, batch(0)) is None
    read = []
    for n in range(10):
        again = batch(n).unionByName(batch(max(0, n - 1)).limit(1))
        if n:
            found = billing.billed_before(spark, ids, n, again)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
            assert [r["trip_id"] for r in found.collect()] == [f"trip-{n - 1}-0"]
            read.append(len({r["bucket"] for r in again.select(common.bucket_of("trip_id").alias("bucket")).collect()}))
        sinks.append_batch(batch(n).select("trip_id", common.bucket_of("trip_id").alias("bucket")), ids, n, ["bucket"])
    assert max(read) <= 4 < common.BUCKETS
    sinks.fold_batches(spark, ids, 8, ["trip_id", "bucket"], ["trip_id"], ["bucket"])
    sinks.sweep(spark, ids)
    assert billing.billed_before(spark, ids, 10, batch(3)).count() == 3
