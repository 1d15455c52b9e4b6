"""Driver state machine as keyed streaming state, in event-time order across micro-batches."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside.schemas import EARTH_RADIUS_M

TICK = "tick"  # an event of this kind only moves the watermark on
BUCKETS = 4096  # groups of drivers that share their state's messages
ENTRY = 1000  # events in an entry of the waiting list, at most
WAITING = "events string"  # lines of JSON, an event each
FLEET = "drivers string, timer_ms long, forget_ms long"  # lines of JSON, a driver each; timers for events, for silence
OUTPUT = ("driver_id string, trip_id string, status string, ts_us long, seq long, client_id string, "
          "distance_km double, duration_min double, surge double")
_FIELDS = ["pending", "pending_client", "active", "client", "status", "start_us", "metres", "lat", "lon"]
_STATUS = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


class Event(NamedTuple):
    """One event of a driver, in the order they are handled: by time, then by sequence number."""

    ts_us: int
    seq: int
    kind: str
    trip_id: str | None
    client_id: str | None
    lat: float | None
    lon: float | None


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def _half_up(value: float, places: int) -> float:
    """Round like the batch form: half up on the decimal digits."""
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


class DriverTrips(StatefulProcessor):
    """pending -> accepted (busy) -> in progress -> completed, or rejected.

    Events wait in a list until the watermark has passed them and are then handled by time, so the
    order in which micro-batches bring them doesn't matter. A driver is forgotten after a silence; a
    transition without its precondition is ignored.

    Every call to the state is a message to the JVM, and every key costs a few of them a batch. So a
    key is a bucket of drivers: it has one timer for its earliest waiting event and one for its
    longest silent driver, its drivers and timers are one value, and an entry of the list holds up to
    ``ENTRY`` events. In memory at a time are the drivers of a bucket and their events within the
    watermark's delay.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fleet = handle.getValueState("fleet", FLEET)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._wait((r.ts_us, r.event) for r in rows)
        return iter([])

    def _wait(self, events: Iterator[tuple[int, str | None]]) -> None:
        earliest, lines = None, []
        for ts_us, line in events:
            if line is None:
                continue  # a tick
            if earliest is None or ts_us < earliest:
                earliest = ts_us
            lines.append(line)
            if len(lines) == ENTRY:
                self.waiting.appendValue(("\n".join(lines),))
                lines = []
        if lines:
            self.waiting.appendValue(("\n".join(lines),))
        if earliest is not None:
            drivers, timer, forget = self.fleet.get() or (None, None, None)
            first = earliest // 1000 + 1  # the first millisecond after the event
            if timer is None or first < timer:
                self.handle.registerTimer(first)
                self.fleet.update((drivers, first, forget))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()  # nothing up to here can come any more
        lines, timer, forget = self.fleet.get() or (None, None, None)
        events, silence = timer is not None and timer <= passed, forget is not None and forget <= passed
        if not events and not silence:
            return  # an earlier timer has done it
        drivers = _drivers(lines)
        if events:
            due, rest, earliest = defaultdict(list), [], None
            for (entry,) in self.waiting.get():
                for line, (driver, e) in zip(entry.split("\n"), _events(entry), strict=True):
                    if e.ts_us < passed * 1000:
                        due[driver].append(e)
                    else:
                        rest.append(line)
                        earliest = e.ts_us if earliest is None else min(earliest, e.ts_us)
            for driver, turns in due.items():
                state, last = drivers.get(driver) or (dict.fromkeys(_FIELDS), None)
                for e in sorted(turns, key=itemgetter(0, 1)):
                    if last is not None and e.ts_us // 1000 - last > self.silence_ms:
                        state = dict.fromkeys(_FIELDS)  # the driver was forgotten before this event
                    for row in step(driver, state, e):
                        yield _STATUS(*row)
                    last = e.ts_us // 1000
                drivers[driver] = state, last
            timer = None
            if rest:
                self.waiting.put([("\n".join(rest[i:i + ENTRY]),) for i in range(0, len(rest), ENTRY)])
                timer = earliest // 1000 + 1
                self.handle.registerTimer(timer)
            else:
                self.waiting.clear()
        if silence:
            drivers = {d: (s, last) for d, (s, last) in drivers.items() if last + self.silence_ms >= passed}
        if silence or forget is None:
            forget = None
            if drivers:
                forget = min(last for _, last in drivers.values()) + self.silence_ms + 1
                self.handle.registerTimer(forget)
        if drivers or timer is not None:
            self.fleet.update((_lines(drivers), timer, forget))
        else:
            self.fleet.clear()

    def close(self) -> None:
        pass


class FleetTrips(DriverTrips):
    """The same on frames: a bucket has enough rows for them, and single rows cost far more to read."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._wait(e for frame in rows for e in zip(frame["ts_us"].tolist(), frame["event"].tolist(), strict=True))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = list(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))
        if rows:
            yield pd.DataFrame(rows, columns=list(_STATUS), dtype=object)  # whole numbers stay whole beside nulls


def _drivers(lines: str | None) -> dict[str | None, tuple[dict, int]]:
    """State and millisecond of the last event by driver."""
    rows = map(json.loads, lines.split("\n")) if lines else ()
    return {driver: (dict(zip(_FIELDS, state, strict=True)), last) for driver, last, *state in rows}


def _lines(drivers: dict[str | None, tuple[dict, int]]) -> str:
    return "\n".join(json.dumps([driver, last, *state.values()]) for driver, (state, last) in drivers.items())


def _events(entry: str) -> Iterator[tuple[str | None, Event]]:
    """Driver and event of each line, all read at once."""
    for get in (e.get for e in json.loads(f"[{entry.replace(chr(10), ',')}]")):
        lat, lon = get("lat"), get("lon")
        yield get("driver_id"), Event(get("ts_us"), get("seq"), get("kind"), get("trip_id"), get("client_id"),
                                      None if lat is None else float(lat), None if lon is None else float(lon))


def _line() -> Column:
    """An event as a line of JSON; coordinates as text, which keeps them exact, NaN as null."""
    place = lambda c: F.when(~F.isnan(c), F.col(c)).cast("string").alias(c)
    return F.to_json(F.struct("driver_id", *[place(c) if c in ("lat", "lon") else c for c in Event._fields]))


def step(driver: str, s: dict, e: Event) -> list[tuple]:
    """Apply one event to a driver's state; the status rows it gives."""
    def status(trip, name, *more):
        return [(driver, trip, name, e.ts_us, e.seq, *(more or (None, None, None, None)))]

    if e.kind == "ping":
        if s["active"] is not None and s["start_us"] is not None and s["lat"] is not None:
            s["metres"] += _metres(s["lat"], s["lon"], e.lat, e.lon)
        s["lat"], s["lon"] = e.lat, e.lon
        s["status"] = s["status"] or "AVAILABLE"
    elif e.kind == "assign":
        s["pending"], s["pending_client"] = e.trip_id, e.client_id
    elif e.kind in ("accept", "reject") and s["pending"] is not None:
        trip, client = s["pending"], s["pending_client"]
        s["pending"] = s["pending_client"] = None
        if e.kind == "reject":
            return status(trip, "REJECTED")
        s.update(active=trip, client=client, status="BUSY", start_us=None, metres=0.0)
        return status(trip, "ACCEPTED")
    elif e.kind == "start" and s["active"] is not None:
        s["start_us"], s["metres"] = e.ts_us, 0.0
        return status(s["active"], "IN_PROGRESS")
    elif e.kind == "complete" and s["active"] is not None:
        trip, client, km = s["active"], s["client"], (s["metres"] or 0.0) / 1000
        minutes = 5.0
        if s["start_us"] is not None:
            minutes = (e.ts_us // 1000 - s["start_us"] // 1000) / 60000
        s.update(active=None, client=None, status="AVAILABLE", start_us=None, metres=0.0)
        return status(trip, "COMPLETED", client or "unknown",
                      _half_up(km, 3) if km > 0 else 5.0, _half_up(minutes, 2), 1.0)
    return []


def lifecycle_stream(events: DataFrame, late_by: str = "10 minutes", silence_hours: float = 24 * 30,
                     buckets: int = BUCKETS) -> DataFrame:
    """Status rows of all drivers; COMPLETED rows also carry client, km, minutes and surge.

    events: driver_id, ts, seq, kind, trip_id, client_id, lat, lon. An event may arrive up to
    ``late_by`` after a newer one of any driver and is still handled in its place; later ones are
    dropped. Rows are given when the watermark passes their event. A driver without events for
    ``silence_hours`` of event time is forgotten: a trip left open then never completes. Events of
    kind ``TICK`` belong to no driver and only move the watermark, e.g. from a heartbeat, so that the
    last events of a quiet topic don't wait. Drivers share ``buckets`` keys of state; a bucket has to fit
    a task's memory, so raise the number with the fleet. A checkpoint keeps to its number of buckets.
    The watermark stays within the times that frames hold, up to 2261; later events only wait.
    Needs the RocksDB state store, see common.configure.
    """
    last = F.lit("2261-12-31").cast("timestamp")
    held = F.when(F.col("ts") > last, last).otherwise(F.col("ts"))
    timed = events.withColumns({"ts_us": F.unix_micros("ts"), "ts": held}).withWatermark("ts", late_by).select(
        F.pmod(F.xxhash64("driver_id"), F.lit(buckets)).cast("int").alias("bucket"), "ts", "ts_us",
        F.when(~F.col("kind").eqNullSafe(TICK), _line()).alias("event"))
    rows = timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FleetTrips(int(silence_hours * 3_600_000)), outputStructType=OUTPUT, outputMode="append",
        timeMode="EventTime")
    return rows.select("driver_id", "trip_id", "status", F.timestamp_micros("ts_us").alias("ts"), "seq", "client_id",
                       "distance_km", "duration_min", "surge")
