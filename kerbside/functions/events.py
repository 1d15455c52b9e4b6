"""JSON event columns: parse, quarantine split, alias fallback, build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.session import once

BAD_RECORD = "_bad_record"


def parse_event(value, schema: T.StructType) -> Column:
    """Tolerant parse; text that is no JSON or has a wrong type is kept in ``_bad_record``."""
    wide = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    return F.from_json(value, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD})


def check_events(df: DataFrame, schema: T.StructType, required: list[list[str]],
                 value: str = "value") -> DataFrame:
    """Add ``event`` (parsed struct) and ``error`` (null when the record is usable).

    ``required`` is a list of alternatives: each inner list needs at least one non-null field.
    """
    e = F.col("event")
    missing = F.concat_ws(", ", *[
        F.when(F.coalesce(*[e[f].cast("string") for f in group]).isNull(), F.lit("|".join(group)))
        for group in required
    ])
    error = (
        F.when(F.col(value).isNull(), F.lit("empty record"))
        .when(e[BAD_RECORD].isNotNull(), F.lit("unreadable record"))
        .when(missing != "", F.concat(F.lit("missing: "), missing))
    )
    return once(df, "event", parse_event(F.col(value), schema)).withColumn("error", error)


def split_valid(df: DataFrame, schema: T.StructType, required: list[list[str]],
                value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): the quarantine keeps the error and the first 200 characters."""
    return split_checked(check_events(df, schema, required, value), df.columns, value)


def split_checked(checked: DataFrame, columns: list[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``split_valid`` on checked records, of which ``columns`` were there before; keep them to parse once."""
    good = checked.where(F.col("error").isNull()).drop("error")
    bad = checked.where(F.col("error").isNotNull()).select(
        *[c for c in columns if c != value],
        F.col(value), "error", F.substring(F.col(value), 1, 200).alias("raw"),
    )
    return good, bad


def completion_fields(e) -> dict[str, Column]:
    """Completion event with either spelling of every field, and the defaults for absent ones."""
    return {
        "trip_id": F.coalesce(e["trip_id"], e["tripId"]),
        "driver_id": F.coalesce(e["driver_id"], e["driverId"]),
        "client_id": F.coalesce(e["client_id"], e["rider_id"], F.lit("unknown")),
        "distance_km": F.coalesce(e["distance_km"], e["distanceKm"], F.lit(5.0)),
        "duration_min": F.coalesce(e["duration_min"], e["durationMin"], F.lit(10.0)),
        "surge": F.coalesce(e["surge"], e["surge_multiplier"], F.lit(1.0)),
        "completed_at": e["completed_at"],
    }


def request_fields(e) -> dict[str, Column]:
    """Trip request: rider from either field, zones default to 1."""
    return {
        "trip_id": e["trip_id"],
        "rider_id": F.coalesce(e["rider_id"], e["client_id"], F.lit("")),
        "origin_zone": F.coalesce(e["origin_zone"], F.lit(1)),
        "destination_zone": F.coalesce(e["destination_zone"], F.lit(1)),
        "origin_lat": e["origin_lat"],
        "origin_lon": e["origin_lon"],
        "requested_at": e["requested_at"],
    }


def event_time(event_millis, record_time) -> Column:
    """Time in the event, else the time of the record."""
    return F.coalesce(F.timestamp_millis(event_millis), record_time)


def to_event(df: DataFrame, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """One JSON ``value`` per row, with a message ``key`` if asked for."""
    picked = [F.col(c) for c in (columns or df.columns)]
    out = [F.to_json(F.struct(*picked)).alias("value")]
    if key:
        out.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*out)
