"""Date, text, weather, demand and money column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside import schemas as S

# --- time --------------------------------------------------------------------------------------


def from_epoch_seconds(value) -> Column:
    return F.timestamp_seconds(value)


def from_epoch_millis(value) -> Column:
    return F.timestamp_millis(value)


def year_month(ts) -> Column:
    """``2013-7``: not zero padded, a partition label and nothing to sort by."""
    return F.concat_ws("-", F.year(ts), F.month(ts))


def date_bucket(ts, tz: str = "UTC") -> Column:
    """Day label ``yyyy-MM-dd`` in the given zone (session zone is UTC)."""
    return F.date_format(ts if tz == "UTC" else F.from_utc_timestamp(ts, tz), "yyyy-MM-dd")


def local_date(ts, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_period_start(ts, tz: str, unit: str) -> Column:
    """Instant at which the local day, week (Monday) or month around ``ts`` begins."""
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(ts, tz)), tz)


def local_day_bounds(day: str, tz: str) -> tuple[Column, Column]:
    """Half-open instants [start, end) of a local calendar day."""
    start = F.to_timestamp(F.lit(day))
    return F.to_utc_timestamp(start, tz), F.to_utc_timestamp(start + F.expr("INTERVAL 1 DAY"), tz)


def is_weekend(ts) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), 1).otherwise(0)


def is_friday(ts) -> Column:
    return F.when(F.dayofweek(ts) == 6, 1).otherwise(0)


# --- zone names --------------------------------------------------------------------------------

# Text to look for (all of it), text that must be absent, zone name. First rule wins.
ZONE_NAME_RULES = [
    (["Mechouar"], [], "Mechouar Casablanca"),
    (["Anfa"], ["Maarif", "Belyout"], "Anfa"),
    (["Hay Hassani"], [], "Hay Hassani"),
    (["Sidi Moumen"], [], "Sidi Moumen"),
    (["Moulay Rachid"], [], "Moulay Rachid"),
    (["Sidi Othmane"], [], "Sidi Othmane"),
    (["Ben M", "Sick"], [], "Ben M'Sick"),
    (["Sbata"], [], "Sbata"),
    (["Chock"], [], "Aîn-Chock"),
    (["Chok"], [], "Aîn-Chock"),
    (["Fida"], [], "Al Fida"),
    (["Mers Sultan"], [], "Mers Sultan"),
    (["Assoukhour"], [], "Assoukhour Assawda"),
    (["Sawda"], [], "Assoukhour Assawda"),
    (["Hay Mohammadi"], [], "Hay Mohammadi"),
    (["Seba"], [], "Aïn Sebaâ"),
    (["Bernoussi"], [], "Sidi Bernoussi"),
    (["Maarif"], [], "El Maarif"),
    (["Belyout"], [], "Sidi Belyout"),
]


def clean_zone_name(raw) -> Column:
    """Short zone name out of a long bilingual label; unknown labels stay as they are."""
    picks = []
    for present, absent, name in ZONE_NAME_RULES:
        hit = F.lit(True)
        for text in present:
            hit = hit & raw.contains(text)
        for text in absent:
            hit = hit & ~raw.contains(text)
        picks.append(F.when(hit, F.lit(name)))
    return F.coalesce(*picks, raw)


def zone_id_of(name) -> Column:
    """Id of a clean zone name, 0 when unknown."""
    pairs = [F.lit(v) for item in S.ZONE_IDS.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(0))


# --- weather and demand ------------------------------------------------------------------------


def temperature_bucket(celsius) -> Column:
    """cold below 10, mild below 25, else hot; unknown counts as cold."""
    return F.when(celsius.isNull() | (celsius < 10), "cold").when(celsius < 25, "mild").otherwise("hot")


def hour_temperature_bucket(hour) -> Column:
    """Stand-in bucket by hour of day when no weather table is given."""
    return F.when(hour < 8, "cold").when(hour < 18, "mild").otherwise("hot")


def rain_flag(millimetres) -> Column:
    return F.when(millimetres > 0.1, 1).otherwise(0)


def demand_ratio(pending, vehicles) -> Column:
    return pending.cast("double") / F.greatest(vehicles, F.lit(1)).cast("double")


def ratio_color(ratio) -> Column:
    return F.when(ratio < 0.8, "green").when(ratio <= 1.2, "yellow").otherwise("red")


def heuristic_demand(zone_id, hour) -> Column:
    """Rule used when no model is at hand: peaks 7-9 and 17-19, night 0-5, plain day otherwise."""
    peak = hour.between(7, 9) | hour.between(17, 19)
    return (
        F.when(peak, F.lit(5 * 4.2) + zone_id % 3)
        .when(hour.between(0, 5), F.lit(5 * 0.4))
        .otherwise(F.lit(5 * 1.8))
        .cast("int")
    )


def miles_to_km(miles) -> Column:
    return miles * F.lit(S.KM_PER_MILE)


# --- money -------------------------------------------------------------------------------------


def fare(distance_km, duration_min, surge, clamp: tuple[str, str] | None = None) -> dict[str, Column]:
    """Exact fare breakdown, decimals throughout.

    The subtotal is not rounded; the total is rounded half up, the commission is taken from the
    rounded total, the payout is the difference. ``clamp`` optionally bounds the surge.
    """
    km = distance_km.cast("decimal(12,6)")
    minutes = duration_min.cast("decimal(12,6)")
    factor = surge.cast("decimal(6,4)")
    if clamp:
        low, high = (F.lit(v).cast("decimal(6,4)") for v in clamp)
        factor = F.when(factor.isNotNull(), F.least(high, F.greatest(low, factor)))
    base = F.lit(S.BASE_FARE).cast("decimal(4,2)")
    by_distance = F.lit(S.FARE_PER_KM).cast("decimal(4,2)") * km
    by_time = F.lit(S.FARE_PER_MINUTE).cast("decimal(4,2)") * minutes
    money = lambda c: F.round(c, 2).cast("decimal(8,2)")
    total = money((base + by_distance + by_time) * factor)
    commission = money(total * F.lit(S.COMMISSION_RATE).cast("decimal(4,2)"))
    return {
        "base_fare": base.cast("decimal(8,2)"),
        "distance_fare": money(by_distance),
        "time_fare": money(by_time),
        "surge_multiplier": F.round(factor, 2).cast("decimal(3,2)"),
        "total_fare": total,
        "commission": commission,
        "driver_payout": (total - commission).cast("decimal(8,2)"),
    }


def minor_units(amount) -> Column:
    """Exact amount in hundredths."""
    return (amount * 100).cast("long")
