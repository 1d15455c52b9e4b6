from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kerbside.functions import scalars

L = F.lit


@pytest.mark.parametrize(("km", "minutes", "surge", "total", "commission", "payout"), [
    (5.0, 10.0, 1.0, "27.50", "4.13", "23.37"), (5.0, 10.0, 2.0, "55.00", "8.25", "46.75"),
    (0.5, 2.0, 1.0, "7.75", "1.16", "6.59"), (25.0, 45.0, 1.8, "207.00", "31.05", "175.95")])
def test_fare_examples(one, km, minutes, surge, total, commission, payout):
    f = scalars.fare(L(km), L(minutes), L(surge))
    assert one(f["total_fare"], f["commission"], f["driver_payout"]) == (Decimal(total), Decimal(commission), Decimal(payout))


def test_payout_and_commission_add_up(spark):
    df = spark.range(2000).select((F.col("id") * 0.037).alias("km"), (F.col("id") % 91 * 0.71).alias("m"), (F.lit(1) + F.col("id") % 7 * 0.13).alias("s"))
    f = scalars.fare(F.col("km"), F.col("m"), F.col("s"))
    assert df.where(f["total_fare"] != f["commission"] + f["driver_payout"]).count() == 0


def test_surge_clamp_is_optional(one):
    f = scalars.fare(L(5.0), L(10.0), L(9.0), clamp=("1.0", "3.0"))
    assert one(f["total_fare"]) == Decimal("82.50")


def test_minor_units(one):
    assert one(scalars.minor_units(L("27.55").cast("decimal(8,2)"))) == 2755


@pytest.mark.parametrize(("raw", "name", "zone"), [
    ("arrondissement d'Anfa (x)", "Anfa", 2), ("Anfa - El Maarif", "El Maarif", 16), ("Ben M'Sick", "Ben M'Sick", 7),
    ("Ain Chok", "Aîn-Chock", 9), ("Essawda Sawda", "Assoukhour Assawda", 12), ("Ain Sebaa", "Aïn Sebaâ", 14), ("elsewhere", "elsewhere", 0)])
def test_zone_names(one, raw, name, zone):
    clean = scalars.clean_zone_name(L(raw))
    assert one(clean, scalars.zone_id_of(clean)) == (name, zone)


@pytest.mark.parametrize(("t", "bucket"), [(9.9, "cold"), (10.0, "mild"), (24.9, "mild"), (25.0, "hot")])
def test_temperature(one, t, bucket):
    assert one(scalars.temperature_bucket(L(t))) == bucket


def test_temperature_unknown_and_rain(one):
    assert one(scalars.temperature_bucket(L(None).cast("double"))) == "cold"
    assert one(scalars.rain_flag(L(0.1)), scalars.rain_flag(L(0.11)), scalars.rain_flag(L(None).cast("double"))) == (0, 1, 0)


@pytest.mark.parametrize(("ratio", "color"), [(0.0, "green"), (0.79, "green"), (0.8, "yellow"), (1.2, "yellow"), (1.21, "red")])
def test_ratio_color(one, ratio, color):
    assert one(scalars.ratio_color(L(ratio))) == color


def test_ratio_without_vehicles(one):
    assert one(scalars.demand_ratio(L(3), L(0)), scalars.demand_ratio(L(3), L(2))) == (3.0, 1.5)


@pytest.mark.parametrize(("zone", "hour", "demand"), [(5, 8, 23), (3, 17, 21), (5, 3, 2), (5, 12, 9), (4, 23, 9)])
def test_heuristic(one, zone, hour, demand):
    assert one(scalars.heuristic_demand(L(zone), L(hour))) == demand


def test_local_periods(one):
    ts = L("2024-01-01 23:30:00").cast("timestamp")  # already 2 January in the city (UTC+1)
    start = one(F.date_format(scalars.local_period_start(ts, "Africa/Casablanca", "day"), "yyyy-MM-dd HH:mm"))
    assert start == "2024-01-01 23:00"
    assert one(scalars.date_bucket(ts, "Africa/Casablanca"), scalars.date_bucket(ts)) == ("2024-01-02", "2024-01-01")
    week = one(F.date_format(scalars.local_period_start(L("2024-01-07 12:00:00").cast("timestamp"), "UTC", "week"), "yyyy-MM-dd"))
    assert week == "2024-01-01"


def test_year_month_is_not_padded(one):
    assert one(scalars.year_month(L("2013-07-01").cast("timestamp"))) == "2013-7"
