import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import geo

L = F.lit


def test_haversine_examples(one):
    assert one(geo.haversine_m(L(33.5), L(-7.5), L(33.5), L(-7.5))) == 0.0
    d = one(geo.haversine_m(L(33.5731), L(-7.5898), L(33.5934), L(-7.6787)))
    assert 8000 < d < 9500
    there = one(geo.haversine_m(L(33.5), L(-7.5), L(33.6), L(-7.6)))
    assert there == pytest.approx(one(geo.haversine_m(L(33.6), L(-7.6), L(33.5), L(-7.5))), abs=1e-9)
    km = one(geo.haversine_km(L(33.5), L(-7.5), L(33.6), L(-7.6)))
    assert km * 1000 == pytest.approx(there * S.EARTH_RADIUS_KM * 1000 / S.EARTH_RADIUS_M)


@pytest.mark.parametrize(("src", "dst"), [
    ((-8.6258, 41.1622), (-7.54515, 33.57995)), ((-8.6922, 41.1396), (-7.6895, 33.5072)), ((-8.5594, 41.1848), (-7.4008, 33.6527))])
def test_remap_centre_and_corners(one, src, dst):
    lon, lat = one(*geo.remap_point(L(src[0]), L(src[1])))
    assert lon == pytest.approx(dst[0], abs=1e-3)
    assert lat == pytest.approx(dst[1], abs=1e-3)


def test_remap_clamps(one):
    assert one(*geo.remap_point(L(-9.0), L(42.0))) == pytest.approx((S.CITY.lon_min, S.CITY.lat_max), abs=1e-12)


def test_remap_stays_in_bounds(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.uniform(-20, 5), rng.uniform(30, 50)) for _ in range(500)], "lon double, lat double")
    lon, lat = geo.remap_point(F.col("lon"), F.col("lat"))
    out = df.select(lon.alias("x"), lat.alias("y"))
    eps = 1e-9
    assert out.where(~F.col("x").between(S.CITY.lon_min - eps, S.CITY.lon_max + eps)
                     | ~F.col("y").between(S.CITY.lat_min - eps, S.CITY.lat_max + eps)).count() == 0


@pytest.mark.parametrize("text", ["[]", "[[1,2]]", "nope", "[[1],[2]]", "[[null,1],[2,3]]"])
def test_remap_polyline_unusable(one, text):
    assert one(geo.remap_polyline(L(text))) == "[]"


def test_remap_polyline(one):
    pts = json.loads(one(geo.remap_polyline(L("[[-8.62,41.15],[-8.61,41.16],[-8.60,41.17]]"))))
    assert len(pts) == 3
    for lon, lat in pts:
        assert S.CITY.lon_min <= lon <= S.CITY.lon_max and S.CITY.lat_min <= lat <= S.CITY.lat_max
        assert round(lon, 6) == lon and round(lat, 6) == lat


@pytest.mark.parametrize(("text", "count"), [("[]", 0), ("bad", 0), ("[[1,2],[3,4]]", 2)])
def test_point_count(one, text, count):
    assert one(geo.point_count(geo.parse_polyline(L(text)))) == count


def test_polyline_length_needs_two_good_points(one):
    length = lambda t: one(geo.polyline_length_km(geo.parse_polyline(L(t))))
    assert length("[[1,2]]") is None and length("[]") is None and length("x") is None
    assert length("[[1,2],[null,3]]") is None and length("[[1,2],[3]]") is None
    assert length("[[0,0],[0,1],[0,2]]") == pytest.approx(2 * math.pi * S.EARTH_RADIUS_KM / 180)


def test_duration_of_unreadable_polyline_is_null(one):
    assert one(geo.polyline_duration_s(geo.parse_polyline(L("x")))) is None
    assert one(geo.polyline_duration_s(geo.parse_polyline(L("[[1,2],[1,2]]")))) == 30


def test_grid_zones(one):
    z = lambda lat, lon, mode: one(geo.grid_zone(L(lat), L(lon), mode))
    assert z(33.5073, -7.6894, "reject") == 1 and z(33.6526, -7.4009, "reject") == 16
    assert z(33.58, -7.545, "reject") in range(1, 17)
    assert z(33.50, -7.6894, "reject") is None and z(33.5073, -7.69, "reject") is None
    assert z(33.50, -7.70, "clamp") == 1 and z(34.0, -7.0, "clamp") == 16
    assert one(geo.grid_zone(F.lit(None).cast("double"), L(-7.5), "clamp")) is None


def test_source_zone_is_capped(one):
    assert one(geo.source_grid_zone(L(-8.72), L(41.14))) == 1
    assert one(geo.source_grid_zone(L(-8.5), L(41.30))) == 22
    assert one(geo.source_grid_zone(L(-9.0), L(41.0))) == 1


def test_adjacency_does_not_wrap(one):
    assert one(geo.adjacent_zones(L(6))) == [1, 2, 3, 5, 6, 7, 9, 10, 11]
    assert one(geo.adjacent_zones(L(4))) == [3, 4, 7, 8]
    assert one(geo.adjacent_zones(L(1))) == [1, 2, 5, 6]


def test_zone_center_falls_back_into_its_zone(spark):
    df = spark.range(1, 17).select(F.col("id").cast("int").alias("z"))
    lat, lon = geo.zone_center(F.col("z"))
    assert df.where(geo.grid_zone(lat, lon, "reject") != F.col("z")).count() == 0


def test_eta(one):
    assert one(geo.eta_seconds(L(0.0))) == 30 and one(geo.eta_seconds(L(250.0))) == 30
    assert one(geo.eta_seconds(L(1001.0))) == 120


SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
HOLE = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]
ELL = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0], [2.0, 4.0], [0.0, 4.0]]


def ring(r):
    return F.array(*[F.array(L(x), L(y)) for x, y in r])


@pytest.mark.parametrize(("x", "y", "inside"), [(1.0, 1.0, True), (3.0, 1.0, True), (1.0, 3.0, True), (3.0, 3.0, False), (-1.0, 1.0, False)])
def test_open_l_ring(one, x, y, inside):
    assert one(geo.point_in_ring(L(x), L(y), ring(ELL))) is inside
    assert one(geo.point_in_ring(L(x), L(y), ring([*ELL, ELL[0]]))) is inside


def test_hole_and_multipolygon(one):
    donut = F.array(ring(SQUARE), ring(HOLE))
    assert one(geo.point_in_polygon(L(1.0), L(5.0), donut)) is True
    assert one(geo.point_in_polygon(L(5.0), L(5.0), donut)) is False
    far = F.array(ring([[x + 20, y] for x, y in SQUARE]))
    assert one(geo.point_in_multipolygon(L(25.0), L(5.0), F.array(donut, far))) is True
    assert one(geo.point_in_multipolygon(L(15.0), L(5.0), F.array(donut, far))) is False


def test_cells_are_hierarchical(one):
    cell = one(geo.cell_id(L(33.58), L(-7.6), 9))
    assert len(cell) == 10 and cell.startswith("q")
    assert one(geo.cell_parent(L(cell), 7)) == one(geo.cell_id(L(33.58), L(-7.6), 7)) == cell[:8]
    assert one(geo.cell_parent(L("12"), 7)) == "12" and one(geo.cell_parent(L("q12"), 7)) == "q12"


def test_round_trip_and_bounds_rules(one):
    pts = lambda *p: F.array(*[F.array(L(a), L(b)) for a, b in p])
    assert one(geo.is_round_trip(pts((1.0, 1.0), (2.0, 2.0), (1.0005, 1.0005)))) is True
    assert one(geo.is_round_trip(pts((1.0, 1.0), (1.0, 1.002)))) is False
    assert one(geo.points_in_box(pts((-7.5, 33.6), (-7.695, 33.5)))) is True
    assert one(geo.points_in_box(pts((-7.5, 33.6), (-8.0, 33.6)))) is False
