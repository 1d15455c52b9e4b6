import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import geo
from kerbside.operators import proximity

QUERIES = "qid int, grp int, lat double, lon double"
POINTS = "pid string, grp int, lat double, lon double"


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * S.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def cloud(n, rng, hot=0.34, groups=1):
    """Random points of which a third sit on one spot and some more within a few metres of it."""
    out = []
    for i in range(n):
        r = rng.random()
        if r < hot:
            lat, lon = 33.55, -7.6
        elif r < hot + 0.2:
            lat, lon = 33.55 + rng.gauss(0, 2e-5), -7.6 + rng.gauss(0, 2e-5)
        else:
            lat, lon = rng.uniform(33.5, 33.66), rng.uniform(-7.7, -7.4)
        out.append((f"p{i:05d}", rng.randrange(groups), lat, lon))
    return out


def brute(queries, points, k, radius):
    want = {}
    for qid, grp, lat, lon in queries:
        hits = sorted((metres((lat, lon), (p[2], p[3])), p[0]) for p in points if p[1] == grp)
        want.setdefault(qid, []).extend(h for h in hits if radius is None or h[0] <= radius)
    return {q: [pid for _, pid in sorted(h)[:k]] for q, h in want.items() if h}


@pytest.mark.parametrize(("k", "radius", "groups", "leaf", "roots"), [
    (1, None, 1, 32, 64), (1, 900.0, 1, 4, 2), (7, None, 1, 4, 2), (50, 2000.0, 1, 16, 4), (1, None, 5, 4, 3), (3, 3000.0, 5, 8, 64)])
def test_equals_brute_force(spark, monkeypatch, k, radius, groups, leaf, roots):
    monkeypatch.setattr(proximity, "LEAF", leaf)
    monkeypatch.setattr(proximity, "ROOTS", roots)
    rng = random.Random(k * 31 + groups)
    points = cloud(700, rng, groups=groups)
    queries = [(i, g, 33.55 if i % 3 == 0 else rng.uniform(33.45, 33.7), -7.6 if i % 3 == 0 else rng.uniform(-7.75, -7.35))
               for i in range(120) for g in ([0] if groups == 1 else rng.sample(range(groups), 2))]
    # a query has one place, whatever its groups
    place = {}
    queries = [(i, g, *place.setdefault(i, (lat, lon))) for i, g, lat, lon in queries]
    q, p = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(points, POINTS)
    rows = proximity.nearest(q, p, k=k, radius_m=radius).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["pid"])
    assert got == brute(queries, points, k, radius)


def test_far_apart_and_across_the_date_line(spark):
    points = [("east", 0, 0.0, 179.9), ("west", 0, 0.0, -179.8), ("north", 0, 89.0, 10.0), ("home", 0, 10.0, 10.0)]
    queries = [(1, 0, 0.0, 179.99), (2, 0, 0.0, -179.99), (3, 0, 85.0, -170.0), (4, 0, -80.0, 20.0)]
    rows = proximity.nearest(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(points, POINTS)).collect()
    assert {r["qid"]: [r["pid"]] for r in rows} == brute(queries, points, 1, None)


def test_no_points_and_null_places(spark):
    q = spark.createDataFrame([(1, 0, 33.5, -7.5), (2, 0, None, None)], QUERIES)
    assert proximity.nearest(q, spark.createDataFrame([], POINTS)).count() == 0
    p = spark.createDataFrame([("a", 0, 33.5, -7.5), ("b", 0, None, -7.5)], POINTS)
    assert [(r["qid"], r["pid"]) for r in proximity.nearest(q, p).collect()] == [(1, "a")]


def test_plan_has_no_nested_loop_and_few_candidates(spark):
    """A third of 20 000 points on one spot, a third of the queries too: no pairs within the spot."""
    n = 20_000
    hot = F.col("id") % 3 == 0
    p = spark.range(n).select(
        F.col("id").cast("string").alias("pid"), F.when(hot, 33.55).otherwise(33.5 + F.rand(1) * 0.15).alias("lat"),
        F.when(hot, -7.6).otherwise(-7.7 + F.rand(2) * 0.3).alias("lon"))
    q = spark.range(n).select("id", F.when(hot, 33.5501).otherwise(33.5 + F.rand(3) * 0.15).alias("lat"),
                              F.when(hot, -7.6).otherwise(-7.7 + F.rand(4) * 0.3).alias("lon")).withColumnRenamed("id", "qid")
    out = proximity.nearest(q, p)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert out.count() == n


def test_requests_at_one_place_are_searched_once(spark):
    r = spark.range(300).select(
        F.concat(F.lit("t"), "id").alias("trip_id"), F.lit("r").alias("rider_id"), F.lit(6).alias("origin_zone"),
        F.lit(7).alias("destination_zone"), F.lit(None).cast("double").alias("origin_lat"), F.lit(None).cast("double").alias("origin_lon"))
    pos = spark.createDataFrame(
        [("near", 6, 33.562, -7.58, "available"), ("nearest", 6, 33.5617, -7.5812, "engaged"), ("far", 16, 33.65, -7.41, "available")],
        "taxi_id string, zone_id int, lat double, lon double, status string")
    rows = proximity.match_nearest(r, pos).collect()
    assert len(rows) == 300 and {x["driver_id"] for x in rows} == {"near"}
    lonely = proximity.match_nearest(r.withColumn("origin_zone", F.lit(13)), pos).collect()
    assert {x["status"] for x in lonely} == {"NO_TAXI_AVAILABLE"} or {x["driver_id"] for x in lonely} == {"near"}


def test_pickup_falls_back_to_zone_centres(spark):
    r = spark.createDataFrame(
        [("exact", 5, 33.60, -7.50), ("zone", 16, None, None), ("nothing", 99, None, None)],
        "trip_id string, origin_zone int, origin_lat double, origin_lon double").withColumn("destination_zone", F.lit(1))
    d = spark.createDataFrame([("a", 33.6001, -7.5001), ("b", 33.634, -7.437), ("c", 33.525, -7.653)], "driver_id string, lat double, lon double")
    got = {x["trip_id"]: x["driver_id"] for x in proximity.match_within_radius(r, d).collect()}
    assert got == {"exact": "a", "zone": "b", "nothing": "c"}


def test_index_add_and_remove(spark):
    p = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 5, 2.0, 2.0), ("b", 3, 3.0, 3.0)], "driver_id string, t int, lat double, lon double")
    p = p.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    gone = spark.createDataFrame([("b", 4), ("a", 2)], "driver_id string, t int").select("driver_id", F.timestamp_seconds("t").alias("departed_at"))
    assert [(r["driver_id"], r["lat"]) for r in proximity.driver_index(p, gone).collect()] == [("a", 2.0)]


def test_groups_of_a_leafs_size_need_no_pyramid(spark, monkeypatch):
    """Small groups are met at once, large ones walk; both give what a plain loop gives."""
    rows = [(f"p{i}", (i * 37 % 101) / 100, (i * 53 % 97) / 100, i % 20 if i < 100 else 99) for i in range(400)]
    asked = [(j, (j * 17 % 89) / 90, (j * 29 % 83) / 90, g) for j in range(30) for g in (j % 20, 99)]
    points = spark.createDataFrame(rows, "pid string, lat double, lon double, grp int")
    queries = spark.createDataFrame(asked, "qid int, lat double, lon double, grp int")
    walked, pyramid = [], proximity._pyramid
    monkeypatch.setattr(proximity, "_pyramid", lambda df: walked.append({r[0] for r in df.select("grp").distinct().collect()}) or pyramid(df))
    far = geo.haversine_m(F.col("q.lat"), F.col("q.lon"), F.col("p.lat"), F.col("p.lon"))
    best = queries.alias("q").join(points.alias("p"), "grp").groupBy("qid").agg(F.min_by("pid", F.struct(far, "pid")).alias("pid"))
    got = {(r["qid"], r["pid"]) for r in proximity.nearest(queries, points).collect()}
    assert got == {(r["qid"], r["pid"]) for r in best.collect()} and walked == [{99}]
    small = proximity.nearest(queries.where("grp < 99"), points.where("grp < 99"), k=2)
    assert walked == [{99}] and small.count() == 60
