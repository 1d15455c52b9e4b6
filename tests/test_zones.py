import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.operators import zones
from kerbside.plans import bindings as B
from kerbside.sources import files

SCHEMA = "zone_order int, zone_id int, zone_name string, polygons array<array<array<array<double>>>>"


def square(x, y, w):
    return [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]


@pytest.fixture
def shapes(spark):
    ell = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0], [2.0, 4.0], [0.0, 4.0]]
    rows = [
        (0, 1, "L", [[ell]]), (1, 2, "donut", [[square(10.0, 0.0, 10.0), square(14.0, 4.0, 2.0)]]),
        (2, 3, "pair", [[square(30.0, 0.0, 1.0)], [square(33.0, 0.0, 1.0)]]),
        (3, 4, "first", [[square(40.0, 0.0, 4.0)]]), (4, 5, "second", [[square(42.0, 0.0, 4.0)]]),
        (5, 6, "tiny", [[square(15.0, 5.0, 0.001)]]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


CASES = [("l_bar", 3.0, 1.0, 1), ("l_notch", 3.0, 3.0, 0), ("donut", 11.0, 5.0, 2), ("hole", 14.5, 5.5, 0), ("pair_a", 30.5, 0.5, 3),
         ("between", 32.0, 0.5, 0), ("pair_b", 33.5, 0.5, 3), ("overlap", 43.0, 1.0, 4), ("second", 45.0, 1.0, 5),
         ("tiny", 15.0005, 5.0005, 6), ("far", -100.0, 60.0, 0)]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_first_zone_by_order(spark, shapes, monkeypatch, broadcast):
    monkeypatch.setattr(zones, "_BROADCAST_VERTICES", broadcast)
    pts = spark.createDataFrame([(n, x, y) for n, x, y, _ in CASES], "name string, lon double, lat double")
    got = {r["name"]: r["zone_id"] for r in zones.assign_zone_polygon(pts, shapes).collect()}
    assert got == {n: z for n, _, _, z in CASES}
    inner = zones.assign_zone_polygon(pts, zones.zone_cover(shapes), how="inner")
    assert inner.count() == sum(1 for c in CASES if c[3])


def test_many_overlapping_zones_on_a_stream(spark, tmp_path):
    """300 zones over the same place: the smallest order wins, for tables and streams alike."""
    many = spark.createDataFrame([(i, 1000 + i, f"z{i}", [[square(0.0, 0.0, 1.0 + i)]]) for i in range(300)], SCHEMA)
    pts = spark.createDataFrame([(k, k * 7 + 0.5, 0.5) for k in range(45)], "k int, lon double, lat double")
    expect = {k: 1000 + max(0, 7 * k) if k * 7 < 300 else 0 for k in range(45)}
    assert {r["k"]: r["zone_id"] for r in zones.assign_zone_polygon(pts, many).collect()} == expect
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    pts.write.parquet(src)
    stream = zones.assign_zone_polygon(spark.readStream.schema(pts.schema).parquet(src), many)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(
        availableNow=True).start().awaitTermination()
    assert {r["k"]: r["zone_id"] for r in spark.read.parquet(out).collect()} == expect


def inside(x, y, ring):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1]):
        hit ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return hit


@pytest.fixture(scope="module")
def stars():
    """Star-shaped zones of sizes from 0.001 to 40 degrees that overlap, every third with a hole."""
    r = random.Random(8)
    found = []
    for i in range(40):
        x, y, size = r.uniform(-60, 60), r.uniform(-50, 50), 40 * 10 ** -r.uniform(0, 4.5)
        if i % 4 == 0 and i:
            x, y = found[i - 1][1]
        n = r.randint(5, 40)
        ring = []
        for k in range(n):
            far, angle = (0.4 + 0.6 * r.random()) * size, 2 * math.pi * k / n
            ring.append([x + far * math.cos(angle), y + far * math.sin(angle) / 2])
        hole = [[x + size * 0.1 * math.cos(a), y + size * 0.04 * math.sin(a)] for a in (0.0, 1.5, 3.0, 4.5)]
        found.append(([[ring, hole]] if i % 3 == 0 else [[ring]], (x, y), size))
    return found


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_cover_against_all_polygons(spark, stars, monkeypatch, broadcast):
    """Every point against every polygon; order 39 is the first zone, so that large and small ones mix."""
    monkeypatch.setattr(zones, "_BROADCAST_VERTICES", broadcast)
    r = random.Random(9)
    pts = [(r.uniform(-110, 110), r.uniform(-80, 80)) for _ in range(500)]
    for polygons, (x, y), size in stars:
        pts += [(x + r.uniform(-1, 1) * size, y + r.uniform(-1, 1) * size / 2) for _ in range(60)]
    rows = [(39 - i, i + 1, f"s{i}", polygons) for i, (polygons, _, _) in enumerate(stars)]

    def first(x, y):
        for _, zone, _, polygons in sorted(rows):
            if any(inside(x, y, rings[0]) and not any(inside(x, y, h) for h in rings[1:]) for rings in polygons):
                return zone
        return 0

    def boxed(x, y):
        for _, zone, _, polygons in sorted(rows):
            ring = polygons[0][0]
            if min(p[0] for p in ring) <= x <= max(p[0] for p in ring) and min(p[1] for p in ring) <= y <= max(p[1] for p in ring):
                return zone
        return 0

    frame = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)] + [(-1, None, 1.0), (-2, 400.0, 1.0), (-3, float("nan"), 1.0)],
                                  "i int, lon double, lat double")
    dim = spark.createDataFrame(rows, SCHEMA)
    out = zones.assign_zone_polygon(frame, dim)
    assert {q["i"]: q["zone_id"] for q in out.collect()} == {i: first(*p) for i, p in enumerate(pts)} | {-1: 0, -2: 0, -3: 0}
    assert out.count() == len(pts) + 3
    boxes = zones.assign_zone_polygon(frame, dim, exact=False)
    assert {q["i"]: q["zone_id"] for q in boxes.collect()} == {i: boxed(*p) for i, p in enumerate(pts)} | {-1: 0, -2: 0, -3: 0}


def test_one_join_for_any_levels(spark, stars):
    dim = spark.createDataFrame([(i, i + 1, f"s{i}", p) for i, (p, _, _) in enumerate(stars)], SCHEMA)
    cover = zones.zone_cover(dim)
    assert len(cover.levels) >= 4
    pts = spark.range(10).select(F.col("id").cast("double").alias("lon"), F.lit(0.5).alias("lat"))
    plan = zones.assign_zone_polygon(pts, cover)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_leaves_within_a_zone_need_no_edges(spark):
    """Of a large square most of the area lies in leaves without edges; a border leaf has few of many."""
    n = 400
    circle = [[10 + 5 * math.cos(2 * math.pi * k / n), 10 + 5 * math.sin(2 * math.pi * k / n)] for k in range(n)]
    cover = zones.zone_cover(spark.createDataFrame([(0, 1, "c", [[circle]])], SCHEMA))
    rows = cover.cells.where("size(_zones) > 0").select(F.col("_zones")[0].alias("z")).select(
        "z._inner", F.size(F.flatten(F.flatten("z._edges"))).alias("n")).collect()
    assert any(r["_inner"] for r in rows) and all(r["n"] in (-1, None) for r in rows if r["_inner"])
    assert max(r["n"] for r in rows if not r["_inner"]) <= n / 2


@pytest.mark.parametrize("exact", [True, False])
def test_zones_behind_one_that_holds_the_cell_are_left_early(spark, monkeypatch, exact):
    """Zones stacked on each other: only the first is carried past the first look at its cells."""
    made, cut = [], zones.cut_lineage
    monkeypatch.setattr(zones, "cut_lineage", lambda df: made.append(cut(df)) or made[-1])

    def carried(copies):
        made.clear()
        zones.zone_cover(spark.createDataFrame([(i, i + 1, f"z{i}", [[square(0.0, 0.0, 4.0)]]) for i in range(copies)], SCHEMA), exact)
        inner = [df.where("_inner").count() for df in made if "_inner" in df.columns]
        parts = [df.rdd.getNumPartitions() for df in made if "_inner" in df.columns]
        return inner, parts

    one, many = carried(1), carried(30)
    assert min(many[0]) == min(one[0]) and max(many[1]) > 1


def test_points_are_not_shuffled_for_few_zones(spark, sf_dir):
    out = zones.assign_zone_polygon(B.pings(spark, sf_dir), B.grid_polygons(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan


def test_adjacency(spark, shapes):
    got = {(r[0], r[1]) for r in zones.zone_adjacency(shapes, bits=8).collect()}
    assert got == {(i, i) for i in range(1, 7)} | {(4, 5), (5, 4)}  # tiny lies in the hole of donut
    inside = spark.createDataFrame([(0, 1, "a", [[square(0.0, 0.0, 10.0)]]), (1, 2, "b", [[square(4.0, 4.0, 1.0)]]),
                                    (2, 3, "c", [[square(10.0, 10.0, 1.0)]])], SCHEMA)
    got = {(r[0], r[1]) for r in zones.zone_adjacency(inside, bits=8).collect()}
    assert {(1, 2), (2, 1), (1, 3), (3, 1)} <= got and (2, 3) not in got


def test_adjacency_of_zones_in_one_split_is_dealt_to_all_cores(spark, shapes):
    """The pairs of segments are the work: they are dealt out by cell, however few bytes they are."""
    plan = zones.zone_adjacency(shapes.coalesce(1), bits=8)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(cell" in plan


def segments_of(polygons):
    return [(a, b) for rings in polygons for ring in rings for a, b in zip(ring, ring[-1:] + ring[:-1]) if a != b]


def meet(p1, p2, q1, q2):
    turn = lambda a, b, c: (v := (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) and math.copysign(1, v)
    boxes = all(min(p1[k], p2[k]) <= max(q1[k], q2[k]) and min(q1[k], q2[k]) <= max(p1[k], p2[k]) for k in (0, 1))
    return boxes and turn(p1, p2, q1) * turn(p1, p2, q2) <= 0 and turn(q1, q2, p1) * turn(q1, q2, p2) <= 0


def within(v, polygons):
    return any(inside(*v, rings[0]) and not any(inside(*v, h) for h in rings[1:]) for rings in polygons)


@pytest.fixture(scope="module")
def mixed(stars):
    """Zones that are told by their rectangles, zones that aren't, zones that touch only; ids that come twice."""
    found = [polygons for polygons, _, _ in stars]
    for i in range(12):
        x, y, w = float(i % 4 * 4), float(i // 4 * 4), 2.0 if i % 5 else 1.0
        low = [[x, y], [x + 2 * w, y], [x + 2 * w, y + w], [x + w, y + w], [x + w, y + 2 * w], [x, y + 2 * w]]
        top = [[x, y], [x + w, y], [x + w, y + w], [x + 2 * w, y + w], [x + 2 * w, y + 2 * w], [x, y + 2 * w]]
        found.append([[low if i % 2 else top]])
    found += [[[square(-5.0, -5.0, 9.0), square(-2.0, -2.0, 2.5)]], [[square(-1.5, -1.5, 1.5)]], [[[[0.0, 0.0], [1.0, 1.0], [1.0, 0.0]]]],
              [[[[1.0, 1.0], [2.0, 2.0], [1.0, 2.0]]]], [[square(50.0, 50.0, 1.0)], [square(3.0, 3.0, 1.0)]], [[[[4.5, 4.5]]]],
              [[[[16.0, 4.0], [18.0, 4.0], [18.0, 5.0], [20.0, 5.0], [18.0, 5.0], [18.0, 6.0], [16.0, 6.0]]]], [[square(19.5, 4.5, 1.0)]]]
    return [(i + 1, polygons) for i, polygons in enumerate(found)] + [(3, [[square(60.0, -40.0, 3.0)]]), (9, [[square(62.0, -40.0, 2.0)]])]


def adjacent_pairs(rows):
    met = {(z, z) for z, _ in rows}
    for a, mine in rows:
        for b, other in rows:
            if a < b and (any(meet(*p, *q) for p in segments_of(mine) for q in segments_of(other))
                          or any(within(rings[0][0], other) for rings in mine) or any(within(rings[0][0], mine) for rings in other)):
                met |= {(a, b), (b, a)}
    return met


@pytest.mark.parametrize("edge_pairs, side", [(100_000, 8_192), (150, 8_192), (100_000, 5)])
def test_adjacency_against_all_pairs(spark, mixed, monkeypatch, edge_pairs, side):
    """Told by rectangles, by edges one by one or hashed to cells, in blocks or not: each pair comes once."""
    monkeypatch.setattr(zones, "_EDGE_PAIRS", edge_pairs)
    monkeypatch.setattr(zones, "_SIDE", side)
    frame = spark.createDataFrame([(i, z, "z", polygons) for i, (z, polygons) in enumerate(mixed)] + [
        (900, None, "none", [[square(0.0, 0.0, 5.0)]]), (901, 901, "empty", None), (902, 902, "bare", [[[[None, 1.0], [2.0, None]]]])], SCHEMA)
    got = [(r[0], r[1]) for r in zones.zone_adjacency(frame).collect()]
    assert sorted(got, key=str) == sorted(adjacent_pairs(mixed) | {(None, None), (901, 901), (902, 902)}, key=str)


def test_adjacent_pairs_are_neither_shuffled_nor_made_distinct(spark, monkeypatch):
    """Zones stacked on each other: the pairs are their square. Only ids go through an aggregate, and no task has
    all pairs of a place."""
    monkeypatch.setattr(zones, "_SIDE", 16)
    n = 120
    stacked = spark.createDataFrame([(i, i, f"z{i}", [[square(1.0 + i / 1000, 1.0, 1.0)]]) for i in range(n)], SCHEMA)
    out = zones.zone_adjacency(stacked)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == n * n and max(tasks) < n * n / 4


def test_grid_polygons_touch_like_the_grid(spark):
    got = {(r[0], r[1]) for r in zones.zone_adjacency(B.grid_polygons(spark)).collect()}
    ids = spark.range(1, 17).select(F.col("id").cast("int").alias("zone_id"))
    assert got == {(r[0], r[1]) for r in zones.grid_adjacency(ids).collect()}


def test_geojson_collection(spark, tmp_path):
    feature = lambda name, geom, **p: {"type": "Feature", "properties": {"Arrondissement": name, **p}, "geometry": geom}
    doc = {"type": "FeatureCollection", "features": [
        feature("arrondissement d'Anfa", {"type": "Polygon", "coordinates": [square(0.0, 0.0, 1.0)]}, Prefecture="P", Population=7),
        feature("Sidi Belyout x", {"type": "MultiPolygon", "coordinates": [[square(2.0, 0.0, 1.0)], [square(5.0, 0.0, 1.0)]]}),
        feature("Nowhere", {"type": "Polygon", "coordinates": [square(9.0, 0.0, 1.0)]}),
    ]}
    (tmp_path / "z.geojson").write_text(json.dumps(doc, indent=1), encoding="utf-8")
    z = files.read_zones_geojson(spark, str(tmp_path / "z.geojson"))
    rows = sorted(z.collect(), key=lambda r: r["zone_order"])
    assert [(r["zone_id"], r["zone_name"], r["prefecture"], r["population"]) for r in rows] == [
        (2, "Anfa", "P", 7), (17, "Sidi Belyout", "Unknown", 0), (0, "Nowhere", "Unknown", 0)]
    pts = spark.createDataFrame([(0.5, 0.5), (5.5, 0.5), (9.5, 0.5)], "lon double, lat double")
    assert [r["zone_id"] for r in zones.assign_zone_polygon(pts, z, how="inner").orderBy("lon").collect()] == [2, 17]


def test_weather_arrays(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"hourly": {
        "time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], "temperature_2m": [9.9, None, 25.0], "precipitation": [0.2, 0.1, None]}}))
    rows = files.read_weather(spark, str(tmp_path / "w.json")).orderBy("time_window").collect()
    assert [(r["temperature_bucket"], r["is_raining"]) for r in rows] == [("cold", 1), ("cold", 0), ("hot", 0)]


def test_default_zone_map(spark):
    rows = files.default_zone_map(spark).orderBy("source_zone_id").collect()
    assert len(rows) == 22
    assert tuple(rows[0]) == (1, 1, "residential", -8.706, 41.149) and tuple(rows[21]) == (22, 6, "commercial", -8.621, 41.201)
    assert rows[16]["arrondissement_id"] == 1 and S.SOURCE_ZONES == 22
