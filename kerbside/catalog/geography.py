"""Geospatial functions, polygons, polylines."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.catalog.base import query, rounded
from kerbside.functions import clip, geo
from kerbside.operators import curate, demand, proximity, zones
from kerbside.plans import bindings as B
from kerbside.session import once

CENTER = (33.5731, -7.5898)


@query(f"""SELECT event_id, round({B.sql_haversine('33.5731e0', '-7.5898e0', 'lat', 'lon')}, 3) AS metres,
  round({B.sql_haversine('33.5731e0', '-7.5898e0', 'lat', 'lon', S.EARTH_RADIUS_KM)}, 6) AS km FROM pings""",
       B.pings_sql())
def haversine_distances(spark, d):
    lat, lon = F.lit(CENTER[0]), F.lit(CENTER[1])
    return B.pings(spark, d).select(
        "event_id", F.round(geo.haversine_m(lat, lon, F.col("lat"), F.col("lon")), 3).alias("metres"),
        F.round(geo.haversine_km(lat, lon, F.col("lat"), F.col("lon")), 6).alias("km"))


_LEG = B.sql_haversine("points[i][2]", "points[i][1]", "points[i+1][2]", "points[i+1][1]", S.EARTH_RADIUS_KM)


@query(f"""SELECT trip_id, stride, n_points, round(list_sum(list_transform(range(1, n_points), lambda i: {_LEG})), 6) AS km,
  cast(len(points)*15 AS int) AS seconds FROM polylines""", B.TRIPS, B.POLYLINES)
def polyline_measures(spark, d):
    t = B.points(B.trips_hist(spark, d))
    return t.select("trip_id", "stride", "n_points", F.round(geo.polyline_length_km(F.col("points")), 6).alias("km"),
                    geo.polyline_duration_s(F.col("points")).alias("seconds"))


def _axis(v: str, a: float, b: float, lo: float, hi: float) -> str:
    return f"({lo}e0 + greatest(0e0, least(1e0, ({v}-({a}e0))/{b - a!r}e0))*{hi - lo!r}e0)"


_SRC, _DST = S.SOURCE_CITY, S.CITY
_RX = _axis("p[1]", _SRC.lon_min, _SRC.lon_max, _DST.lon_min, _DST.lon_max)
_RY = _axis("p[2]", _SRC.lat_min, _SRC.lat_max, _DST.lat_min, _DST.lat_max)


@query(f"""SELECT event_id, round({_axis('lon - 1', _SRC.lon_min, _SRC.lon_max, _DST.lon_min, _DST.lon_max)}, 6) AS city_lon,
  round({_axis('lat + 7.6e0', _SRC.lat_min, _SRC.lat_max, _DST.lat_min, _DST.lat_max)}, 6) AS city_lat FROM pings""",
       B.pings_sql())
def remapped_points(spark, d):
    lon, lat = geo.remap_point(F.col("lon") - 1, F.col("lat") + 7.6)
    return B.pings(spark, d).select("event_id", F.round(lon, 6).alias("city_lon"), F.round(lat, 6).alias("city_lat"))


@query(f"""SELECT trip_id, stride, cast(len(q) AS int) AS n, round(list_sum(list_transform(q, lambda p: p[1])), 4) AS lon_sum,
  round(list_sum(list_transform(q, lambda p: p[2])), 4) AS lat_sum
  FROM (SELECT *, list_transform(points, lambda p: [round({_RX},6), round({_RY},6)]) AS q FROM polylines)""",
       B.TRIPS, B.POLYLINES)
def remapped_polylines(spark, d):
    t = once(B.points(B.trips_hist(spark, d)), "q", F.from_json(geo.remap_polyline(F.to_json("points")), S.POLYLINE))
    total = lambda i: F.aggregate("q", F.lit(0.0), lambda acc, p: acc + p[i])
    return t.select("trip_id", "stride", F.size("q").alias("n"), F.round(total(0), 4).alias("lon_sum"),
                    F.round(total(1), 4).alias("lat_sum"))


@query()
def clipped_polylines(spark, d):
    """Remapped without clamp, clipped at the coast. No SQL twin; compared with a plain loop in tests."""
    t = B.points(B.trips_hist(spark, d)).select("trip_id", F.to_json("points").alias("POLYLINE"))
    return once(t, "city_polyline", clip.remap_and_clip(F.col("POLYLINE"))).where("city_polyline <> '[]'").drop("POLYLINE")


@query(f"""SELECT event_id, {B.sql_grid('lat', 'lon', 'reject')} AS rejecting, {B.sql_grid('lat', 'lon', 'clamp')} AS clamping
  FROM pings""", B.pings_sql(0.02))
def grid_zones(spark, d):
    p = B.pings(spark, d, 0.02)
    lat, lon = F.col("lat"), F.col("lon")
    return p.select("event_id", geo.grid_zone(lat, lon, "reject").alias("rejecting"),
                    geo.grid_zone(lat, lon, "clamp").alias("clamping"))


_G = S.SOURCE_GRID
_SX = f"greatest(0, least(5, floor((lon - 1.05e0 - ({_G.lon_min}e0))/{(_G.lon_max - _G.lon_min) / 6!r}e0)))"
_SY = f"greatest(0, least(3, floor((lat + 7.6e0 - {_G.lat_min}e0)/{(_G.lat_max - _G.lat_min) / 4!r}e0)))"


@query(f"""SELECT event_id, cast(least(22, {_SY}*6+{_SX}+1) AS int) AS source_zone,
  cast((least(22, {_SY}*6+{_SX}+1)-1)%16+1 AS int) AS folded FROM pings""", B.pings_sql())
def source_grid_zones(spark, d):
    z = geo.source_grid_zone(F.col("lon") - 1.05, F.col("lat") + 7.6)
    return B.pings(spark, d).select("event_id", z.alias("source_zone"), geo.fold_zone(z).alias("folded"))


_CLAT, _CLON = B.sql_center("origin_zone")


@query(f"""SELECT trip_id, round({_CLAT}, 6) AS lat, round({_CLON}, 6) AS lon,
  greatest(30, cast(floor({B.sql_haversine(_CLAT, _CLON, '33.5731e0', '-7.5898e0')} / {30000 / 3600!r}e0) AS int)) AS eta
  FROM requests""", B.REQUESTS)
def zone_centers_and_eta(spark, d):
    lat, lon = geo.zone_center(F.col("origin_zone"))
    far = geo.haversine_m(lat, lon, F.lit(CENTER[0]), F.lit(CENTER[1]))
    return B.requests(spark, d).select("trip_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"),
                                       geo.eta_seconds(far).alias("eta"))


@query("""SELECT DISTINCT a.origin_zone AS zone_id, b.z AS neighbour_id FROM requests a, (SELECT unnest(range(1,17)) AS z) b
  WHERE abs((a.origin_zone-1)%4 - (b.z-1)%4) <= 1 AND abs((a.origin_zone-1)//4 - (b.z-1)//4) <= 1""", B.REQUESTS)
def adjacent_grid_zones(spark, d):
    ids = B.requests(spark, d).select(F.col("origin_zone").alias("zone_id")).distinct()
    return zones.grid_adjacency(ids)


@query(f"""SELECT trip_id, CASE WHEN origin_zone%5<>0 AND origin_zone-2 BETWEEN 1 AND 16 THEN origin_zone-2
   ELSE coalesce({B.sql_grid('origin_lat', 'origin_lon')}, 1) END AS zone_id FROM requests""", B.REQUESTS)
def resolved_zones(spark, d):
    given = F.when(F.col("origin_zone") % 5 != 0, F.col("origin_zone") - 2)
    return B.requests(spark, d).select(
        "trip_id", geo.resolve_zone(given, F.col("origin_lat"), F.col("origin_lon")).alias("zone_id"))


def _cell_sql(res: int) -> str:
    x = f"cast(floor((lon+180e0)/360e0*{float(2 ** (2 * res))!r}e0) AS bigint)"
    y = f"cast(floor((lat+90e0)/180e0*{float(2 ** (2 * res))!r}e0) AS bigint)"
    hexes = " || ".join(f"substr('0123456789abcdef', cast(((({y})>>{2 * s})&3)*4+((({x})>>{2 * s})&3)+1 AS int), 1)"
                        for s in range(res - 1, -1, -1))
    return f"('q' || {hexes})"


@query(f"SELECT event_id, {_cell_sql(9)} AS cell, substr({_cell_sql(9)}, 1, 8) AS parent, '7' AS plain FROM pings",
       B.pings_sql())
def cell_ids(spark, d):
    cell = geo.cell_id(F.col("lat"), F.col("lon"), 9)
    return B.pings(spark, d).select("event_id", cell.alias("cell"), geo.cell_parent(cell, 7).alias("parent"),
                                    geo.cell_parent(F.lit("7"), 7).alias("plain"))


@query("SELECT round(min(lon),6) AS lon_min, round(max(lon),6) AS lon_max, round(min(lat),6) AS lat_min, "
       "round(max(lat),6) AS lat_max FROM pings", B.pings_sql())
def fleet_box(spark, d):
    return rounded(proximity.fleet_box(B.pings(spark, d)), 6, "lon_min", "lon_max", "lat_min", "lat_max")


# --- polygons ----------------------------------------------------------------------------------


@query(f"""SELECT event_id, coalesce({B.sql_grid('lat', 'lon', 'reject')}, 0) AS zone_id,
  CASE WHEN {B.sql_grid('lat', 'lon', 'reject')} IS NULL THEN 'Unknown'
       ELSE concat('Zone-', cast({B.sql_grid('lat', 'lon', 'reject')} AS varchar)) END AS zone_name
  FROM pings""", B.pings_sql(0.0213))
def polygon_zones(spark, d):
    """Few polygons: the cell cover is broadcast, points are not shuffled."""
    p = B.pings(spark, d, 0.0213)
    return zones.assign_zone_polygon(p, B.grid_polygons(spark)).select("event_id", "zone_id", "zone_name")


@query(f"""SELECT p.event_id, coalesce(min(a.zone_id), 0) AS zone_id,
  coalesce(arg_min(a.zone_name, a.zone_order), 'Unknown') AS zone_name
  FROM pings p LEFT JOIN areas a ON {B.IN_AREA} GROUP BY p.event_id""", B.pings_sql(0.0213), B.AREAS)
def polygon_zones_overlapping(spark, d):
    """Polygons that grow with the data and overlap; the first in order wins."""
    p = B.pings(spark, d, 0.0213)
    return zones.assign_zone_polygon(p, B.supplier_polygons(spark, d)).select("event_id", "zone_id", "zone_name")


@query("""SELECT p.event_id, min(a.zone_id) AS zone_id, arg_min(a.zone_name, a.zone_order) AS zone_name
  FROM pings p JOIN areas a ON lon BETWEEN x AND x+w*2 AND lat BETWEEN y AND y+w*2 GROUP BY p.event_id""",
       B.pings_sql(0.0213), B.AREAS)
def bounding_box_zones(spark, d):
    """Bounding box only, points outside dropped."""
    p = B.pings(spark, d, 0.0213)
    return zones.assign_zone_polygon(p, B.supplier_polygons(spark, d), how="inner", exact=False).select(
        "event_id", "zone_id", "zone_name")


@query(f"""SELECT event_id, {B.sql_grid('lat', 'lon', 'reject')} AS zone_id,
  concat('Grid-', cast({B.sql_grid('lat', 'lon', 'reject')} AS varchar)) AS zone_name
  FROM pings WHERE {B.sql_grid('lat', 'lon', 'reject')} IS NOT NULL""", B.pings_sql(0.0213))
def outside_city_dropped(spark, d):
    p = B.pings(spark, d, 0.0213)
    return zones.assign_zone_grid(p).select("event_id", "zone_id", "zone_name")


_BAR = "(SELECT zone_id, x AS x1, x+w*2 AS x2, y AS y1, y+w*1 AS y2 FROM areas UNION ALL SELECT zone_id, x, x+w*1, y, y+w*2 FROM areas)"


@query(f"""SELECT DISTINCT a.zone_id, b.zone_id AS neighbour_id FROM {_BAR} a JOIN {_BAR} b
  ON a.x1<=b.x2 AND b.x1<=a.x2 AND a.y1<=b.y2 AND b.y1<=a.y2""", B.AREAS)
def zone_adjacency(spark, d):
    """Zones that intersect or touch: an L is the union of two bars, so bars that meet say the same."""
    return zones.zone_adjacency(B.supplier_polygons(spark, d))


@query(f"""SELECT g.z AS zone_id, concat('Zone-', cast(g.z AS varchar)) AS zone_name, coalesce(l.ratio, 0) AS ratio,
  CASE WHEN coalesce(l.ratio,0) < 0.8 THEN 'green' WHEN coalesce(l.ratio,0) <= 1.2 THEN 'yellow' ELSE 'red' END AS color,
  CASE WHEN coalesce(l.ratio,0) < 0.8 THEN 'green' WHEN coalesce(l.ratio,0) <= 1.2 THEN 'yellow' ELSE 'red' END AS fill,
  0.6e0 AS fill_opacity
  FROM (SELECT unnest(range(1,17)) AS z) g LEFT JOIN (
    SELECT zone_id, arg_max(round(cast(r AS double)/greatest(v,1), 6), ws) AS ratio FROM (
      SELECT zone_id, ws, count(DISTINCT taxi_id) AS v, count(*) FILTER (taxi_id IS NULL) AS r FROM (
        SELECT {B.sql_grid('lat', 'lon')} AS zone_id, taxi_id, time_bucket(INTERVAL 1 HOUR, ts) AS ws FROM pings
        UNION ALL SELECT origin_zone, NULL, time_bucket(INTERVAL 1 HOUR, requested_at) FROM requests)
      GROUP BY zone_id, ws) GROUP BY zone_id) l ON g.z = l.zone_id""", B.pings_sql(), B.REQUESTS)
def choropleth(spark, d):
    ev = demand.demand_events(B.zoned(B.pings(spark, d)), B.requests(spark, d))
    windows = rounded(demand.aggregate_demand(ev, "1 hour"), 6, "ratio")
    return zones.choropleth(B.grid_polygons(spark), windows)


# --- polyline data-quality rules ----------------------------------------------------------------


@query("SELECT trip_id, stride, n_points FROM polylines WHERE len(points) > 3", B.TRIPS, B.POLYLINES)
def valid_trajectories(spark, d):
    """More than one usable point once the first two are cut off."""
    t = B.points(B.trips_hist(spark, d)).withColumn("points", F.expr("slice(points, 3, greatest(size(points) - 2, 0))"))
    return curate.valid_trajectory(t, "points").select("trip_id", "stride", "n_points")


@query("""SELECT trip_id, stride, n_points FROM polylines WHERE NOT (
  abs(points[1][1]-points[-1][1]) < 0.006 AND abs(points[1][2]-points[-1][2]) < 0.006)""", B.TRIPS, B.POLYLINES)
def round_trips_dropped(spark, d):
    return curate.without_round_trips(B.points(B.trips_hist(spark, d)), "points", 0.006).select(
        "trip_id", "stride", "n_points")


@query("""SELECT trip_id, stride, n_points, len(list_filter(points,
  lambda p: NOT (p[1] BETWEEN -8.71e0 AND -8.67e0 AND p[2] BETWEEN 41.13e0 AND 41.156e0))) = 0 AS clean FROM polylines""",
       B.TRIPS, B.POLYLINES)
def points_in_bounds(spark, d):
    box = S.Box(-8.70, -8.68, 41.14, 41.146)
    return B.points(B.trips_hist(spark, d)).select(
        "trip_id", "stride", "n_points", geo.points_in_box(F.col("points"), box, 0.01).alias("clean"))


@query("""SELECT trip_id, points[1][1] AS first_lon, points[1][2] AS first_lat, round(points[-1][1],6) AS last_lon,
  round(points[-1][2],6) AS last_lat, round(points[3][1],6) AS third_lon, cast(len(points) AS int) AS n FROM polylines""",
       B.TRIPS, B.POLYLINES)
def polyline_access(spark, d):
    """First, last, n-th and number of points, through text; an absent point is null."""
    t = once(B.points(B.trips_hist(spark, d)), "p", geo.parse_polyline(F.to_json("points")))
    at = lambda i, j: F.get(F.try_element_at("p", F.lit(i)), F.lit(j))
    return t.select("trip_id", at(1, 0).alias("first_lon"), at(1, 1).alias("first_lat"),
                    F.round(at(-1, 0), 6).alias("last_lon"), F.round(at(-1, 1), 6).alias("last_lat"),
                    F.round(at(3, 0), 6).alias("third_lon"), geo.point_count(F.col("p")).alias("n"))
