"""Geospatial column functions.

Points inside arrays are ``[lon, lat]``. Null or short points give null, never an error, so the
functions are safe on outside data under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside import schemas as S

# Bits per axis of the finest square cell, about 0.6 m at the equator.
CELL_BITS = 26


def haversine(lat1, lon1, lat2, lon2, radius: float = S.EARTH_RADIUS_M) -> Column:
    """Great-circle distance, in the unit of ``radius``."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    )
    return F.atan2(F.sqrt(chord), F.sqrt(1 - chord)) * (2 * radius)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, S.EARTH_RADIUS_M)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, S.EARTH_RADIUS_KM)


def let(value, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- polylines ---------------------------------------------------------------------------------


def parse_polyline(text) -> Column:
    """JSON ``[[lon,lat],...]`` to an array of pairs; malformed text gives null."""
    return F.from_json(text, S.POLYLINE)


def point_count(points) -> Column:
    """Number of points, 0 when the polyline could not be read."""
    return F.coalesce(F.size(points), F.lit(0))


def is_point(p) -> Column:
    """Both coordinates present."""
    return p.isNotNull() & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()


def polyline_length_km(points) -> Column:
    """Sum of the legs; null for fewer than two points or any bad point."""

    def length(pts):
        rest = F.greatest(F.size(pts) - 1, F.lit(0))
        legs = F.zip_with(
            F.slice(pts, 1, rest), F.slice(pts, 2, rest),
            lambda a, b: haversine_km(F.get(a, F.lit(1)), F.get(a, F.lit(0)),
                                      F.get(b, F.lit(1)), F.get(b, F.lit(0))),
        )
        usable = (F.size(pts) > 1) & F.forall(pts, is_point)
        return F.when(usable, F.aggregate(legs, F.lit(0.0), lambda acc, leg: acc + leg))

    return let(points, length)


def polyline_duration_s(points) -> Column:
    """Sampling is one point per 15 s; null stays null."""
    return F.size(points) * S.SECONDS_PER_POINT


def remap_axis(value, src_min, src_max, dst_min, dst_max) -> Column:
    """Relative position inside the source range, clamped, carried to the target range."""
    rel = (value - src_min) / (src_max - src_min)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), rel))
    return F.when(value.isNotNull(), F.lit(dst_min) + clamped * F.lit(dst_max - dst_min))


def remap_point(lon, lat, src: S.Box = S.SOURCE_CITY, dst: S.Box = S.CITY) -> tuple[Column, Column]:
    return (
        remap_axis(lon, src.lon_min, src.lon_max, dst.lon_min, dst.lon_max),
        remap_axis(lat, src.lat_min, src.lat_max, dst.lat_min, dst.lat_max),
    )


def remap_points(points, src: S.Box = S.SOURCE_CITY, dst: S.Box = S.CITY) -> Column:
    """Every point remapped and rounded to six places; empty when the polyline is not usable."""

    def one(p):
        lon, lat = remap_point(F.get(p, F.lit(0)), F.get(p, F.lit(1)), src, dst)
        return F.array(F.round(lon, 6), F.round(lat, 6))

    def moved(pts):
        usable = (F.size(pts) > 1) & F.forall(pts, is_point)
        return F.when(usable, F.transform(pts, one)).otherwise(F.array().cast(S.POLYLINE))

    return let(points, moved)


def remap_polyline(text, src: S.Box = S.SOURCE_CITY, dst: S.Box = S.CITY) -> Column:
    """JSON in, JSON out; ``[]`` for malformed text or fewer than two points."""
    return F.to_json(remap_points(parse_polyline(text), src, dst))


def is_round_trip(points, tolerance: float = 0.001) -> Column:
    """First and last point closer than the tolerance on both axes."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    near = lambda i: F.abs(F.get(first, F.lit(i)) - F.get(last, F.lit(i))) < tolerance
    return near(0) & near(1)


def points_in_box(points, box: S.Box = S.CITY, margin: float = 0.01) -> Column:
    """Data-quality rule: every point is a pair inside the box, give or take the margin."""
    return F.forall(
        points,
        lambda p: (F.size(p) == 2)
        & F.get(p, F.lit(0)).between(box.lon_min - margin, box.lon_max + margin)
        & F.get(p, F.lit(1)).between(box.lat_min - margin, box.lat_max + margin),
    )


def keep_in_box(points, box: S.Box) -> Column:
    """Drop the points outside the box, keep the order of the rest."""
    return F.filter(
        points,
        lambda p: F.get(p, F.lit(0)).between(box.lon_min, box.lon_max)
        & F.get(p, F.lit(1)).between(box.lat_min, box.lat_max),
    )


def remap_without_clamp(points, src: S.Box, dst: S.Box = S.CITY) -> Column:
    lon_scale = (dst.lon_max - dst.lon_min) / (src.lon_max - src.lon_min)
    lat_scale = (dst.lat_max - dst.lat_min) / (src.lat_max - src.lat_min)
    return F.transform(
        points,
        lambda p: F.array(
            (F.get(p, F.lit(0)) - src.lon_min) * lon_scale + dst.lon_min,
            (F.get(p, F.lit(1)) - src.lat_min) * lat_scale + dst.lat_min,
        ),
    )


# --- grids -------------------------------------------------------------------------------------


def _grid_axis(value, low: float, high: float, steps: int) -> Column:
    return F.lit(float(steps)) * (value - low) / F.lit(high - low)


def grid_zone(lat, lon, mode: str = "reject", box: S.Box = S.CITY) -> Column:
    """Zone 1..16 of the 4 x 4 city grid.

    ``reject`` gives null outside the box; ``clamp`` moves outside points to the nearest cell.
    """
    gx = _grid_axis(lon, box.lon_min, box.lon_max, S.GRID_COLS)
    gy = _grid_axis(lat, box.lat_min, box.lat_max, S.GRID_ROWS)
    known = lat.isNotNull() & lon.isNotNull()
    if mode == "reject":
        inside = (gx >= 0) & (gx < S.GRID_COLS) & (gy >= 0) & (gy < S.GRID_ROWS)
        return F.when(known & inside,
                      (F.floor(gy) * S.GRID_COLS + F.floor(gx) + 1).cast("int"))
    clamp = lambda v, top: F.least(F.lit(float(top)), F.greatest(F.lit(0.0), v))
    cx, cy = clamp(gx, S.GRID_COLS - 1), clamp(gy, S.GRID_ROWS - 1)
    return F.when(known, (F.floor(cy) * S.GRID_COLS + F.floor(cx) + 1).cast("int"))


def source_grid_zone(lon, lat) -> Column:
    """Zone 1..22 of the 6 x 4 source-city grid; the last row has four zones only."""
    box = S.SOURCE_GRID
    gx = F.floor((lon - box.lon_min) / ((box.lon_max - box.lon_min) / S.SOURCE_GRID_COLS))
    gy = F.floor((lat - box.lat_min) / ((box.lat_max - box.lat_min) / S.SOURCE_GRID_ROWS))
    clamp = lambda v, top: F.least(F.lit(top), F.greatest(F.lit(0), v))
    cell = clamp(gy, S.SOURCE_GRID_ROWS - 1) * S.SOURCE_GRID_COLS + clamp(gx, S.SOURCE_GRID_COLS - 1)
    return F.when(lon.isNotNull() & lat.isNotNull(),
                  F.least(cell + 1, F.lit(S.SOURCE_ZONES)).cast("int"))


def fold_zone(source_zone) -> Column:
    """22 source zones folded onto the 16 city zones."""
    return ((source_zone - 1) % (S.GRID_COLS * S.GRID_ROWS) + 1).cast("int")


def zone_center(zone_id, box: S.Box = S.CITY) -> tuple[Column, Column]:
    """(lat, lon) of the middle of a grid zone; ids outside 1..16 take the nearest zone."""
    index = F.least(F.lit(S.GRID_COLS * S.GRID_ROWS - 1), F.greatest(F.lit(0), zone_id - 1))
    index = F.when(zone_id.isNotNull(), index)
    lon = F.lit(box.lon_min) + (index % S.GRID_COLS + 0.5) * ((box.lon_max - box.lon_min) / S.GRID_COLS)
    lat = F.lit(box.lat_min) + (F.floor(index / S.GRID_COLS) + 0.5) * ((box.lat_max - box.lat_min) / S.GRID_ROWS)
    return lat, lon


def adjacent_zones(zone_id) -> Column:
    """Array of the zones in the 3 x 3 neighbourhood, itself included; rows never wrap."""
    col = ((zone_id - 1) % S.GRID_COLS).cast("int")
    row = F.floor((zone_id - 1) / S.GRID_COLS).cast("int")
    spots = F.array(*[
        F.when((col + dx).between(0, S.GRID_COLS - 1) & (row + dy).between(0, S.GRID_ROWS - 1),
               (row + dy) * S.GRID_COLS + col + dx + 1)
        for dx in (-1, 0, 1) for dy in (-1, 0, 1)
    ])
    return F.array_sort(F.filter(spots, lambda z: z.isNotNull()))


def resolve_zone(zone_id, lat, lon) -> Column:
    """Explicit zone 1..16, else from coordinates, else zone 1."""
    return F.when(zone_id.between(1, S.GRID_COLS * S.GRID_ROWS), zone_id).otherwise(
        F.coalesce(grid_zone(lat, lon, "clamp"), F.lit(1))
    ).cast("int")


def eta_seconds(distance_m) -> Column:
    """Whole seconds at 30 km/h, never below 30."""
    return F.greatest(F.lit(S.ETA_FLOOR_SECONDS),
                      F.floor(distance_m / S.ETA_METRES_PER_SECOND).cast("int"))


# --- polygons ----------------------------------------------------------------------------------


def previous_vertices(ring) -> Column:
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))


def point_in_ring(lon, lat, ring) -> Column:
    """Even-odd rule: a ray to the east crosses the ring an odd number of times.

    Points exactly on an edge are undefined, as for any ray cast.
    """
    crossings = F.zip_with(
        ring,
        previous_vertices(ring),
        lambda a, b: ((a[1] > lat) != (b[1] > lat))
        & (lon < (b[0] - a[0]) * (lat - a[1]) / ((b[1] - a[1]) + S.GEOMETRY_EPSILON) + a[0]),
    )
    return F.size(F.filter(crossings, lambda hit: hit)) % 2 == 1


def ring_edges(ring) -> Column:
    """Edges of a ring as structs (ax, ay, bx, by)."""
    return F.zip_with(ring, previous_vertices(ring), lambda a, b: F.struct(
        a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))


def crosses_edges(lon, lat, edges) -> Column:
    """``point_in_ring`` on some of the ring's edges: all that a ray to the east from the point may cross."""
    hits = F.filter(edges, lambda e: ((e["ay"] > lat) != (e["by"] > lat))
                    & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / ((e["by"] - e["ay"]) + S.GEOMETRY_EPSILON) + e["ax"]))
    return F.size(hits) % 2 == 1


def point_in_polygon(lon, lat, rings) -> Column:
    """Inside the outer ring and inside none of the holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return point_in_ring(lon, lat, rings[0]) & ~F.exists(holes, lambda h: point_in_ring(lon, lat, h))


def point_in_multipolygon(lon, lat, polygons) -> Column:
    return F.exists(polygons, lambda rings: point_in_polygon(lon, lat, rings))


def point_in_edges(lon, lat, polygons) -> Column:
    """``point_in_multipolygon`` on rings of edges."""
    return F.exists(polygons, lambda rings: crosses_edges(lon, lat, rings[0]) & ~F.exists(
        F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda h: crosses_edges(lon, lat, h)))


def multipolygon_box(polygons) -> Column:
    """Struct (lon_min, lon_max, lat_min, lat_max) over the outer rings."""
    vertices = F.flatten(F.transform(polygons, lambda rings: rings[0]))
    lons = F.transform(vertices, lambda p: p[0])
    lats = F.transform(vertices, lambda p: p[1])
    return F.struct(
        F.array_min(lons).alias("lon_min"), F.array_max(lons).alias("lon_max"),
        F.array_min(lats).alias("lat_min"), F.array_max(lats).alias("lat_max"),
    )


def in_box(lon, lat, box) -> Column:
    """Bounding-box containment, edges included; ``box`` is a struct of multipolygon_box."""
    return lon.between(box["lon_min"], box["lon_max"]) & lat.between(box["lat_min"], box["lat_max"])


# --- hierarchical square cells -----------------------------------------------------------------


def cell_x(lon, bits: int) -> Column:
    top = F.lit(2 ** bits - 1).cast("long")
    return F.least(top, F.floor((lon + 180.0) / 360.0 * float(2 ** bits)))


def cell_y(lat, bits: int) -> Column:
    top = F.lit(2 ** bits - 1).cast("long")
    return F.least(top, F.floor((lat + 90.0) / 180.0 * float(2 ** bits)))


def cell_key(x, y) -> Column:
    """One long per cell of a level, for equi joins."""
    return x * F.lit(2 ** CELL_BITS).cast("long") + y


def cell_id(lat, lon, res: int = 9) -> Column:
    """Square cell as text: ``q`` and one hex digit per resolution step (16 children each).

    Resolution 9 is about 115 m x 76 m at the city's latitude. Own scheme: ids are not comparable
    with other cell systems.
    """
    x, y = cell_x(lon, 2 * res), cell_y(lat, 2 * res)
    digits = []
    for step in range(res - 1, -1, -1):
        dx = F.shiftright(x, 2 * step).bitwiseAND(F.lit(3).cast("long"))
        dy = F.shiftright(y, 2 * step).bitwiseAND(F.lit(3).cast("long"))
        digits.append(F.lower(F.hex(dy * 4 + dx)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("q"), *digits))


def cell_parent(cell, res: int = 7) -> Column:
    """Coarser cell: ids are prefixes of their descendants. Anything else passes unchanged."""
    return F.when(cell.rlike(f"^q[0-9a-f]{{{res},}}$"), F.substring(cell, 1, res + 1)).otherwise(cell)
