"""Exact nearest-neighbour joins: radius search, vehicle matching, node snapping.

``nearest`` never pairs a query with every point of its neighbourhood. The points are summarised
as a pyramid of square cells (count and bounding box per cell). Queries walk down the pyramid
together, one join per level: a cell is replaced by its occupied children, then every query drops
the cells that cannot hold one of its k nearest points, judged by distance bounds of the boxes.
Only cells with at most LEAF points are opened. A cell with a third of all points is therefore
split until it is small, and a query far away from it discards it whole.

Points at the same place are reduced to the k smallest ids first, which keeps the result exact
because ties are broken by id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import geo
from kerbside.session import cut_lineage, once

LEAF = 32                 # open a cell once it holds at most this many points
ROOTS = 64                # the walk starts at the finest level with at most this many cells
BROADCAST_ROWS = 500_000  # narrow rows of about 100 bytes, counted before
STEP = 2                  # bits per axis and level: up to 16 children
_LEVELS = list(range(0, geo.CELL_BITS + 1, STEP))
_SLACK = 1e-3       # metres, absorbs rounding in the bounds
_RADIAN = math.pi / 180
_ZONES = 1 << 16    # more than the largest zone id


def _node(level) -> Column:
    """Cell of a level as one long (level, x, y), from the finest cell in columns x and y."""
    drop = F.lit(geo.CELL_BITS) - level
    shift = lambda c: F.call_function("shiftright", F.col(c), drop)
    width = 2 ** geo.CELL_BITS
    return level.cast("long") * F.lit(width * width) + shift("x") * F.lit(width) + shift("y")


# Bounds without trigonometry per cell: they are evaluated for every query and cell on the way.
# They are SQL text over the query's qlat, qlon, qcos (cosine of its latitude) and a cell's box;
# ``cos_max`` is the largest cosine of latitude inside the box. ``p`` prefixes the box columns.


def _lower_bound(p: str = "") -> str:
    """No point of the box is closer: the gap to its latitude band, and the one to its meridians.

    The way to a meridian d away is at least asin(cos(lat) sin d) >= cos(lat) (d - d^3/6).
    """
    turn = [f"abs(qlon - {p}{e}), 360D - abs(qlon - {p}{e})" for e in ("lon_min", "lon_max")]
    d = f"(if(qlon BETWEEN {p}lon_min AND {p}lon_max, 0D, least({turn[0]}, {turn[1]}, 90D)) * {_RADIAN}D)"
    band = f"(greatest({p}lat_min - qlat, qlat - {p}lat_max, 0D) * {_RADIAN}D)"
    return f"greatest({band}, qcos * ({d} - {d} * {d} * {d} / 6D)) * {S.EARTH_RADIUS_M}D"


def _upper_bound(p: str = "") -> str:
    """Every point of the box is within this: the straight way in degrees to the farthest corner.

    A degree of longitude counts with the largest cosine met on the way, 1 across the equator.
    """
    up = f"greatest(abs(qlat - {p}lat_min), abs(qlat - {p}lat_max))"
    same_side = f"qlat * {p}lat_min > 0 AND qlat * {p}lat_max > 0"
    across = (f"(greatest(abs(qlon - {p}lon_min), abs(qlon - {p}lon_max))"
              f" * if({same_side}, greatest(qcos, {p}cos_max), 1D))")
    return f"sqrt({up} * {up} + {across} * {across}) * {_RADIAN * S.EARTH_RADIUS_M}D"


_BOX = ["lat_min", "lat_max", "lon_min", "lon_max", "cos_max"]


def _pyramid(points: DataFrame) -> DataFrame:
    """One row per group, level and occupied cell: node, parent, cnt, box, cnt of the parent."""
    level = F.col("level")
    spread = points.withColumn("level", F.explode(F.lit(_LEVELS))).select(
        "grp", "lat", "lon", "level", _node(level).alias("node"),
        F.when(level > 0, _node(level - STEP)).otherwise(F.lit(-1)).alias("parent"))
    nodes = spread.groupBy("grp", "level", "node", "parent").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.max(F.cos(F.radians("lat"))).alias("cos_max"),
    )
    siblings = Window.partitionBy("grp", "parent", "level")  # at most 16 rows, one for the top
    return nodes.withColumn("parent_cnt", F.sum("cnt").over(siblings))


def _prune(cands: DataFrame, k: int) -> DataFrame:
    """Tighten every query's bound to where its k nearest points must lie, drop the cells beyond."""
    q = Window.partitionBy("qid")
    if k == 1:
        new = F.min("ub").over(q)
    else:
        running = q.orderBy("ub", "node").rowsBetween(Window.unboundedPreceding, 0)
        cands = cands.withColumn("_seen", F.sum("cnt").over(running))
        new = F.min(F.when(F.col("_seen") >= k, F.col("ub"))).over(q)
    cands = cands.withColumn("bound", F.least("bound", new))  # least skips a null
    return cands.where(F.col("lb") <= F.col("bound") + _SLACK).drop("_seen")


def _broadcast_upto(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint when the known number of rows is small; else a shuffle join with skew handling."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _roots(q: DataFrame, roots: DataFrame, n: int, k: int, radius_m: float | None) -> DataFrame:
    """Queries with the cells of the first level that may hold a neighbour.

    The cells of a group are one array, so bounding and dropping happens inside the row. Up to
    ROOTS cells in all travel in the plan as a value; beyond that (very many groups) they are joined.
    """
    lists = roots.groupBy("grp").agg(F.collect_list(F.struct("node", "cnt", *_BOX)).alias("cells"))
    if n <= ROOTS:
        table = lists.agg(F.map_from_entries(F.collect_list(F.struct("grp", "cells")))).scalar()
        q = q.withColumn("cells", F.try_element_at(table, F.col("grp")))
    else:
        q = q.join(lists, "grp")
    fields = ", ".join(f"c.{x} AS {x}" for x in ("node", "cnt", *_BOX))
    q = q.withColumn("cells", F.expr(
        f"transform(cells, c -> struct({fields}, {_lower_bound('c.')} AS lb, {_upper_bound('c.')} AS ub))"))
    if k == 1:
        q = q.withColumn("bound", F.array_min(F.transform("cells", lambda c: c["ub"])))
    else:
        by_reach = F.array_sort(F.transform("cells", lambda c: F.struct(c["ub"].alias("ub"), c["cnt"].alias("cnt"))))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("ub"))
        step = lambda acc, c: F.when(acc["seen"] >= k, acc).otherwise(F.struct(
            (acc["seen"] + c["cnt"]).alias("seen"),
            F.when(acc["seen"] + c["cnt"] >= k, c["ub"]).alias("ub")))
        q = q.withColumn("bound", F.aggregate(by_reach, start, step)["ub"])
    reach = F.coalesce(F.col("bound"), F.lit(float("inf")))
    if radius_m is not None:
        reach = F.least(reach, F.lit(float(radius_m)))
    q = q.withColumn("bound", reach)
    kept = F.filter("cells", lambda c: c["lb"] <= F.col("bound") + _SLACK)
    return q.select("qid", "grp", "qlat", "qlon", "qcos", "bound", F.explode(kept).alias("c")).select(
        "qid", "grp", "qlat", "qlon", "qcos", "bound", "c.*")


def nearest(queries: DataFrame, points: DataFrame, k: int = 1,
            radius_m: float | None = None) -> DataFrame:
    """The k nearest points per query, exact, ties broken by the smaller id.

    ``queries``: qid, lat, lon and optionally grp; a query may appear once per group.
    ``points``: pid, lat, lon and optionally grp; a query sees the points of its groups only.
    Returns qid, pid, grp, lat, lon (of the point), distance_m, rank. Queries without a hit give
    no row. The points are written once (reliable checkpoint), since every level reads them. Groups of at
    most LEAF points, e.g. the vehicles of a zone at one instant, are met without a pyramid.
    """
    if "grp" not in points.columns:
        points = points.withColumn("grp", F.lit(0))
        queries = once(queries, "grp", F.lit(0))  # a known value would make the join by group a nested loop
    usable = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("grp").isNotNull()
    points = points.where(usable).select("grp", "pid", "lat", "lon")
    place = Window.partitionBy("grp", "lat", "lon").orderBy("pid")
    # rank <= k is pushed below the shuffle (window group limit), so a crowded place stays small
    points = points.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r")
    points = points.withColumns({
        "x": geo.cell_x(F.col("lon"), geo.CELL_BITS), "y": geo.cell_y(F.col("lat"), geo.CELL_BITS)})
    points = cut_lineage(points)
    q = queries.where(usable).select("qid", "grp", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"),
                                     F.cos(F.radians("lat")).alias("qcos"))
    counts = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") > LEAF
    groups, crowded = counts.agg(F.count(F.lit(1)), F.count_if(large)).first()
    if not groups:
        return _empty_result(queries, points)
    hits = None
    if crowded < groups:  # a group of a leaf's size needs no pyramid: its points are met at once
        few = points
        if crowded:
            big = cut_lineage(counts.where(large).select("grp"))
            few, points = (points.join(_broadcast_upto(big, crowded), "grp", how) for how in ("left_anti", "left_semi"))
        few = few.select(F.col("grp").alias("p_grp"), "pid", "lat", "lon")
        hits = _hits(q.withColumn("bound", F.lit(float("inf"))), F.broadcast(few) if groups == 1 else few,
                     F.col("grp") == F.col("p_grp"))
    if crowded:
        walked = _walk(q, points, k, radius_m)
        hits = walked if hits is None else hits.unionByName(walked)
    if radius_m is not None:
        hits = hits.where(F.col("distance_m") <= radius_m)
    if k == 1:
        best = hits.groupBy("qid").agg(
            F.min_by(F.struct("pid", "grp", "lat", "lon", "distance_m"),
                     F.struct("distance_m", "pid")).alias("b"))
        return best.select("qid", "b.*", F.lit(1).alias("rank"))
    order = Window.partitionBy("qid").orderBy("distance_m", "pid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _hits(cands: DataFrame, members: DataFrame, on: Column) -> DataFrame:
    """Queries with the points of the cells left to them, within their bound."""
    return (
        cands.join(members, on)
        .withColumn("distance_m", geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")))
        .where(F.col("distance_m") <= F.col("bound") + _SLACK)
        .select("qid", "pid", "grp", "lat", "lon", "distance_m")
    )


def _walk(q: DataFrame, points: DataFrame, k: int, radius_m: float | None) -> DataFrame:
    """Hits of the queries (qid, grp, qlat, qlon, qcos) in groups larger than a leaf, down the pyramid."""
    nodes = cut_lineage(_pyramid(points))

    stats = {r["level"]: (r["n"], r["top"], r["points"]) for r in
             nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("cnt").alias("top"),
                                        F.sum("cnt").alias("points")).collect()}  # one row per level
    start = max([z for z in _LEVELS if stats[z][0] <= ROOTS], default=0)
    stop = min([z for z in _LEVELS if z >= start and stats[z][1] <= LEAF], default=_LEVELS[-1])

    cands = _roots(q, nodes.where(F.col("level") == start), stats[start][0], k, radius_m)
    if start < stop:
        cands = _prune(cands, k)

    for level in range(start + STEP, stop + 1, STEP):
        kids = nodes.where((F.col("level") == level) & (F.col("parent_cnt") > LEAF)).select(
            F.col("grp").alias("k_grp"), F.col("parent").alias("k_parent"),
            F.col("node").alias("k_node"), F.col("cnt").alias("k_cnt"),
            *[F.col(c).alias(f"k_{c}") for c in _BOX],
        )
        # cells that are small enough already have no kids here and pass through
        opened = cands.join(
            _broadcast_upto(kids, stats[level][0]),
            (F.col("grp") == F.col("k_grp")) & (F.col("node") == F.col("k_parent")), "left")
        cands = opened.selectExpr(
            "qid", "grp", "qlat", "qlon", "qcos", "bound",
            *[f"coalesce(k_{c}, {c}) AS {c}" for c in ("node", "cnt", *_BOX)],
        ).selectExpr("*", f"{_lower_bound()} AS lb", f"{_upper_bound()} AS ub")
        # most kids fall to the bound of the level above, before anything is shuffled by query
        cands = _prune(cands.where(F.col("lb") <= F.col("bound") + _SLACK), k)

    levels = list(range(start, stop + 1, STEP))
    members = points.withColumn("level", F.explode(F.lit(levels))).select(
        F.col("grp").alias("p_grp"), "pid", "lat", "lon", _node(F.col("level")).alias("p_node"))
    return _hits(cands.select("qid", "grp", "qlat", "qlon", "qcos", "bound", "node"),
                 _broadcast_upto(members, stats[start][2] * len(levels)),
                 (F.col("grp") == F.col("p_grp")) & (F.col("node") == F.col("p_node")))


def _empty_result(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Right columns, no rows."""
    return queries.select("qid").limit(0).join(points.limit(0), F.lit(False)).select(
        "qid", "pid", "grp", "lat", "lon", F.lit(0.0).alias("distance_m"), F.lit(1).alias("rank"))


# --- vehicle search ----------------------------------------------------------------------------


def _per_place(df: DataFrame, place: list[str], search: Callable[[DataFrame], DataFrame],
               how: str = "left") -> DataFrame:
    """Search every distinct place once and give the result to all rows at that place.

    Requests crowd at the same spots (ranks, stations, zone centres standing in for missing
    coordinates). ``search`` gets the places with a ``qid`` and returns ``qid`` and result columns.
    """
    places = df.select(*place).distinct().withColumn("qid", F.struct(*place))
    found = search(places)
    result = [c for c in found.columns if c != "qid"]
    found = found.select(*[F.col(f"qid.{c}").alias(c) for c in place], *result)
    return df.join(found, place, how)


def nearby(searches: DataFrame, drivers: DataFrame, radius_m: float = 2000.0,
           limit: int = 50) -> DataFrame:
    """Drivers within the radius of every search point, nearest first, at most ``limit`` hits.

    searches: search_id, lat, lon. drivers: driver_id, lat, lon (latest positions).
    """
    points = drivers.select(F.col("driver_id").alias("pid"), "lat", "lon")

    def search(places):
        found = nearest(places.select("qid", F.col("at_lat").alias("lat"), F.col("at_lon").alias("lon")),
                        points, k=limit, radius_m=radius_m)
        return found.select("qid", F.col("pid").alias("driver_id"),
                            F.round("distance_m", 2).alias("distance_meters"), "lat", "lon", "rank")

    at = searches.select("search_id", F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon"))
    return _per_place(at, ["at_lat", "at_lon"], search, "inner").drop("at_lat", "at_lon")


def match_nearest(requests: DataFrame, positions: DataFrame, instant: str | None = None) -> DataFrame:
    """Nearest available vehicle over the origin zone and its neighbours.

    requests: trip_id, rider_id, origin_zone, destination_zone, origin_lat, origin_lon.
    positions: one row per vehicle (taxi_id, zone_id, lat, lon, status), see latest_per_key; with
    ``instant``, a whole-number column of both, one row per vehicle and instant, and a request sees
    those of its own instant. Missing pickup coordinates fall back to the centre of the origin zone.
    A request without a vehicle gives NO_TAXI_AVAILABLE.
    """
    known = F.col("origin_lat").isNotNull() & F.col("origin_lon").isNotNull()
    lat0, lon0 = geo.zone_center(F.col("origin_zone"))
    pickup = requests.withColumns({
        "pickup_lat": F.when(known, F.col("origin_lat")).otherwise(lat0),
        "pickup_lon": F.when(known, F.col("origin_lon")).otherwise(lon0),
    })
    base = F.lit(0).cast("long") if instant is None else F.col(instant) * _ZONES
    vehicles = positions.where(F.col("status") == "available").select(
        F.col("taxi_id").alias("pid"), (base + F.col("zone_id")).alias("grp"), "lat", "lon")

    def search(places):
        queries = places.select("qid", F.col("pickup_lat").alias("lat"), F.col("pickup_lon").alias("lon"),
                                base.alias("_base"), F.explode(geo.adjacent_zones(F.col("origin_zone"))).alias("_zone"))
        queries = queries.select("qid", "lat", "lon", (F.col("_base") + F.col("_zone")).alias("grp"))
        return nearest(queries, vehicles).select(
            "qid", F.col("pid").alias("driver_id"), F.pmod("grp", F.lit(_ZONES)).cast("int").alias("matched_zone"), "distance_m")

    place = ["origin_zone", "pickup_lat", "pickup_lon", *([instant] if instant else [])]
    return _match_rows(_per_place(pickup, place, search))


def _match_rows(matched: DataFrame) -> DataFrame:
    hit = F.col("driver_id").isNotNull()
    return matched.select(
        "trip_id", "driver_id", "rider_id",
        F.round("distance_m", 1).alias("distance_meters"),
        F.when(hit, geo.eta_seconds(F.col("distance_m"))).alias("eta_seconds"),
        "origin_zone", "destination_zone", "matched_zone",
        F.when(hit, "MATCHED").otherwise("NO_TAXI_AVAILABLE").alias("status"),
    )


def pickup_origin(lat, lon, zone) -> tuple[Column, Column]:
    """Exact coordinates, else centre of zone 1..16, else centre of zone 1."""
    known = lat.isNotNull() & lon.isNotNull()
    usable_zone = F.when(zone.between(1, S.GRID_COLS * S.GRID_ROWS), zone).otherwise(F.lit(1))
    lat0, lon0 = geo.zone_center(usable_zone)
    return F.when(known, lat).otherwise(lat0), F.when(known, lon).otherwise(lon0)


def match_within_radius(requests: DataFrame, drivers: DataFrame, radius_m: float = 5000.0) -> DataFrame:
    """Nearest driver inside the radius, distance rounded to 2 places and ETA; unmatched stay."""
    lat, lon = pickup_origin(F.col("origin_lat"), F.col("origin_lon"), F.col("origin_zone"))
    points = drivers.select(F.col("driver_id").alias("pid"), "lat", "lon")

    def search(places):
        return nearest(places, points, radius_m=radius_m).select(
            "qid", F.col("pid").alias("driver_id"), F.round("distance_m", 2).alias("distance_meters"))

    at = requests.select("trip_id", "origin_zone", "destination_zone", lat.alias("lat"), lon.alias("lon"))
    eta = F.when(F.col("driver_id").isNotNull(), geo.eta_seconds(F.col("distance_meters")))
    return _per_place(at, ["lat", "lon"], search).select(
        "trip_id", "driver_id", "distance_meters", eta.alias("eta_seconds"), "origin_zone", "destination_zone")


def snap_to_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nearest road node of every point. points: point_id, lat, lon; nodes: node_id, lat, lon."""
    targets = nodes.select(F.col("node_id").alias("pid"), "lat", "lon")

    def search(places):
        return nearest(places, targets).select("qid", F.col("pid").alias("node_id"), "distance_m")

    return _per_place(points.select("point_id", "lat", "lon"), ["lat", "lon"], search, "inner").select(
        "point_id", "node_id", "distance_m")


def snap_trips(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """Origin and destination node per trip; trips whose ends share a node are dropped.

    trips: trip_id, start_lat, start_lon, end_lat, end_lon.
    """
    ends = trips.select("trip_id", F.explode(F.array(
        F.struct(F.lit("o").alias("end"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")),
        F.struct(F.lit("d").alias("end"), F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")),
    )).alias("e")).select(F.struct("trip_id", "e.end").alias("point_id"), "e.lat", "e.lon")
    snapped = snap_to_node(ends, nodes)
    return (
        snapped.groupBy(F.col("point_id.trip_id").alias("trip_id"))
        .agg(F.max(F.when(F.col("point_id.end") == "o", F.col("node_id"))).alias("origin_node"),
             F.max(F.when(F.col("point_id.end") == "d", F.col("node_id"))).alias("dest_node"))
        .where(F.col("origin_node") != F.col("dest_node"))
    )


def driver_index(positions: DataFrame, departures: DataFrame) -> DataFrame:
    """Latest point per driver, without the drivers that left after their last ping.

    positions: driver_id, ts, lat, lon. departures: driver_id, departed_at.
    """
    latest = positions.groupBy("driver_id").agg(
        F.max_by(F.struct("lat", "lon"), F.struct("ts", "lat", "lon")).alias("p"), F.max("ts").alias("ts"))
    left = departures.groupBy("driver_id").agg(F.max("departed_at").alias("departed_at"))
    return (
        latest.join(left, "driver_id", "left")
        .where(F.col("departed_at").isNull() | (F.col("departed_at") < F.col("ts")))
        .select("driver_id", "ts", "p.lat", "p.lon")
    )


def fleet_box(points: DataFrame) -> DataFrame:
    """Bounding box of a point set as one row."""
    return points.agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
                      F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))
