"""Zone dimension and point-in-polygon joins.

A zones frame has zone_order (int, first match wins), zone_id, zone_name and polygons (multipolygon
coordinates, [lon, lat]). Polygons are covered by square cells, so assigning points is an equi join
on the cell and an exact test, never a nested loop over all polygons.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo, scalars
from kerbside.operators.tables import latest_per_key
from kerbside.session import broadcast_if_small, cut_lineage, once

_COVER = 8  # a polygon's box spans at most this many cells per axis at its own level


def _level_for(box) -> Column:
    """Finest level (bits) at which the box spans at most _COVER - 1 cell widths per axis."""
    width = F.greatest((box["lon_max"] - box["lon_min"]) / 360.0,
                       (box["lat_max"] - box["lat_min"]) / 180.0, F.lit(2.0 ** -geo.CELL_BITS))
    bits = F.floor(F.log2(F.lit(float(_COVER - 1)) / width)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(geo.CELL_BITS), bits))


def _dealt(zones: DataFrame) -> DataFrame:
    """Zones dealt to all cores: a zone is a few hundred bytes but gives dozens of cells, so a file of
    zones that is one split would be covered by one task."""
    return zones.repartition(4 * zones.sparkSession.sparkContext.defaultParallelism)


def _cell_at(level: Column, lat, lon) -> Column:
    drop = F.lit(geo.CELL_BITS) - level
    at = lambda v: F.call_function("shiftright", v, drop)
    return geo.cell_key(at(geo.cell_x(lon, geo.CELL_BITS)), at(geo.cell_y(lat, geo.CELL_BITS)))


def _box_cells(df: DataFrame) -> DataFrame:
    """Rows with _box and _level, once for every cell of the level that the box touches."""
    box = F.col("_box")
    drop = F.lit(geo.CELL_BITS) - F.col("_level")
    at = lambda v: F.call_function("shiftright", v, drop)
    xs = F.sequence(at(geo.cell_x(box["lon_min"], geo.CELL_BITS)), at(geo.cell_x(box["lon_max"], geo.CELL_BITS)))
    ys = F.sequence(at(geo.cell_y(box["lat_min"], geo.CELL_BITS)), at(geo.cell_y(box["lat_max"], geo.CELL_BITS)))
    cells = df.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys))
    return cells.withColumn("_cell", geo.cell_key(F.col("_x"), F.col("_y"))).drop("_x", "_y")


_BROADCAST_VERTICES = 1_000_000  # about 50 MB of edges
_STEP = 3  # levels of the tree: every third, 64 children a node
_NOWHERE = -1  # level and cell of points outside all zones


@dataclass(frozen=True)
class ZoneCover:
    """Zones prepared for joins. ``cells`` are the leaves of a tree of cells that part the box of all
    zones, with the zones that reach into each, in order; ``weight`` counts cells and their edges.
    Built once, it serves any number of joins, e.g. every micro-batch of a stream."""

    cells: DataFrame
    levels: tuple[int, ...]
    box: tuple[float, float, float, float] | None
    weight: int
    exact: bool


def _cell_box(level, cell) -> Column:
    """Box of a cell, a hundredth larger on all sides against rounding."""
    x, y = F.shiftright(cell, geo.CELL_BITS), cell.bitwiseAND(F.lit(2 ** geo.CELL_BITS - 1))
    wide, high = 360.0 / F.pow(F.lit(2.0), level), 180.0 / F.pow(F.lit(2.0), level)
    return F.struct(((x - 0.01) * wide - 180.0).alias("lon_min"), ((x + 1.01) * wide - 180.0).alias("lon_max"),
                    ((y - 0.01) * high - 90.0).alias("lat_min"), ((y + 1.01) * high - 90.0).alias("lat_max"))


def _ancestor(cell, down) -> Column:
    """The cell ``down`` levels above."""
    at = lambda v: F.call_function("shiftright", v, down.cast("int"))
    return geo.cell_key(at(F.shiftright(cell, geo.CELL_BITS)), at(cell.bitwiseAND(F.lit(2 ** geo.CELL_BITS - 1))))


def _touches(e, c) -> Column:
    """The edge may touch the box: their boxes meet and the box has no side of the edge's line to itself."""
    side = [(e["bx"] - e["ax"]) * (c[y] - e["ay"]) - (e["by"] - e["ay"]) * (c[x] - e["ax"])
            for x in ("lon_min", "lon_max") for y in ("lat_min", "lat_max")]
    return ((F.greatest(e["ax"], e["bx"]) >= c["lon_min"]) & (F.least(e["ax"], e["bx"]) <= c["lon_max"])
            & (F.greatest(e["ay"], e["by"]) >= c["lat_min"]) & (F.least(e["ay"], e["by"]) <= c["lat_max"])
            & (F.least(*side) <= 0) & (F.greatest(*side) >= 0))


def _classified(cells: DataFrame, exact: bool) -> DataFrame:
    """Rows (_level, _cell, zone, _box, _edges) of cells and zones: ``_inner`` if the zone holds the
    whole cell, else the edges that matter within it; cells outside the zone are left out."""
    c, box = F.col("_c"), F.col("_box")
    cells = cells.withColumn("_c", _cell_box(F.col("_level"), F.col("_cell")))
    if not exact:
        apart = ((box["lon_min"] > c["lon_max"]) | (box["lon_max"] < c["lon_min"])
                 | (box["lat_min"] > c["lat_max"]) | (box["lat_max"] < c["lat_min"]))
        whole = geo.in_box(c["lon_min"], c["lat_min"], box) & geo.in_box(c["lon_max"], c["lat_max"], box)
        return cells.where(~apart).withColumn("_inner", whole).drop("_c")
    near = F.transform("_edges", lambda rings: F.transform(rings, lambda ring: F.filter(
        ring, lambda e: (F.greatest(e["ay"], e["by"]) >= c["lat_min"]) & (F.least(e["ay"], e["by"]) <= c["lat_max"])
        & (F.greatest(e["ax"], e["bx"]) >= c["lon_min"]))))
    cells = once(cells.drop("_near"), "_near", near)
    border = F.exists(F.flatten(F.flatten("_near")), lambda e: _touches(e, c))
    centre = geo.point_in_edges((c["lon_min"] + c["lon_max"]) / 2, (c["lat_min"] + c["lat_max"]) / 2, F.col("_near"))
    kind = F.when(border, F.lit("border")).when(centre, F.lit("inner")).otherwise(F.lit("outside"))
    cells = once(cells, "_kind", kind).where("_kind <> 'outside'").withColumn("_inner", F.col("_kind") == "inner")
    return cells.withColumn("_edges", F.when(~F.col("_inner"), F.col("_near"))).drop("_c", "_near", "_kind")


def _up_to_whole(cover: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the cover up to the first zone, in order, that holds its whole cell: no point of the cell
    asks for later ones. The first zones are a combining aggregate, so what a cell collects is bounded
    by the zones before its first one, however many zones lie on top of each other."""
    zone = F.struct(*names)
    firsts = cover.where("_inner").groupBy("_level", "_cell").agg(F.min(zone).alias("_first"))
    kept = cover.join(broadcast_if_small(firsts, 500_000), ["_level", "_cell"], "left")
    return kept.where(F.col("_first").isNull() | (zone <= F.col("_first"))).drop("_first")


def _leaves(cover: DataFrame, levels: tuple[int, ...], roots: DataFrame) -> DataFrame:
    """(_level, _cell) of the leaves: every node above a cell of the cover has all its children."""
    steps = F.array(*[F.lit(n) for n in levels])
    level, cell = F.col("_level"), F.col("_cell")
    above = cover.select("_level", "_cell").distinct().withColumn("_up", F.explode(F.filter(steps, lambda n: n < level)))
    above = cut_lineage(above.select(F.col("_up").alias("_level"), _ancestor(cell, level - F.col("_up")).alias("_cell")).distinct())
    side = 2 ** _STEP
    x, y = F.shiftright(cell, geo.CELL_BITS) * side, cell.bitwiseAND(F.lit(2 ** geo.CELL_BITS - 1)) * side
    children = above.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))).select(
        (level + _STEP).alias("_level"),
        geo.cell_key(x + F.floor(F.col("_i") / side), y + F.col("_i") % side).alias("_cell"))
    return roots.unionByName(children).join(above, ["_level", "_cell"], "left_anti")


def zone_cover(zones: DataFrame, exact: bool = True) -> ZoneCover:
    """Cover of the zones by a tree of cells, checkpointed.

    A zone is first covered by cells of about its own size; where small zones lie, cells are parted
    further, so that every point of the box of all zones lies in one leaf. A leaf lists the zones that
    reach into it, in order, up to the first one that holds it whole; a zone whose border passes
    through keeps only the edges that a point of the leaf must be tested against.
    """
    names = ["zone_order", "zone_id", "zone_name"]
    edges = F.transform("polygons", lambda rings: F.transform(rings, geo.ring_edges))
    if not exact:  # boxes only
        edges = F.when(F.lit(False), edges)
    z = _dealt(zones).select(*names, geo.multipolygon_box(F.col("polygons")).alias("_box"), edges.alias("_edges"))
    z = z.where("_box.lon_min is not null").withColumn("_fit", _level_for(F.col("_box")))
    w, e, s, n, deepest = z.agg(F.min("_box.lon_min"), F.max("_box.lon_max"), F.min("_box.lat_min"),
                                F.max("_box.lat_max"), F.max("_fit")).first()
    if w is None:
        return ZoneCover(z, (), None, 0, exact)
    width = max((e - w) / 360.0, (n - s) / 180.0, 2.0 ** -geo.CELL_BITS)
    base = max(0, min(geo.CELL_BITS, math.floor(math.log2((_COVER - 1) / width))))
    levels = tuple(range(base, min(geo.CELL_BITS, max(deepest, base) + 1) + 1, _STEP))
    fit = F.lit(base) + F.lit(_STEP) * F.round((F.col("_fit") - base) / _STEP).cast("int")
    cells = _box_cells(z.withColumn("_level", F.greatest(F.lit(base), F.least(F.lit(levels[-1]), fit))))
    cover = cut_lineage(_classified(cells.select("_level", "_cell", *names, "_box", "_edges"), exact))
    cover = cut_lineage(_up_to_whole(cover, names))

    one = zones.sparkSession.range(1).select(F.lit(base).alias("_level"), F.struct(
        *[F.lit(float(v)).alias(k) for k, v in zip(("lon_min", "lon_max", "lat_min", "lat_max"), (w, e, s, n))]).alias("_box"))
    leaves = _leaves(cover, levels, _box_cells(one).select("_level", "_cell"))
    ways = leaves.withColumn("_up", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v <= F.col("_level"))))
    ways = ways.withColumn("_top", _ancestor(F.col("_cell"), F.col("_level") - F.col("_up")))
    above = cover.withColumnsRenamed({"_level": "_up", "_cell": "_top"})
    whole = above.where("_inner").select("_up", "_top", F.struct(*names).alias("_zone"))
    firsts = ways.join(whole, ["_up", "_top"]).groupBy("_level", "_cell").agg(F.min("_zone").alias("_first"))
    ways = ways.join(broadcast_if_small(firsts, 500_000), ["_level", "_cell"], "left")
    ways = ways.repartition(4 * zones.sparkSession.sparkContext.defaultParallelism, "_level", "_cell")  # few bytes, much work a row
    met = ways.join(above, ["_up", "_top"], "left")  # a leaf without zones keeps its own row
    met = met.where(F.col("_first").isNull() | F.col("_inner").isNull() | (F.struct(*names) <= F.col("_first")))
    columns = ["_level", "_cell", *names, "_box", "_edges", "_inner"]
    known = F.coalesce("_inner", F.lit(True)) | (F.col("_up") == F.col("_level"))
    cut = _classified(met.where(~known).select(*columns[:-1]), exact)
    zone = F.when(F.col("_inner").isNotNull(), F.struct(*names, "_inner", "_box", "_edges"))
    lists = met.where(known).select(*columns).unionByName(cut).groupBy("_level", "_cell").agg(
        F.array_sort(F.collect_list(zone)).alias("_zones"))
    first = F.array_position(F.transform("_zones", lambda v: v["_inner"]), True)  # 0 if none
    lists = lists.withColumn("_zones", F.slice("_zones", F.lit(1), F.when(first > 0, first.cast("int")).otherwise(F.size("_zones"))))
    nowhere = one.select(F.lit(_NOWHERE).alias("_level"), F.lit(_NOWHERE).cast("long").alias("_cell"))
    kept = cut_lineage(lists.unionByName(nowhere, allowMissingColumns=True))
    size = F.aggregate("_zones", F.lit(1).cast("long"), lambda acc, v: acc + 1 + F.coalesce(
        F.size(F.flatten(F.flatten(v["_edges"]))), F.lit(0)))
    weight = kept.agg(F.sum(F.coalesce(size, F.lit(1).cast("long")))).first()[0]
    return ZoneCover(kept, levels, (w, e, s, n), weight, exact)


def assign_zone_polygon(points: DataFrame, zones: DataFrame | ZoneCover, how: str = "left",
                        exact: bool = True) -> DataFrame:
    """Add zone_id and zone_name of the first zone (by zone_order) that holds the point.

    ``how="left"`` keeps points outside every zone, or without coordinates, as 0 / "Unknown",
    ``"inner"`` drops them. ``exact=False`` stops at the bounding box; a cover built before says
    itself which it is for. A point asks for its cell on every level of the cover and meets exactly
    one leaf, so there is one join, and neither an aggregate nor a second shuffle. A cover of bounded
    size is broadcast and points aren't shuffled. The same form for any zones, batch or stream.
    """
    cover = zones if isinstance(zones, ZoneCover) else zone_cover(zones, exact)
    lon, lat = F.col("lon"), F.col("lat")

    def holds(z):
        tested = geo.in_box(lon, lat, z["_box"])
        if cover.exact:
            tested = F.when(tested, geo.point_in_edges(lon, lat, z["_edges"])).otherwise(False)
        return F.when(z["_inner"], True).otherwise(tested)

    if cover.box:
        spot = lambda level, cell: F.struct(F.lit(level).alias("level"), cell.alias("cell"))
        w, e, s, n = cover.box
        spots = F.when(lon.between(w, e) & lat.between(s, n), F.array(
            *[spot(v, _cell_at(F.lit(v), lat, lon)) for v in cover.levels])).otherwise(
            F.array(spot(_NOWHERE, F.lit(_NOWHERE).cast("long"))))
        cells = F.broadcast(cover.cells) if cover.weight <= _BROADCAST_VERTICES else cover.cells
        out = points.withColumn("_spot", F.explode(spots)).join(
            cells, (F.col("_spot.level") == F.col("_level")) & (F.col("_spot.cell") == F.col("_cell")))
        out = once(out, "_zone", F.get(F.transform(F.filter("_zones", holds), _label), F.lit(0)))
    else:
        out = points.withColumn("_zone", F.lit(None).cast("struct<zone_id:int,zone_name:string>"))
    if how == "inner":
        out = out.where(F.col("_zone").isNotNull() & (F.col("_zone.zone_id") != 0))
    return out.select(
        *[F.col(c) for c in points.columns],
        F.coalesce(F.col("_zone.zone_id"), F.lit(0)).alias("zone_id"),
        F.coalesce(F.col("_zone.zone_name"), F.lit("Unknown")).alias("zone_name"),
    )


def _label(z) -> Column:
    return F.struct(z["zone_order"].alias("zone_order"), z["zone_id"].alias("zone_id"),
                    z["zone_name"].alias("zone_name"))


def assign_zone_grid(points: DataFrame, mode: str = "reject") -> DataFrame:
    """Grid fallback: zone of the 4 x 4 grid, ``Grid-n`` as name; ``reject`` drops outside points."""
    prefix = "Grid-" if mode == "reject" else "Zone-"
    out = points.withColumn("zone_id", geo.grid_zone(F.col("lat"), F.col("lon"), mode))
    return out.where(F.col("zone_id").isNotNull()).withColumn(
        "zone_name", F.concat(F.lit(prefix), F.col("zone_id").cast("string")))


def zones_from_features(features: DataFrame) -> DataFrame:
    """GeoJSON features (Arrondissement, Prefecture, Population, geometry) to the zones frame."""
    name = scalars.clean_zone_name(F.coalesce(F.col("raw_name"), F.lit("Unknown")))
    return features.select(
        "zone_order", scalars.zone_id_of(name).alias("zone_id"), name.alias("zone_name"),
        F.coalesce("prefecture", F.lit("Unknown")).alias("prefecture"),
        F.coalesce("population", F.lit(0).cast("long")).alias("population"), "polygons",
    )


def zone_names(zones: DataFrame) -> DataFrame:
    return zones.select("zone_id", "zone_name")


def choropleth(zones: DataFrame, demand: DataFrame) -> DataFrame:
    """Every zone with its latest demand ratio (0 when none) and map colour."""
    newest = latest_per_key(demand.select("zone_id", "window_start", "ratio"), ["zone_id"], ["window_start"])
    ratio = F.coalesce(F.col("ratio"), F.lit(0.0))
    return zones.select("zone_id", "zone_name").join(newest.select("zone_id", "ratio"), "zone_id", "left").select(
        "zone_id", "zone_name", ratio.alias("ratio"), scalars.ratio_color(ratio).alias("color"),
        scalars.ratio_color(ratio).alias("fill"), F.lit(0.6).alias("fill_opacity"))


def _orientation(a, b, c) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def segments_meet(p1, p2, q1, q2) -> Column:
    """Closed segments share a point: their boxes meet and neither lies on one side of the other's line.
    Arguments have x and y. Kept short, as a join's condition must stay small enough to be compiled."""
    o1, o2 = _orientation(p1, p2, q1), _orientation(p1, p2, q2)
    o3, o4 = _orientation(q1, q2, p1), _orientation(q1, q2, p2)
    boxes = [(F.least(p1[c], p2[c]) <= F.greatest(q1[c], q2[c])) & (F.least(q1[c], q2[c]) <= F.greatest(p1[c], p2[c])) for c in "xy"]
    return boxes[0] & boxes[1] & (o1 * o2 <= 0) & (o3 * o4 <= 0)


def _cells_crossed(segs: DataFrame, bits: int) -> DataFrame:
    """One row per segment (p, q) and cell it passes: for each column of cells the rows between the
    heights at which the segment enters and leaves it, so a long diagonal has as many cells as columns
    and rows together. A hundredth of a cell is added on all sides against rounding."""
    p, q = F.col("p"), F.col("q")
    west, east = F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])
    wide, high = 360.0 / 2 ** bits, 180.0 / 2 ** bits
    columns = segs.withColumn("cx", F.explode(F.sequence(geo.cell_x(west, bits), geo.cell_x(east, bits))))
    left = F.col("cx") * wide - 180.0 - wide / 100
    slope = F.when(p["x"] != q["x"], (q["y"] - p["y"]) / (q["x"] - p["x"]))
    at = lambda x: p["y"] + (x - p["x"]) * slope
    enter = F.coalesce(at(F.greatest(west, left)), p["y"])
    leave = F.coalesce(at(F.least(east, left + wide * 1.02)), q["y"])
    low, top = F.least(enter, leave) - high / 100, F.greatest(enter, leave) + high / 100
    rows = columns.withColumn("cy", F.explode(F.sequence(geo.cell_y(low, bits), geo.cell_y(top, bits))))
    return rows.withColumn("cell", geo.cell_key(F.col("cx"), F.col("cy"))).drop("cx", "cy")


_SIDE = 4_096  # zones of a cell that are met with as many others as one block
_TASKS = 4_096  # at most so many tasks join blocks
_EDGE_PAIRS = 100_000  # pairs of edges up to which two zones are compared edge by edge
_SIDES = "wesn"
_PARTS = ("_out0", "_out1", "_in0", "_in1")


def _rect(w, e, s, n) -> Column:
    return F.struct(w.alias("w"), e.alias("e"), s.alias("s"), n.alias("n"))


def _meet(a, b) -> Column:
    """Closed rectangles share a point."""
    return (a["w"] <= b["e"]) & (b["w"] <= a["e"]) & (a["s"] <= b["n"]) & (b["s"] <= a["n"])


def _slab(edges, s, n) -> Column:
    """Rectangle around what lies between two latitudes; without width where nothing does. Where a slanting
    edge is cut a nanodegree is added against rounding."""
    def ends(e):
        up, down = F.greatest(e["ay"], e["by"]), F.least(e["ay"], e["by"])
        at = lambda y: e["ax"] + (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"])
        low, high = at(F.greatest(down, s)), at(F.least(up, n))
        slanting = F.when((e["ax"] != e["bx"]) & (up != down), F.struct(
            (F.least(low, high) - 1e-9).alias("w"), (F.greatest(low, high) + 1e-9).alias("e")))
        return F.coalesce(slanting, F.struct(F.least(e["ax"], e["bx"]).alias("w"), F.greatest(e["ax"], e["bx"]).alias("e")))

    def bounds(met):
        return _rect(F.array_min(F.transform(met, lambda v: v["w"])), F.array_max(F.transform(met, lambda v: v["e"])), s, n)

    within = F.filter(edges, lambda e: (F.greatest(e["ay"], e["by"]) > s) & (F.least(e["ay"], e["by"]) < n))
    return geo.let(F.transform(within, ends), bounds)


def _held(a, b, edges) -> Column:
    """The two slabs have all ends of edges, and one of them has all of an edge that runs along where they meet."""
    inside = lambda r, x, y: (x >= r["w"]) & (x <= r["e"]) & (y >= r["s"]) & (y <= r["n"])
    whole = lambda r, e: inside(r, e["ax"], e["ay"]) & inside(r, e["bx"], e["by"])
    ends = lambda e: reduce(and_, [inside(a, e[v + "x"], e[v + "y"]) | inside(b, e[v + "x"], e[v + "y"]) for v in "ab"])
    return F.forall(edges, lambda e: F.coalesce(F.when(e["ay"] == e["by"], whole(a, e) | whole(b, e)).otherwise(ends(e)), F.lit(False)))


def _core(rect, polygons, edges) -> Column:
    """The rectangle, or else a smaller one about its middle, if the zone holds it whole: no edge passes
    through and the middle lies inside. A rectangle that meets nothing where none does."""
    def shrunk(by):
        x, y = (rect["w"] + rect["e"]) / 2, (rect["s"] + rect["n"]) / 2
        wide, high = (rect["e"] - rect["w"]) / 2 * by, (rect["n"] - rect["s"]) / 2 * by
        return rect if by == 1.0 else _rect(x - wide, x + wide, y - high, y + high)

    def clear(r, e):
        side = [(e["bx"] - e["ax"]) * (r[y] - e["ay"]) - (e["by"] - e["ay"]) * (r[x] - e["ax"]) for x in "we" for y in "sn"]
        return ((F.greatest(e["ax"], e["bx"]) <= r["w"]) | (F.least(e["ax"], e["bx"]) >= r["e"])
                | (F.greatest(e["ay"], e["by"]) <= r["s"]) | (F.least(e["ay"], e["by"]) >= r["n"])
                | (F.least(*side) > 0) | (F.greatest(*side) < 0))

    def whole(r):
        return (r["w"] < r["e"]) & (r["s"] < r["n"]) & F.forall(edges, lambda e: clear(r, e)) & geo.point_in_edges(
            (r["w"] + r["e"]) / 2, (r["s"] + r["n"]) / 2, polygons)

    nothing = _rect(F.lit(float("inf")), F.lit(float("-inf")), F.lit(float("inf")), F.lit(float("-inf")))
    return F.coalesce(F.get(F.filter(F.array(*[shrunk(v) for v in (1.0, 0.75, 0.5, 0.25)]), whole), F.lit(0)), nothing)


def _sketched(zones: DataFrame) -> DataFrame:
    """A row per zone with an id and a vertex: polygons as edges, their box, the box of the outer rings, and four
    rectangles. The zone lies within _out0 and _out1, two slabs parted at one of up to eight latitudes of vertices
    so that they are smallest, or twice its box; it holds all of _in0 and _in1. _plain says that the two pairs are
    the same, _again that the id has several rows."""
    known = lambda v: v.isNotNull() & ~F.isnan(v)
    filled = lambda values: F.filter(values, lambda v: F.size(v) > 0)
    bare = lambda values: F.filter(values, lambda v: v.isNotNull())
    polygons = F.transform(filled("polygons"), lambda rings: F.transform(bare(rings), geo.ring_edges))
    z = _dealt(zones.where("zone_id is not null")).select(
        "zone_id", polygons.alias("_edges"), geo.multipolygon_box(F.col("polygons")).alias("_outer"))
    z = once(z.where("_edges is not null"), "_flat", F.filter(F.flatten(F.flatten("_edges")), lambda e: (
        known(e["ax"]) & known(e["ay"]) & known(e["bx"]) & known(e["by"]))))
    ends = lambda fold, of, axis: fold(F.transform("_flat", lambda e: of(e["a" + axis], e["b" + axis])))
    z = once(z, "_box", _rect(ends(F.array_min, F.least, "x"), ends(F.array_max, F.greatest, "x"),
                              ends(F.array_min, F.least, "y"), ends(F.array_max, F.greatest, "y"))).where("_box.w is not null")
    box, flat = F.col("_box"), F.col("_flat")
    ys = F.array_sort(F.array_distinct(F.transform(flat, lambda e: e["ay"])))
    z = once(z, "_cuts", F.filter(ys, lambda y: (y > box["s"]) & (y < box["n"])))
    share = lambda i: F.floor(i * 8 / F.greatest(F.size("_cuts"), F.lit(8)))
    cuts = F.filter("_cuts", lambda y, i: share(i + 1) > share(i))
    size = lambda r: (r["e"] - r["w"]) * (r["n"] - r["s"])
    parted = F.transform(cuts, lambda y: F.struct(_slab(flat, box["s"], y).alias("a"), _slab(flat, y, box["n"]).alias("b")))
    parted = F.filter(parted, lambda v: _held(v["a"], v["b"], flat))
    best = F.array_min(F.transform(parted, lambda v: F.struct(
        (size(v["a"]) + size(v["b"])).alias("size"), v["a"].alias("a"), v["b"].alias("b"))))
    z = once(z, "_best", best).withColumns({"_out0": F.coalesce("_best.a", "_box"), "_out1": F.coalesce("_best.b", "_box")})
    for i in "01":
        z = once(z, f"_in{i}", _core(F.col(f"_out{i}"), F.col("_edges"), flat))
    wide = F.greatest((box["e"] - box["w"]) / 360.0, (box["n"] - box["s"]) / 180.0, F.lit(2.0 ** -geo.CELL_BITS))
    z = z.select("zone_id", "_edges", "_outer", "_box", *_PARTS, F.size(flat).cast("long").alias("_n"),
                 F.floor(F.greatest(F.lit(0.0), -F.log2(wide))).cast("int").alias("_fit"),
                 ((F.col("_in0") == F.col("_out0")) & (F.col("_in1") == F.col("_out1"))).alias("_plain"))
    z = z.repartition(4 * zones.sparkSession.sparkContext.defaultParallelism, "zone_id")
    return z.withColumn("_again", F.count(F.lit(1)).over(Window.partitionBy("zone_id")) > 1)


def _by_cell(z: DataFrame, levels: list[int]) -> tuple[DataFrame, int]:
    """Zones once for every cell their box touches, four at most, on their own level and each coarser one in use.
    _as and _bs are the numbers of blocks into which the zones at home in a crowded cell and all its zones go.
    And the tasks that should join them: more for more blocks, so that none writes too many pairs."""
    cores = z.sparkSession.sparkContext.defaultParallelism
    drop = F.lit(geo.CELL_BITS) - F.col("level")
    at = lambda v: F.call_function("shiftright", v, drop)
    x, y = (lambda v: at(geo.cell_x(v, geo.CELL_BITS))), (lambda v: at(geo.cell_y(v, geo.CELL_BITS)))
    steps = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v <= F.col("_fit"))
    rows = z.withColumn("level", F.explode(steps)).withColumns({"_x0": x(F.col("_box.w")), "_y0": y(F.col("_box.s"))})
    rows = rows.withColumn("_x", F.explode(F.sequence("_x0", x(F.col("_box.e"))))).withColumn(
        "_y", F.explode(F.sequence("_y0", y(F.col("_box.n")))))
    rows = rows.withColumns({"cell": geo.cell_key(F.col("_x"), F.col("_y")), "_home": F.col("level") == F.col("_fit")})
    blocks = lambda n, name: F.greatest(F.lit(1), F.ceil(n / F.lit(_SIDE))).cast("int").alias(name)
    crowded = rows.groupBy("cell", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if("_home").alias("homes"))
    crowded = cut_lineage(crowded.where(F.col("n") > _SIDE).select("cell", "level", blocks(F.col("homes"), "_as"), blocks(F.col("n"), "_bs")))
    met = crowded.agg(F.sum(F.col("_as").cast("long") * F.col("_bs"))).first()[0] or 0
    rows = rows.join(broadcast_if_small(crowded), ["cell", "level"], "left").withColumns(
        {n: F.coalesce(n, F.lit(1)) for n in ("_as", "_bs")})
    return rows, max(16 * cores, min(_TASKS, met // 4))


def _box_pairs(rows: DataFrame, tasks: int, test, *more: str) -> DataFrame:
    """Joins each two zones whose boxes meet, once, where ``test`` holds: on the coarser level of the two, in the
    cell of the south-west corner of what the boxes share. Zones of a crowded cell are dealt to blocks, and blocks
    meet in pairs, so that no task has all pairs of a cell. ``test`` is given whether inner rectangles meet, whether
    outer ones do, and the two sides; pairs of very many edges are left out."""
    sure = lambda c: F.coalesce(c, F.lit(float("nan")))  # noqa: E731  never null here; without null checks the condition is compiled
    flat = [sure(F.col(c)[v]).alias(f"{c}_{v}") for c in ("_box", *_PARTS) for v in _SIDES]
    key = ["cell", "level", "_a", "_b"]
    mine = lambda n: F.pmod(F.xxhash64("zone_id", "_box"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda df: df.select(*key, "zone_id", "_home", "_again", "_n", "_plain", "_x", "_y", "_x0", "_y0", *flat, *more).repartition(tasks, *key)
    a = dealt(rows.where("_home").withColumn("_a", mine("_as")).withColumn("_b", every("_bs"))).alias("a")
    b = dealt(rows.withColumn("_b", mine("_bs")).withColumn("_a", every("_as"))).alias("b")
    one, other = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    rect = lambda side, c: {v: side(f"{c}_{v}") for v in _SIDES}
    here = _meet(rect(one, "_box"), rect(other, "_box")) & (F.greatest("a._x0", "b._x0") == one("_x")) & (
        F.greatest("a._y0", "b._y0") == one("_y"))
    once_each = (one("zone_id") < other("zone_id")) | (~other("_home") & (one("zone_id") != other("zone_id")))
    parts = lambda kind: reduce(or_, [_meet(rect(one, kind + i), rect(other, kind + j)) for i in "01" for j in "01"])
    small = one("_n") * other("_n") <= _EDGE_PAIRS
    same = reduce(and_, [one(c) == other(c) for c in key])
    return a.join(b, same & here & once_each & small & test(parts("_in"), parts("_out"), one, other))


def _adjacent(df: DataFrame) -> DataFrame:
    """Rows of two zones' edges and boxes (_edges1, _outer1, _box1 and 2) that meet: by their edges, or as one
    polygon's first vertex lies in the other zone."""
    def near(mine, box):
        box = F.col(box)
        return F.filter(F.flatten(F.flatten(mine)), lambda e: (
            (F.least(e["ax"], e["bx"]) <= box["e"]) & (F.greatest(e["ax"], e["bx"]) >= box["w"])
            & (F.least(e["ay"], e["by"]) <= box["n"]) & (F.greatest(e["ay"], e["by"]) >= box["s"])
            & ((e["ax"] != e["bx"]) | (e["ay"] != e["by"]))))

    def reaches(mine, other):
        firsts = F.transform(F.col(f"_edges{mine}"), lambda rings: F.get(F.get(rings, F.lit(0)), F.lit(0)))
        return F.exists(firsts, lambda v: F.coalesce(geo.in_box(v["ax"], v["ay"], F.col(f"_outer{other}")) & geo.point_in_edges(
            v["ax"], v["ay"], F.col(f"_edges{other}")), F.lit(False)))

    df = once(once(df, "_near1", near("_edges1", "_box2")), "_near2", near("_edges2", "_box1"))
    end = lambda e, v: {"x": e[v + "x"], "y": e[v + "y"]}
    crossing = F.exists("_near1", lambda e: F.exists("_near2", lambda f: segments_meet(end(e, "b"), end(e, "a"), end(f, "b"), end(f, "a"))))
    return df.where(crossing | reaches(1, 2) | reaches(2, 1))


def _long_pairs(z: DataFrame, bits: int | None) -> DataFrame:
    """Pairs of zones that meet and have many edges, more than once each.

    Boundary segments are hashed to the cells they cross and meet in an equi join on the cell, so only segments
    near each other are compared. Two zones without a crossing boundary still meet when one lies inside the
    other; that is tested with one vertex per polygon through the cell cover. By default cells are a quarter as
    wide as the longer segments, near where the pairs of segments in one cell stop falling. Segments are dealt
    out by cell, the work being the pairs and not the bytes.
    """
    cores = z.sparkSession.sparkContext.defaultParallelism
    point = lambda v: F.struct(F.col(f"e.{v}x").alias("x"), F.col(f"e.{v}y").alias("y"))
    segs = z.select("zone_id", "_n", F.explode(F.flatten(F.flatten("_edges"))).alias("e")).select(
        "zone_id", "_n", point("b").alias("p"), point("a").alias("q"))
    p, q = F.col("p"), F.col("q")
    segs = segs.where(p != q)
    if bits is None:
        reach = F.greatest(F.abs(p["x"] - q["x"]) / 360.0, F.abs(p["y"] - q["y"]) / 180.0)
        long = segs.agg(F.percentile_approx(reach, 0.9).alias("r")).first()["r"] or 1.0
        bits = max(0, min(geo.CELL_BITS, math.floor(-math.log2(long)) + 2))
    ends = ("p", "q")
    sure = lambda c: F.coalesce(c, F.lit(float("nan")))  # noqa: E731  never null here; without null checks the condition is compiled
    segs = _cells_crossed(segs, bits).select("zone_id", "_n", "cell", *[
        sure(F.col(f"{e}.{c}")).alias(e + c) for e in ends for c in "xy"]).repartition(16 * cores, "cell")
    many = lambda a, b: F.col(a) * F.col(b) > _EDGE_PAIRS
    a, b = segs.alias("a"), segs.alias("b")
    point_of = lambda side, e: {c: F.col(f"{side}.{e}{c}") for c in "xy"}
    crossing = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.zone_id") < F.col("b.zone_id")) & many("a._n", "b._n")
                      & segments_meet(*[point_of(side, e) for side in "ab" for e in ends]))
    crossing = crossing.select(F.col("a.zone_id").alias("z1"), F.col("b.zone_id").alias("z2"))

    first = F.get(F.get(F.col("rings"), F.lit(0)), F.lit(0))
    vertices = z.select(F.col("zone_id").alias("inner_id"), F.col("_n").alias("_m"), F.explode("_edges").alias("rings")).select(
        "inner_id", "_m", first["ax"].alias("lon"), first["ay"].alias("lat"))
    cover = z.select("zone_id", "_n", "_edges", F.col("_outer").alias("_box")).withColumn("_level", _level_for(F.col("_box")))
    spread = vertices.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(geo.CELL_BITS))))
    spread = spread.withColumn("_cell", _cell_at(F.col("_level"), F.col("lat"), F.col("lon")))
    spread = spread.repartition(16 * cores, "_level", "_cell")
    inside = spread.join(_box_cells(cover).repartition(16 * cores, "_level", "_cell"), ["_level", "_cell"]).where(
        (F.col("inner_id") != F.col("zone_id")) & many("_n", "_m") & geo.in_box(F.col("lon"), F.col("lat"), F.col("_box"))
        & geo.point_in_edges(F.col("lon"), F.col("lat"), F.col("_edges"))
    ).select(F.least("inner_id", "zone_id").alias("z1"), F.greatest("inner_id", "zone_id").alias("z2"))
    return crossing.unionByName(inside)


def zone_adjacency(zones: DataFrame, bits: int | None = None) -> DataFrame:
    """(zone_id, neighbour_id) for zones that intersect or touch, each zone with itself.

    Zones whose boxes meet are found once each by an equi join on cells, so their pairs, which may be the square
    of the zones, are neither shuffled nor compared with each other. Most are told by rectangles alone: two
    zones meet if rectangles within them do, and don't if those around them don't. Only the rest are compared
    edge by edge. Pairs with very many edges are found by segments in cells of ``bits`` instead, and made
    distinct, as are pairs of ids that have several rows.
    """
    z = cut_lineage(_sketched(zones))
    levels, plain, again, most = z.agg(F.sort_array(F.collect_set("_fit")), F.coalesce(F.min("_plain"), F.lit(True)),
                                       F.coalesce(F.max("_again"), F.lit(False)), F.coalesce(F.max("_n"), F.lit(0))).first()
    rows, tasks = _by_cell(z, levels or [0])
    ids = (F.col("a.zone_id").alias("z1"), F.col("b.zone_id").alias("z2"))

    def found(some) -> DataFrame:
        kept = lambda a, b: some(a("_again") | b("_again")) if again else F.lit(True)
        pairs = _box_pairs(rows, tasks, lambda inner, outer, a, b: kept(a, b) & inner).select(*ids)
        if plain:
            return pairs
        both = [F.col(f"{side}._{c}").alias(f"_{c}{i}") for i, side in ((1, "a"), (2, "b")) for c in ("edges", "outer")]
        both += [_rect(*[F.col(f"{side}._box_{v}") for v in _SIDES]).alias(f"_box{i}") for i, side in ((1, "a"), (2, "b"))]
        open_ = _box_pairs(rows, tasks, lambda inner, outer, a, b: kept(a, b) & ~(a("_plain") & b("_plain")) & outer & ~inner, "_edges", "_outer")
        return pairs.unionByName(_adjacent(open_.select(*ids, *both)).select("z1", "z2"))

    pairs = found(lambda several: ~several)
    more = [found(lambda several: several).select(F.least("z1", "z2").alias("z1"), F.greatest("z1", "z2").alias("z2"))] if again else []
    if most * most > _EDGE_PAIRS:
        more.append(_long_pairs(z.where(F.col("_n") * most > _EDGE_PAIRS), bits))
    if more:
        pairs = pairs.unionByName(reduce(DataFrame.unionByName, more).distinct())
    both = pairs.select(F.explode(F.array(F.struct("z1", "z2"), F.struct(F.col("z2").alias("z1"), F.col("z1").alias("z2")))).alias("s"))
    own = zones.select(F.col("zone_id").alias("z1"), F.col("zone_id").alias("z2")).distinct()
    return both.select("s.z1", "s.z2").unionByName(own).select(
        F.col("z1").alias("zone_id"), F.col("z2").alias("neighbour_id"))


def grid_adjacency(zone_ids: DataFrame) -> DataFrame:
    """(zone_id, neighbour_id) on the city grid for the given distinct zone ids."""
    return zone_ids.select("zone_id", F.explode(geo.adjacent_zones(F.col("zone_id"))).alias("neighbour_id"))
