"""Clip remapped polylines at the coast.

The only Python in the column functions: the rule needs projections, a search step towards the
centroid and a first-crossing test per trip, which is bulky as nested expressions. It runs as an
Arrow function; the geometry is NumPy over all points of a batch at once, without a loop over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import geo

# Land: the coastline closed through the eastern edge of the city box.
LAND = np.array([*S.COASTLINE, [S.CITY.lon_max, S.CITY.lat_min], [S.CITY.lon_max, S.CITY.lat_max]])
COAST = np.array(S.COASTLINE)
_FROM, _TO = LAND, np.roll(LAND, -1, axis=0)


def _inside(pts: np.ndarray) -> np.ndarray:
    """Even-odd test of n points against the land ring."""
    x, y = pts[:, 0, None], pts[:, 1, None]
    prev = np.roll(LAND, 1, axis=0)
    spans = (LAND[:, 1] > y) != (prev[:, 1] > y)
    cut = (prev[:, 0] - LAND[:, 0]) * (y - LAND[:, 1]) / ((prev[:, 1] - LAND[:, 1]) + S.GEOMETRY_EPSILON) + LAND[:, 0]
    return (spans & (x < cut)).sum(axis=1) % 2 == 1


def _project(pts: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest point on any segment a-b, and its squared distance; the first segment wins ties."""
    d = b - a
    length = (d ** 2).sum(axis=1)
    t = ((pts[:, None, :] - a) * d).sum(axis=2) / np.where(length < S.GEOMETRY_EPSILON, 1.0, length)
    t = np.where(length < S.GEOMETRY_EPSILON, 0.0, np.clip(t, 0.0, 1.0))
    foot = a + t[:, :, None] * d
    gap = ((pts[:, None, :] - foot) ** 2).sum(axis=2)
    best = gap.argmin(axis=1)
    rows = np.arange(len(pts))
    return foot[rows, best], gap[rows, best]


def _on_land(pts: np.ndarray) -> np.ndarray:
    """Inside the ring, or within the tolerance band along the coast."""
    return _inside(pts) | (_project(pts, COAST[:-1], COAST[1:])[1] <= S.COASTLINE_BAND ** 2)


def _to_box(pts: np.ndarray) -> np.ndarray:
    return np.clip(pts, [S.CITY.lon_min, S.CITY.lat_min], [S.CITY.lon_max, S.CITY.lat_max])


def _pull_inland(pts: np.ndarray) -> np.ndarray:
    """Into the box; points off the land go to its edge, then in doubling steps to the centroid."""
    out = _to_box(pts)
    off = np.flatnonzero(~_inside(out))
    if not len(off):
        return out
    edge = _to_box(_project(out[off], _FROM, _TO)[0])
    out[off] = edge
    todo = off[~_inside(edge)]
    if not len(todo):
        return out
    start = out[todo]
    way = LAND.mean(axis=0) - start
    norm = np.sqrt((way ** 2).sum(axis=1, keepdims=True))
    unit = np.where(norm < S.GEOMETRY_EPSILON, 0.0, way / np.where(norm < S.GEOMETRY_EPSILON, 1.0, norm))
    for step in S.INLAND_NUDGE * 2.0 ** np.arange(10):
        trial = _to_box(start + unit * step)
        hit = _inside(trial)
        out[todo[hit]] = trial[hit]
        todo, start, unit = todo[~hit], start[~hit], unit[~hit]
        if not len(todo):
            break
    return out


def _first_crossings(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each segment p-q first meets the land ring, and whether it does."""
    r, s = (q - p)[:, None, :], _TO - _FROM
    w = _FROM - p[:, None, :]
    denom = r[:, :, 0] * s[:, 1] - r[:, :, 1] * s[:, 0]
    flat = np.abs(denom) < S.GEOMETRY_EPSILON
    denom = np.where(flat, 1.0, denom)
    t = (w[:, :, 0] * s[:, 1] - w[:, :, 1] * s[:, 0]) / denom
    u = (w[:, :, 0] * r[:, :, 1] - w[:, :, 1] * r[:, :, 0]) / denom
    hit = ~flat & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    t = np.where(hit, t, np.inf).min(axis=1)
    met = np.isfinite(t)
    return p + np.where(met, t, 0.0)[:, None] * r[:, 0, :], met


def _clip(lines: pa.Array) -> pa.Array:
    """All polylines of a batch at once; ``starts`` marks where each line begins in the points."""
    sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    pts = lines.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if not len(pts):
        return _lists(np.zeros(len(sizes) + 1, np.int64), pts)
    line = np.repeat(np.arange(len(sizes)), sizes)
    land, spot, end = _on_land(pts), np.arange(len(pts)), starts[1:]
    # first land point per line, then the first sea point after it; the line's end if there is none
    first = end.copy()
    np.minimum.at(first, line[land], spot[land])
    sea = ~land & (spot > first[line])
    last = end.copy()
    np.minimum.at(last, line[sea], spot[sea])

    keep = (spot >= first[line]) & (spot < last[line])
    kept, kept_line = _pull_inland(pts[keep]), line[keep]
    cut = np.flatnonzero((last < end) & (first < last))
    if len(cut):
        before = _pull_inland(pts[last[cut] - 1])
        cross, met = _first_crossings(before, pts[last[cut]])
        extra = _pull_inland(cross[met])
        order = np.argsort(np.concatenate([kept_line, cut[met]]), kind="stable")
        kept = np.concatenate([kept, extra])[order]
        kept_line = np.concatenate([kept_line, cut[met]])[order]
    count = np.bincount(kept_line, minlength=len(sizes))
    long_enough = count > 1
    kept = kept[long_enough[kept_line]]
    return _lists(np.concatenate([[0], np.cumsum(np.where(long_enough, count, 0))]), kept)


def _lists(starts: np.ndarray, pts: np.ndarray) -> pa.Array:
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(pts) + 1) * 2, pa.int32()), pa.array(pts.reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs)


_clip_udf = F.arrow_udf(_clip, S.POLYLINE)


def clip_polyline(points) -> Column:
    """From the first land point to the first crossing of the coast; empty with fewer than 2 points."""
    return _clip_udf(points)


def remap_and_clip(text, src: S.Box = S.SOURCE_EXPLORE, dst: S.Box = S.CITY) -> Column:
    """JSON in, JSON out: drop points outside the source box, carry the rest over, clip at the coast."""

    def moved(pts):
        usable = F.when(F.forall(pts, geo.is_point), pts)
        return geo.remap_without_clamp(geo.keep_in_box(usable, src), src, dst)

    on_map = F.coalesce(geo.let(geo.parse_polyline(text), moved), F.array().cast(S.POLYLINE))
    return F.to_json(clip_polyline(on_map))
