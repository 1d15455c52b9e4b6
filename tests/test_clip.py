"""The vectorised clip against a plain loop over points and edges."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import clip
from kerbside.functions.clip import COAST, LAND

EDGES = list(zip(LAND.tolist(), LAND.tolist()[1:] + LAND.tolist()[:1], strict=True))
SHORE = list(zip(COAST.tolist(), COAST.tolist()[1:], strict=False))


def inside(p):
    hits = 0
    for prev, cur in EDGES:
        # the epsilon and the base vertex decide for points on an edge, so both are part of the rule
        if (cur[1] > p[1]) != (prev[1] > p[1]):
            hits += p[0] < (prev[0] - cur[0]) * (p[1] - cur[1]) / ((prev[1] - cur[1]) + S.GEOMETRY_EPSILON) + cur[0]
    return hits % 2 == 1


def foot(p, a, b):
    vx, vy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * vx + (p[1] - a[1]) * vy) / (vx * vx + vy * vy)))
    return [a[0] + t * vx, a[1] + t * vy]


def box(p):
    return [min(max(p[0], S.CITY.lon_min), S.CITY.lon_max), min(max(p[1], S.CITY.lat_min), S.CITY.lat_max)]


def on_land(p):
    return inside(p) or min(math.dist(p, foot(p, a, b)) for a, b in SHORE) <= S.COASTLINE_BAND


def inland(p):
    p = box(p)
    if inside(p):
        return p
    p = box(min((foot(p, a, b) for a, b in EDGES), key=lambda f: math.dist(p, f)))
    c = LAND.mean(axis=0)
    for i in range(10):
        if inside(p):
            return p
        d = math.dist(p, c)
        q = box([p[j] + (c[j] - p[j]) / d * S.INLAND_NUDGE * 2 ** i for j in (0, 1)])
        if inside(q):
            return q
    return p


def crossing(p, q):
    best = None
    for a, b in EDGES:
        rx, ry, sx, sy = q[0] - p[0], q[1] - p[1], b[0] - a[0], b[1] - a[1]
        det = rx * sy - ry * sx
        if abs(det) < S.GEOMETRY_EPSILON:
            continue
        t = ((a[0] - p[0]) * sy - (a[1] - p[1]) * sx) / det
        u = ((a[0] - p[0]) * ry - (a[1] - p[1]) * rx) / det
        if 0 <= t <= 1 and 0 <= u <= 1 and (best is None or t < best):
            best = t
    return None if best is None else [p[0] + best * (q[0] - p[0]), p[1] + best * (q[1] - p[1])]


def plain(line):
    out = []
    for p in line or []:
        if on_land(p):
            out.append(inland(p))
        elif out:
            hit = crossing(out[-1], p)
            if hit:
                out.append(inland(hit))
            break
    return out if len(out) > 1 else []


def walks(n, seed):
    rng = random.Random(seed)
    lines = [None, [], [[-7.5, 33.6]]]
    for _ in range(n):
        p = [rng.uniform(-7.80, -7.38), rng.uniform(33.45, 33.72)]
        line = []
        for _ in range(rng.randrange(0, 9)):
            line.append(list(p))
            p = [p[0] + rng.gauss(0, 0.02), p[1] + rng.gauss(0, 0.02)]
        lines.append(line)
    return lines


def test_batch_equals_plain_loop():
    lines = walks(1500, 7)
    got = clip._clip(pa.array(lines, pa.list_(pa.list_(pa.float64())))).to_pylist()
    assert sum(1 for g in got if g) > 300
    for line, g in zip(lines, got, strict=True):
        want = plain(line)
        assert len(g) == len(want)
        for a, b in zip(g, want, strict=True):
            assert a == pytest.approx(b, abs=1e-9)


def test_sliced_and_empty_batches():
    arr = pa.array(walks(50, 9), pa.list_(pa.list_(pa.float64())))
    whole = clip._clip(arr).to_pylist()
    assert clip._clip(arr.slice(10, 20)).to_pylist() == whole[10:30]
    assert clip._clip(arr.slice(0, 0)).to_pylist() == [] and clip._clip(arr.slice(0, 2)).to_pylist() == [[], []]


def test_on_a_column(spark):
    df = spark.createDataFrame([("[[-8.60,41.15],[-8.59,41.151]]",), ("bad",), ("[[0,0],[1,1]]",), ("[[-8.6,41.15],[-8.6]]",)], "t string")
    got = [r[0] for r in df.select(clip.remap_and_clip(F.col("t"))).collect()]
    assert got[0] != "[]" and got[1:] == ["[]", "[]", "[]"]
