import math

import numpy as np
import pytest

from kerbside.llm import hnsw, vectors
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n string, dim string, score string"


@pytest.fixture
def frame(spark):
    def build(rows):
        return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)

    return build


def near_groups(seed=0, dim=24):
    """Groups whose members lie around a cosine of 0.95 to each other, exact copies, multiples, strangers."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(12):
        base = r.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(2 + 3 * g):
            out.append(base + r.normal(size=dim) * (0.02 + 0.006 * g))
    out += [out[0], out[0], [x * 3 for x in out[1]], *r.normal(size=(120, dim))]
    return [[float(np.float32(x)) for x in v] for v in out]


BAD = [None, [0.0] * 24, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, []]


def plain(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v) and i is not None]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (a, x) in enumerate(good):
        for b, y in good[:n]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return links, {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("block", [512, 8])
def test_links_against_all_pairs(frame, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = list(enumerate(near_groups() + BAD + [[1.0, 0.0], [1.0, 0.1]]))
    links, comp = plain(rows)
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame(rows)).collect()}
    assert sum(links.values()) > 500
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_boundary_pairs_are_found():
    """At a cosine of just 0.95 nearly every pair shares a table."""
    r = np.random.default_rng(1)
    x = vectors.unit(r.normal(size=(2000, 64)))
    side = r.normal(size=x.shape)
    side = vectors.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * side
    shared = (vectors.table_keys(x) == vectors.table_keys(y)).any(axis=1)
    assert shared.mean() > 0.99


def test_repeated_nameless_and_empty(frame):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near_vectors(frame(rows)).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 0, "2", True), ("None", 0, "None", True)]
    assert vectors.near_vectors(frame([])).collect() == []


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = near[:k]
    return out


def test_recall_against_brute_force(frame):
    r = np.random.default_rng(7)
    centres = r.normal(size=(6, 32))
    x = np.concatenate([centres[r.integers(0, 6, 1500)] + 0.4 * r.normal(size=(1500, 32)),
                        centres[0] + 0.002 * r.normal(size=(500, 32))]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000 + i, v) for i, v in enumerate(BAD)]
    vecs = frame(rows)
    index = hnsw.build_index(vecs, shard_rows=600)
    assert index.count() == 4
    got = hnsw.search(index, vecs.where("vec_id % 20 = 0"), 10).collect()
    expect = brute(rows, {i for i, _ in rows if i % 20 == 0}, 10)
    hits = sum((r["query_id"], r["vec_id"]) in {(q, i) for q, near in expect.items() for _, i in near} for r in got)
    assert hits >= 0.95 * sum(map(len, expect.values()))
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert all(scores[q, i] == pytest.approx(d, abs=1e-12) for q, near in expect.items() for d, i in near if (q, i) in scores)
    for q in expect:
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda m: (m[1], m[2]))


def test_few_candidates_ties_and_bad_vectors(frame):
    rows = [(100, [0.0, 1.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (4, [0.0, 0.0]), (200, None), (300, [1.0, 2.0, 3.0]), (5, [0.0, 4.0])]
    got = sorted(tuple(r) for r in hnsw.nearest(frame(rows), F.col("vec_id") % 100 == 0).collect())
    assert got == [(100, 1, 2, 1.0), (100, 2, 3, 1.0), (100, 3, 5, 3.0)]
    assert hnsw.nearest(frame([]), F.col("vec_id") % 100 == 0).collect() == []


def test_graph_is_connected_and_bounded():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(400, 8)), 5 + 0.001 * r.normal(size=(200, 8))])
    g = hnsw.Graph.build(np.arange(600), x)
    assert g.links[0].shape == (600, 2 * hnsw.LINKS) and len(g.nodes) > 1
    found = sum(g.search(x[i], 1, 64)[0][0] == 0 for i in range(600))
    assert found >= 595


def test_recall_beside_a_group_of_copies(frame):
    """Copies of one vector, a third of the rows of several shards, hide no true neighbour."""
    r = np.random.default_rng(17)
    centres = r.normal(size=(6, 32))
    x = centres[r.integers(0, 6, 1600)] + 0.4 * r.normal(size=(1600, 32))
    x = np.concatenate([x, np.repeat(x[:1], 800, axis=0)]).astype(np.float32)[r.permutation(2400)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vecs = frame(rows)
    index = hnsw.build_index(vecs, shard_rows=600)
    assert index.count() == 4
    got = hnsw.search(index, vecs.where("vec_id % 20 = 0"), 10).collect()
    expect = brute(rows, {i for i, _ in rows if i % 20 == 0}, 10)
    copies = {q for q, near in expect.items() if near[-1][0] == 0}
    assert copies and len(copies) < len(expect)
    mine = {q: [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in expect}
    assert all(mine[q] == expect[q] for q in copies)
    hits = sum(len({i for _, i in mine[q]} & {i for _, i in expect[q]}) for q in expect if q not in copies)
    assert hits >= 0.99 * 10 * (len(expect) - len(copies))


@pytest.mark.parametrize("extra", [3, 12, 300])
def test_rows_of_the_querys_id_take_no_place(frame, extra):
    """However many rows repeat the query's id, near to it or not, its ten nearest are other ids."""
    r = np.random.default_rng(extra)
    x = r.normal(size=(300, 6)).astype(np.float32)
    rows = [(i + 1, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(100, [float(c) for c in x[99] + 0.001 * r.normal(size=6)]) for _ in range(extra)]
    table = frame(rows)
    got = hnsw.search(hnsw.build_index(table, shard_rows=1000), table.where("vec_id = 100").limit(1), 10).collect()
    q = np.array(table.where("vec_id = 100").first()["embedding"])
    near = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in rows if i != 100)[:10]
    mine = [(m["score"], m["vec_id"]) for m in sorted(got, key=lambda m: m["rank"])]
    assert len(mine) == 10 and len({i for _, i in mine} & {i for _, i in near}) >= 9 and mine[0] == pytest.approx(near[0])
