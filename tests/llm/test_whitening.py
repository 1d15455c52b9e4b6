import math

import numpy as np
import pytest

from kerbside.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, p string, q string, n string, y string, component string"


@pytest.fixture
def frame(spark):
    def build(rows):
        return spark.createDataFrame([(i, v, 0, *["z"] * 6) for i, v in rows], SCHEMA)

    return build


def clouds(seed=1, n=300, dim=12):
    r = np.random.default_rng(seed)
    turn = r.normal(size=(dim, dim))
    rows = [[float(np.float32(c)) for c in v] for v in r.normal(size=(n, dim)) * np.linspace(2, 0.2, dim) @ turn]
    return rows + rows[:7] + [rows[3]] * 40 + [[0.0] * dim]


BAD = [None, [], [math.nan] + [1.0] * 11, [math.inf] + [1.0] * 11, [-math.inf] * 12, [None] + [1.0] * 11, [3e38] + [1.0] * 11]


def plain(rows, weights="counts", most=8):
    """The definition on whole matrices, deviations in Python's whole numbers."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    fit = x if weights == "counts" else [list(v) for v in dict.fromkeys(map(tuple, x))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = [k for k in range(min(most, len(values))) if values[k] > 1e-12 * values[0]]
    y = (np.array(x, float) - np.array([s / n for s in sums])) @ vectors[:, some] / np.sqrt(values[some])
    return n, [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x], y, values[some] / np.trace(v)


def compare(got, rows, **options):
    n, deviations, y, explained = plain(rows, **options)
    by_key = {}
    for r in got:
        by_key.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == len(rows) * y.shape[1]
    sign = {}
    for at, (i, _) in enumerate(rows):
        for k in range(y.shape[1]):
            r = by_key[i, k + 1].pop()
            assert r.n == n and r.deviation == deviations[at] and math.isclose(r.explained, explained[k], rel_tol=1e-9)
            if abs(y[at, k]) > 1e-6:
                assert math.isclose(abs(r.whitened), abs(y[at, k]), rel_tol=1e-5, abs_tol=1e-7)
                assert sign.setdefault(k, r.whitened * y[at, k] > 0) == (r.whitened * y[at, k] > 0)
            assert 0 <= r.identity_error < 1e-9


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_against_whole_matrices(frame, weights):
    rows = list(enumerate(clouds()))
    bad = [(1000 + i, v) for i, v in enumerate(BAD)]
    got = whitening.whiten(frame(rows + bad).repartition(5), weights=weights).collect()
    assert not {r.vec_id for r in got} & {i for i, _ in bad}
    compare(got, rows, weights=weights)


def test_few_dimensions_and_no_spread(frame):
    rows = [(i, [float(i % 5), 2.0, float(i % 3)]) for i in range(30)]  # the second never varies
    got = whitening.whiten(frame(rows)).collect()
    assert {r.component for r in got} == {1, 2}
    compare(got, rows)
    assert whitening.whiten(frame([(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0])])).count() == 0


def test_empty_and_unusable(frame):
    want = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(i, v) for i, v in enumerate(BAD)]):
        got = whitening.whiten(frame(rows))
        assert got.columns == want and got.count() == 0
    some = whitening.whiten(frame(list(enumerate(clouds()))))
    assert some.columns == want and some.dtypes == whitening.whiten(frame([])).dtypes


def test_ids_repeat_or_are_missing(frame):
    rows = list(enumerate(clouds()))
    got = whitening.whiten(frame(rows + [(5, rows[5][1]), (5, rows[9][1]), (None, rows[2][1])])).collect()
    assert len(got) == 8 * (len(rows) + 3) and sum(r.vec_id == 5 for r in got) == 24 and sum(r.vec_id is None for r in got) == 8
    assert got[0].n == len(rows) + 3


def test_unusual_lengths_are_left_out(frame):
    rows = list(enumerate(clouds()))
    got = whitening.whiten(frame(rows + [(5000 + i, [1.0, float(i)]) for i in range(20)])).collect()
    compare(got, rows)


def test_exact_beyond_floats():
    """Deviations that doubles can't hold, and some that a long can't."""
    x = np.array([[100_000 + 1024 * 900, 99_999], [3, 7]])
    n, sums = 10**5 + 7, [10**10 + 12_345, 10**10 + 1]
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening._deviations(x, n, sums) == [v if v < 1 << 63 else None for v in exact]
    assert whitening._deviations(x, 10**15, [10**20, 5]) == [None, None]
    small = whitening._deviations(x[1:], 10**4 + 1, [123, 456])
    assert small == [(3 * 10001 - 123) ** 2 + (7 * 10001 - 456) ** 2]


def test_query_against_whole_matrices(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(queries.QUERIES["op12_whitening"](spark, sf_dir).collect(),
            [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)])
