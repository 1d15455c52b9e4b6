"""Pages by counted ranges and by the last key against a plain sort."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kerbside.operators import tables

KEYS = [("n", True), ("at", False), ("id", False)]


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(3)
    rows = [(i, 7 if i % 3 else r.choice([None, 1, 2, 9, r.randrange(1000)]), r.choice([None, r.randrange(50)])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, n int, s long").select(
        "id", "n", F.timestamp_seconds("s").alias("at")).repartition(5).cache()


def plain(df):
    rows = [(r["id"], r["n"], r["at"]) for r in df.collect()]
    return [x[0] for x in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2] is not None, x[2].timestamp() if x[2] else 0, x[0]))]


@pytest.mark.parametrize("page_no, size, most", [(0, 10, 20), (40, 25, 30), (17, 100, 50), (2, 999, 400), (3, 1000, 100), (0, 3, 10_000), (-1, 5, 64)])
def test_deep_pages(frame, page_no, size, most):
    start = max(0, page_no) * size
    got = [r["id"] for r in tables.deep_page(frame, KEYS, page_no, size, most=most, cuts=8).collect()]
    assert got == plain(frame)[start:start + size]


def test_a_page_past_the_end_and_an_empty_table(frame):
    assert tables.deep_page(frame, KEYS, 500, 10).collect() == []
    empty = tables.deep_page(frame.limit(0), KEYS, 0, 10)
    assert empty.collect() == [] and empty.columns == frame.columns


def test_keys_of_other_types_are_sorted_in_their_range(frame):
    named = frame.withColumn("name", F.format_string("%05d", "id"))
    got = [r["id"] for r in tables.deep_page(named, [("n", True), ("name", False)], 30, 20, most=25, cuts=8).collect()]
    rows = sorted(named.collect(), key=lambda r: (r["n"] is None, -(r["n"] or 0), r["name"]))
    assert got == [r["id"] for r in rows][600:620]


def test_the_sorts_of_a_deep_page_meet_few_rows(frame):
    pieces = tables._reach(frame, KEYS, 1200, 20, 60, 8)
    assert sum(p.count() for p in pieces) == 20 and len(pieces) <= 4
    for p in pieces:
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        assert max(int(n) for n in re.findall(r"Limit (\d+)", plan)) <= 60


def test_pages_after_the_last_row(frame):
    whole = frame.where("n is not null and at is not null")
    ids, last = [], None
    for _ in range(4):
        rows = (tables.page_after(whole, KEYS, last, 30) if last else tables.deep_page(whole, KEYS, 0, 30)).collect()
        ids += [r["id"] for r in rows]
        last = tuple(rows[-1][c] for c, _ in KEYS)
    assert ids == plain(whole)[:120]


def test_ranges_are_counted_on_the_keys_alone(frame, monkeypatch):
    """What makes the table isn't run again for every count: those read a checkpoint of the keys."""
    seen, reach = [], tables._reach
    monkeypatch.setattr(tables, "_reach", lambda df, *a: seen.append(df) or reach(df, *a))
    wide = frame.withColumn("more", F.sha2(F.col("id").cast("string"), 256))
    got = tables.deep_page(wide, KEYS, 40, 25, most=30, cuts=8)
    assert [r["id"] for r in got.collect()] == plain(frame)[1000:1025] and got.columns == wide.columns
    assert seen[0].columns == ["n", "at", "id"]
    assert "sha2" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_rows_with_equal_keys_on_both_sides_of_a_page(spark):
    rows = spark.createDataFrame([(i // 3,) for i in range(60)], "id long")
    pages = [[r["id"] for r in tables.deep_page(rows, [("id", False)], n, 10, most=5, cuts=4).collect()] for n in range(6)]
    assert pages == [[i // 3 for i in range(n * 10, n * 10 + 10)] for n in range(6)]
