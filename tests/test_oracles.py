"""Registered queries against their SQL twins, and rules every plan has to keep."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracles import TABLES, check

import __spark_entry__ as entry
from kerbside.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
# training and streams take long; KERBSIDE_FAST=1 leaves them out
SLOW = {n for n, f in QUERIES.items() if f.__module__.endswith(".streams")}
SLOW |= {"model_against_baseline", "model_facts", "model_importances", "model_scores"}
RUN = sorted(set(QUERIES) - (SLOW if os.environ.get("KERBSIDE_FAST") else set()))
# reads, writes and streams run jobs while they are built; their plans are one scan
EAGER = {n for n, f in QUERIES.items() if f.__module__.endswith((".io", ".streams"))} | SLOW


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", RUN)
def test_query(spark, con, name):
    text, _, ok = check(spark, con, name, SF_DIR)
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    banned = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "PythonUDTF"]
    if name != "clipped_polylines":
        banned.append("ArrowEvalPython")
    assert not [b for b in banned if b in plan]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "driver_id" in df.columns
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
