"""Registry of queries and small helpers for their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a function under its name; ``ctes`` are put in front of the SQL."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        assert fn.__name__ not in QUERIES, fn.__name__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql.strip()
        return run

    return register


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
