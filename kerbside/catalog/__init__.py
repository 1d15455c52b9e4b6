"""Registered queries: every operator on the benchmark tables, with its SQL twin where one exists."""

from kerbside.catalog import billing, demand, forecast, geography, io, matching, streams, trips  # noqa: F401
from kerbside.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
