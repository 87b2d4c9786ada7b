"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelake.plans import detail_queries, media_queries, season_queries, text_queries, timeline_queries, transcript_queries

_MODULES = (text_queries, timeline_queries, season_queries, media_queries, transcript_queries, detail_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
