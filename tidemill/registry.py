"""All queries of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans import relations, search, streams, tables, texts

_FAMILIES = (tables, relations, search, texts, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in _FAMILIES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in _FAMILIES for n, s in m.SQL.items()}
