"""All queries over the engine's own operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, discovery, reading, speech, streaming, structure

_PLANS = (speech, structure, alignment, reading, discovery, streaming)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}

ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
