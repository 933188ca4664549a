"""Queries and oracle SQL of the engagement operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import queries, queries2, queries3, queries4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = queries.QUERIES | queries2.QUERIES | queries3.QUERIES | queries4.QUERIES
ORACLES: dict[str, str] = queries.ORACLES | queries2.ORACLES | queries3.ORACLES | queries4.ORACLES
