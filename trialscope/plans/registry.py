"""Registered queries of the test-analytics side, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialscope.plans import ingest, jobs, views

_PARTS = (views, jobs, ingest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for part in _PARTS for k, text in part.oracle_sql().items()}
