"""Query registry: name → (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables. The oracle, when given, is independent SQL text over the
base views (it re-derives the domain tables in a ``WITH`` clause).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: Callable[[], str] | None
    ids: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: Callable[[], str] | None = None, ids: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from . import (q_assortment, q_checks, q_demand, q_impute, q_interval, q_io, q_models, q_periodic,  # noqa: F401
                   q_quality, q_reports, q_weekly)
    return REGISTRY
