"""The registered queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (conversation_repair, decontaminate, hmm, html_text, kd_shards, line_dedup, metric_join, mixing, packing,
               periodic_runs, pseudonyms, simhash, toxicity)

MODULES = (html_text, pseudonyms, decontaminate, kd_shards, simhash, mixing, line_dedup, toxicity, hmm, metric_join,
           packing, conversation_repair, periodic_runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        if hasattr(m, "oracle_sql"):
            found |= m.oracle_sql()
    return found
