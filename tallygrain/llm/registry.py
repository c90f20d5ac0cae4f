"""Named queries of this subpackage; importing a module registers its own."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "url_filter",
    "line_quality",
    "language_id",
    "piece_codec",
    "packed_ids",
    "mixing",
    "sharding",
    "near_dedup",
    "substring_dedup",
    "nearest",
    "fingerprints",
    "variants",
    "alignment",
]


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``; ``sql`` is its DuckDB check."""

    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def load_all() -> None:
    for name in MODULES:
        import_module(f"tallygrain.llm.{name}")
