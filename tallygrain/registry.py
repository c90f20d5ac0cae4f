"""The list of named queries, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallygrain.shapes import SHAPES

# timestamps without a zone count as UTC; a skewed join is split even where
# that costs another shuffle (joins in a row on one hot key)
QUERY_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``; ``sql`` is its DuckDB check."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for name, value in QUERY_SETTINGS.items():
                spark.conf.set(name, value)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = key, fn.__doc__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_shapes(sql)
        return fn

    return register


def with_shapes(sql: str) -> str:
    """Prefix ``sql`` with the derived views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SHAPES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SHAPES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    views = ",\n".join(f"{n} as ({re.sub(r'[{}]', '', SHAPES[n]).strip()})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"
