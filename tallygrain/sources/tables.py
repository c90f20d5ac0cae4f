"""Tables, metadata, key/value bounds, statement batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.operators.ordered import running_total
from tallygrain.sources.schemas import read_table


def read_tables(spark: SparkSession, sf_dir: str, columns: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The named tables, each pruned to the given columns at the scan."""
    return {name: read_table(spark, sf_dir, name).select(*cols) for name, cols in columns.items()}


def jdbc_options(url: str, table: str, key: str, low: int, high: int, partitions: int, fetch: int = 10_000) -> dict:
    """Options of a scan split into ``partitions`` key ranges."""
    if high < low or partitions < 1:
        raise ValueError("need low <= high and at least one partition")
    return {
        "url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high),
        "numPartitions": str(partitions), "fetchsize": str(fetch),
    }


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int) -> DataFrame:
    """A table of a database, read in key ranges by as many tasks; filters and columns are pushed to it.

    The bounds come from ``metadata_bounds``. They only place the splits: rows outside are read too.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, table, key, low, high, partitions)).load()


def metadata_bounds(metadata: DataFrame, keys: dict[str, Column], fallback: DataFrame) -> DataFrame:
    """Key/value rows as one row of bounds; a key that is absent is computed from the data.

    ``keys`` maps each metadata key to the aggregate over ``fallback`` that replaces it.
    """
    found = metadata.filter(F.col("metadata_key").isin(*keys)).agg(
        *[F.max(F.when(F.col("metadata_key") == k, F.col("metadata_value").cast("long"))).alias(k) for k in keys]
    )
    computed = fallback.agg(*[a.cast("long").alias(k) for k, a in keys.items()])
    both = found.withColumn("_src", F.lit(0)).unionByName(computed.withColumn("_src", F.lit(1)))
    # the first non-null of the two rows: stored before computed
    return both.agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("_src"))).alias(k) for k in keys])


def group_by_marker(
    df: DataFrame, files: Sequence[str], order: Sequence[str], tag: str, marker: str, blocks: Sequence[Column], out: str
) -> DataFrame:
    """Number the groups of a file of tagged records: each ``marker`` row starts one and owns the rows after it."""
    starts = F.when(F.col(tag) == marker, 1).otherwise(0).cast("long")
    return running_total(df, files, order, starts, out, blocks)


def run_statements(spark: SparkSession, statements: Sequence[tuple[str, str]], views: dict[str, DataFrame]) -> DataFrame:
    """Run each named statement once; its place, name and row count.

    ``{view}`` in a statement names one of ``views``.
    """
    counted = [
        spark.sql(text, **{n: v for n, v in views.items() if f"{{{n}}}" in text})
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(place).alias("place"), F.lit(name).alias("statement"), "row_count")
        for place, (name, text) in enumerate(statements, 1)
    ]
    return reduce(DataFrame.unionByName, counted)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables with their row counts, largest first. Counts come from the file footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy(F.desc("row_count"), "table_name")


def validate(tables: dict[str, DataFrame], spec: dict[str, dict[str, str]]) -> DataFrame:
    """Expected against present columns: one row per expected table with valid, wrong-type and missing columns.

    Reads schemas only, then counts the rows of the present tables.
    """
    checked = []
    for name, expected in spec.items():
        df = tables.get(name)
        present = {f.name: f.dataType.simpleString() for f in df.schema} if df is not None else {}
        valid = sum(present.get(c) == kind for c, kind in expected.items())
        missing = sum(c not in present for c in expected)
        state = "missing" if df is None else "valid" if valid == len(expected) else "invalid"
        base = df.agg(F.count(F.lit(1)).alias("row_count")) if df is not None else None
        labels = [
            F.lit(name).alias("table_name"), F.lit(state).alias("state"), F.lit(valid).alias("valid_columns"),
            F.lit(len(expected) - valid - missing).alias("wrong_columns"), F.lit(missing).alias("missing_columns"),
        ]
        if base is None:
            any_df = next(iter(tables.values()))
            base = any_df.limit(0).agg(F.count(F.lit(1)).alias("row_count"))
        checked.append(base.select(*labels, "row_count"))
    return reduce(DataFrame.unionByName, checked)
