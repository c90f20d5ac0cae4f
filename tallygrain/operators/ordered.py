"""Ordered computations inside groups of any size.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. When one
key holds a third of the table that task never ends. These operators cut each
group into *blocks*: runs of consecutive rows, named by a value computed from
the ordering columns (a date, an id divided by 65536, ...). Rows are ordered
inside their block, block totals are added up over the few blocks of a group,
and the two meet in an equi-join on the block. Block values depend on the data
alone, so a recomputed task finds the same answer.

``blocks`` must not decrease along the ordering. Where no column offers such
values (names, texts, ids in clusters), ``blocks=None`` cuts the rows, groups
one after the other, at equi-depth splitters (``operators/splitters.py``); the
ordering then ends with a column that tells a group's rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tallygrain.operators import splitters


def block_of(column: str | Column, width: int | Column) -> Column:
    """Number of the ``width``-wide cell that holds an integer value."""
    value = (F.col(column) if isinstance(column, str) else column).cast("long")
    cell = F.lit(width).cast("long")
    return ((value - F.pmod(value, cell)) / cell).cast("long")


def prefix_block(df: DataFrame, column: str, tail: int = 4) -> Column:
    """A prefix of a text, as long for every row: all but the last ``tail`` characters of the longest text.

    A prefix of fixed length never decreases along the order of the texts,
    however their lengths differ. Block sizes follow the names; splitters
    (``blocks=None``) keep them even.
    """
    longest = df.agg(F.coalesce(F.max(F.length(column)), F.lit(0))).scalar()
    return F.substr(F.col(column), F.lit(1), F.greatest(F.lit(1), longest - tail))


def _with_block(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Sequence[Column] | None) -> DataFrame:
    drop = []
    if blocks is None:
        drop = ["_cut"]
        df = splitters.with_block(df, [*keys, *order], "_cut")
        blocks = [F.col("_cut")]
    # a struct key compares nulls as equal and keeps window and join on one partitioning
    parts = [F.col(k) for k in keys] + [b.alias(f"_b{i}") for i, b in enumerate(blocks)]
    return df.withColumn("_block", F.struct(*parts)).drop(*drop)


def _group_of(keys: Sequence[str]) -> list[Column]:
    return [F.col("_block").getField(k) for k in keys]


def _block_sums(blocked: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    in_group = W.partitionBy(*_group_of(keys))
    earlier = in_group.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        "_block",
        "_sum",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(in_group).alias("_all"),
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    blocks: Sequence[Column] | None,
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` from the group's first row to this one.

    ``total`` names an optional column with the sum over the whole group.
    """
    blocked = _with_block(df, keys, order, blocks)
    inside = W.partitionBy("_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = _block_sums(blocked, keys, value).drop("_sum")
    joined = blocked.withColumn(out, F.sum(value).over(inside)).join(sums, "_block")
    joined = joined.withColumn(out, F.col(out) + F.col("_before"))
    if total:
        joined = joined.withColumn(total, F.col("_all"))
    return joined.drop("_block", "_before", "_all")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    blocks: Sequence[Column] | None,
) -> DataFrame:
    """Add several columns, each the sum of a value from the group's first row to this one, in one pass."""
    blocked = _with_block(df, keys, order, blocks)
    inside = W.partitionBy("_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = blocked.groupBy("_block").agg(*[F.sum(v).alias(f"_s_{c}") for c, v in values.items()])
    earlier = W.partitionBy(*_group_of(keys)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_block", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in values])
    joined = blocked.withColumns({c: F.sum(v).over(inside) for c, v in values.items()}).join(before, "_block")
    joined = joined.withColumns({c: F.col(c) + F.col(f"_s_{c}") for c in values})
    return joined.drop("_block", *[f"_s_{c}" for c in values])


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    blocks: Sequence[Column] | None,
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: the 1-based place of each row in its group."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, blocks, total)


def nth_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    nth,
    blocks: Sequence[Column] | None,
) -> DataFrame:
    """The row at place ``nth(size)`` (1-based) of every group.

    Block counts name the one block that holds the place; only the rows of
    those blocks are sorted.
    """
    blocked = _with_block(df, keys, order, blocks)
    counts = _block_sums(blocked, keys, F.lit(1).cast("long"))
    wanted = nth(F.col("_all")).cast("long")
    chosen = counts.filter((F.col("_before") < wanted) & (wanted <= F.col("_before") + F.col("_sum"))).select(
        "_block", (wanted - F.col("_before")).alias("_place")
    )
    inside = W.partitionBy("_block").orderBy(*order)
    return (
        blocked.join(chosen, "_block")
        .withColumn("_n", F.row_number().over(inside))
        .filter(F.col("_n") == F.col("_place"))
        .drop("_block", "_place", "_n")
    )


def following(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    out: str,
    blocks: Sequence[Column] | None,
) -> DataFrame:
    """Add ``out``: the value of ``column`` on the group's next row, null on its last."""
    blocked = _with_block(df, keys, order, blocks)
    # wrapped in a struct so that a null value differs from a missing row
    wrapped = F.struct(F.col(column).alias("v"))
    inside = W.partitionBy("_block").orderBy(*order)
    # the leading order column is its own minimum: a hash aggregate instead of a sorted one
    first_value = F.struct(F.min(column).alias("v")) if column == order[0] else F.min_by(wrapped, F.struct(*order))
    first = blocked.groupBy("_block").agg(first_value.alias("_first"))
    next_block = W.partitionBy(*_group_of(keys)).orderBy("_block")
    edge = first.select("_block", F.lead("_first").over(next_block).alias("_edge"))
    return (
        blocked.withColumn("_next", F.lead(wrapped).over(inside))
        .join(edge, "_block")
        .withColumn(out, F.coalesce("_next", "_edge").getField("v"))
        .drop("_block", "_next", "_edge")
    )
