"""Joins. No side is broadcast by hint: Spark broadcasts what its size statistics allow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.scalars import hash_key
from tallygrain.operators.ordered import block_of
from tallygrain.session import written


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str | list[str]]]) -> DataFrame:
    """Inner join of a fact (or of an already joined dimension) to each dimension in turn."""
    for dim, on in dims:
        fact = fact.join(dim, on)
    return fact


def split_join(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table that may have hot keys to one row per key (an aggregate, as a rule).

    Spark splits a hot partition only where both sides come straight from a
    shuffle made for the join. An aggregate on the same key is partitioned
    already and would be joined in place, hot key and all. Joining on the key
    and a hash of it asks for a shuffle of its own.
    """
    types = {f.name: f.dataType for f in df.schema}
    aligned = other.withColumns({k: F.col(k).cast(types[k]) for k in on})
    left, right = (side.withColumn("_h", F.xxhash64(*on)) for side in (df, aligned))
    return left.join(right, [*on, "_h"], how).drop("_h")


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with a match in ``other``; a key that ``other`` repeats meets them as one row."""
    return split_join(df, other.select(*on).distinct(), on, "left_semi")


def new_only(candidates: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Candidates whose key is not yet present."""
    return split_join(candidates, df.select(*on).distinct(), on, "left_anti")


def with_related(df: DataFrame, other: DataFrame, on: Sequence[str], aggs: dict[str, Column], default=0) -> DataFrame:
    """Add aggregates of the matching rows of ``other``; ``default`` where there are none.

    Aggregated before the join, so both sides meet on a unique key.
    """
    related = other.groupBy(*on).agg(*[a.alias(n) for n, a in aggs.items()])
    out = split_join(df, related, on, "left")
    for name in aggs:
        out = out.withColumn(name, F.coalesce(name, F.lit(default)))
    return out


def left_join(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that stays even when one key of ``other`` holds a large share of its rows.

    Spark can split a skewed right side of an inner join, not of an outer one:
    so the matches come from an inner join and the rest from an anti join.
    """
    alone = new_only(df, other, on)
    return df.join(other, list(on)).unionByName(alone, allowMissingColumns=True)


def with_details(short: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a short list to a large table: the table is first cut down to the list's keys where it lies."""
    matched = semi(other, short, on)
    return left_join(short, matched, on) if how == "left" else short.join(matched, list(on), how)


def densify(df: DataFrame, groups: Sequence[str], periods: DataFrame, fill: dict[str, object]) -> DataFrame:
    """Every group of ``df`` × every row of ``periods``, missing measures filled.

    ``periods`` is a calendar: its distinct rows are folded into one array
    literal (a scalar subquery) and exploded per group, so no pair join is
    planned. ``df`` must hold one row per group and period; it is used twice,
    and written so that what it sums up is read once.
    """
    on = list(periods.columns)
    df = written(df, "measured")
    calendar = periods.agg(F.array_sort(F.collect_set(F.struct(*on)))).scalar()
    frame = df.select(*groups).distinct().withColumn("_p", F.explode(calendar)).select(*groups, "_p.*")
    dense = frame.join(df, [*groups, *on], "left")
    return dense.fillna(fill)


SHORT_CELLS = 4  # a range that touches no more cells, or one more, is listed under each


def dyadic_pieces(low: Column, high: Column) -> Column:
    """The closed range of cells as an array of (level, place): aligned blocks of ``2 ** level`` cells, few for any range.

    Counted from the ends: on each level at most one block at either side that
    the next level cannot take, so a range over all cells has 126 blocks at
    most. A short range is its cells; null or empty ranges have none. Cells lie
    between -2**62 and 2**62.
    """
    piece = lambda level, place: F.struct(level.cast("int").alias("level"), place.cast("long").alias("place"))

    def at(level: Column) -> Column:
        # first and one past the last block of this level inside the range; ``first`` is rounded up
        first = -F.call_function("shiftright", -low, level)
        past = F.call_function("shiftright", high + 1, level)
        left = F.when((first < past) & (F.pmod(first, F.lit(2)) == 1), piece(level, first))
        right = F.when((first < past) & (F.pmod(past, F.lit(2)) == 1), piece(level, past - 1))
        return F.array(left, right)

    # half the width, which cannot overflow
    half = F.call_function("shiftright", high, F.lit(1)) - F.call_function("shiftright", low, F.lit(1))
    levels = F.sequence(F.lit(0), F.ceil(F.log2((half + 2).cast("double"))).cast("int") + 1)
    wide = F.filter(F.flatten(F.transform(levels, at)), lambda p: p.isNotNull())
    short = F.transform(F.sequence(low, high), lambda c: piece(F.lit(0), c))
    return F.when(low <= high, F.when(half < SHORT_CELLS / 2, short).otherwise(wide))


def range_join(
    points: DataFrame,
    at: str,
    ranges: DataFrame,
    low: str,
    high: str,
    cell: int | Column,
    how: str = "inner",
    most_cells: int | None = None,
) -> DataFrame:
    """Pair each point with the closed ranges holding it (integer columns).

    An equi-join on a dyadic index: a range stands under a few aligned blocks of
    ``cell``-wide cells, however wide it is, and a point looks under the one
    block of each level that any range uses. Choose ``cell`` near the usual
    range width: such ranges use one level only. ``most_cells`` says that no
    range touches more cells (up to ``SHORT_CELLS``), so that the levels need
    not be looked up.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    # cells first: a scalar subquery, which ``cell`` may be, cannot stand inside a lambda function
    listed_under = ranges.withColumns({"_first": block_of(low, cell), "_last": block_of(high, cell)})
    if most_cells is not None and most_cells <= SHORT_CELLS:
        cells = F.sequence(F.col("_first"), F.col("_last"))
        listed = F.explode(F.when(F.col("_first") <= F.col("_last"), cells)).alias("_place")
        pieces = listed_under.select(*ranges.columns, F.lit(0).alias("_level"), listed)
        probes = points.withColumns({"_level": F.lit(0), "_place": block_of(at, cell)})
    else:
        pieces = listed_under.select(
            *ranges.columns, F.inline(dyadic_pieces(F.col("_first"), F.col("_last"))).alias("_level", "_place")
        )
        # 63 levels at most
        levels = pieces.agg(F.array_sort(F.collect_set("_level"))).scalar()
        probes = points.withColumn("_level", F.explode(levels)).withColumn(
            "_place", F.call_function("shiftright", block_of(at, cell), F.col("_level"))
        )
    met = probes.join(pieces, ["_level", "_place"])
    found = met.filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_level", "_place")
    if how == "inner":
        return found
    # rows without a range, told by the point's value alone
    hit = found.select(at).distinct()
    alone = points.join(hit, points[at].eqNullSafe(hit[at]), "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def range_owner(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, code: str, cell: int | Column) -> DataFrame:
    """Each id with the ``code`` of the range holding it, the greatest lower bound winning; null without one."""
    ids = points.select(at).distinct()
    owner = range_join(ids, at, ranges, low, high, cell).groupBy(at).agg(F.max_by(code, low).alias(code))
    return split_join(points, owner, [at], "left")


def hash_chunks(spark, n: int) -> DataFrame:
    """``n`` contiguous ranges over the 32-bit hash space."""
    width = 2**32 // n
    return spark.range(n).select(
        F.col("id").alias("chunk_id"),
        (F.col("id") * width).alias("low"),
        F.when(F.col("id") == n - 1, F.lit(2**32 - 1)).otherwise((F.col("id") + 1) * width - 1).alias("high"),
    )


def assign_chunk(df: DataFrame, key: str, chunks: DataFrame, cell: int = 2**26) -> DataFrame:
    """Hash ``key`` and find the chunk whose ``[low, high]`` holds it."""
    hashed = df.withColumn("key_hash", hash_key(key))
    return range_join(hashed, "key_hash", chunks, "low", "high", cell).drop("low", "high")
