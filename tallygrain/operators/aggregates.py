"""Grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tallygrain.operators.ordered import block_of, position
from tallygrain.session import written


def group_sum(df: DataFrame, keys: Sequence[str], measure: str | Column, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(out))


def _wide(measure: str) -> Column:
    # leaf sums fit a long; their totals over a whole table may not
    return F.col(measure).cast("decimal(38,0)")


def rollup_sum(df: DataFrame, keys: Sequence[str], measure: str, out: str) -> DataFrame:
    """Sum of a whole-number measure with hierarchical subtotals; ``level`` is the grouping id.

    Summed to the leaves first: the subtotal expansion then copies leaf rows, not facts.
    """
    leaves = df.groupBy(*keys).agg(F.sum(measure).alias("_leaf"))
    return leaves.rollup(*keys).agg(F.sum(_wide("_leaf")).alias(out), F.grouping_id().alias("level"))


def cube_agg(df: DataFrame, keys: Sequence[str], measure: str, out: str, count: str | None = None) -> DataFrame:
    """Sum (and row count) for all subtotal combinations, from pre-summed leaves."""
    leaves = df.groupBy(*keys).agg(F.sum(measure).alias("_leaf"), F.count(F.lit(1)).alias("_rows"))
    aggs = [F.sum(_wide("_leaf")).alias(out), F.grouping_id().alias("level")]
    if count:
        aggs.append(F.sum("_rows").alias(count))
    return leaves.cube(*keys).agg(*aggs)


def count_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def count_distinct_by(df: DataFrame, keys: Sequence[str], column: str, out: str, approx: bool = False) -> DataFrame:
    counter = F.approx_count_distinct(column) if approx else F.count_distinct(column)
    return df.groupBy(*keys).agg(counter.alias(out))


def bounds_by(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias("min_id"), F.max(column).alias("max_id"))


def collect_chunks(df: DataFrame, keys: Sequence[str], index: str, fields: Sequence[str], out: str, rows: int) -> DataFrame:
    """Child rows as arrays ordered by a dense 0-based ``index``, cut into chunks of at most ``rows``.

    Element ``i`` of a parent is element ``i % rows`` of chunk ``i div rows``.
    ``index`` is unique in a parent, so no task gathers more than ``rows`` rows of one.
    """
    element = F.struct(F.col(index).alias("_i"), *fields)
    gathered = df.groupBy(*keys, block_of(index, rows).alias("chunk")).agg(
        F.array_sort(F.collect_list(element)).alias("_sorted")
    )
    plain = F.transform("_sorted", lambda e: F.struct(*[e.getField(f).alias(f) for f in fields]))
    return gathered.withColumn(out, plain).drop("_sorted")


def collect_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    out: str,
    blocks: Sequence[Column] | None = None,
    rows: int = 1000,
) -> DataFrame:
    """Child rows as ordered arrays, any number per parent: chunk 0, 1, .. of at most ``rows`` each.

    Without ``blocks``, which must follow the order, rows are cut at equi-depth splitters.
    """
    placed = position(df, keys, order, "_place", blocks).withColumn("_place", F.col("_place") - 1)
    return collect_chunks(placed, keys, "_place", fields, out, rows)


RADIX = 20  # leading bits that one pass tells apart


def _bins(df: DataFrame, group: Sequence[str], column: str, shift: Column | int, extra: Sequence[str] = ()) -> DataFrame:
    """Rows, sum, least and largest value of each bin: the values that agree but for their last ``shift`` bits."""
    value = F.col(column).cast("long")
    bin_ = F.call_function("shiftright", value, F.lit(shift) if isinstance(shift, int) else shift).alias("_bin")
    return df.groupBy(*group, *extra, bin_).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(value.cast("decimal(38,0)")).alias("_sum"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )


def rank_values(df: DataFrame, group: Sequence[str], column: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """Per group: n, mean and ``values``, the values at the 0-based ranks that ``ranks(n)`` names, by radix selection.

    A pass counts the values by their leading bits; running totals over these
    few bins tell which of them hold the wanted ranks, and the next pass counts
    the values of those bins alone by their next bits. Bits that all wanted bins
    have in common are skipped, so four passes do for any 64-bit values, and
    fewer for narrow ones. Only counts are shuffled. Nulls are left out; equal
    values have ranks next to each other; a group without values has no row.
    """
    on = list(group)
    # null groups meet each other
    keyed = df.filter(F.col(column).isNotNull()).withColumn("_g", F.struct(*on))
    shift = 64 - RADIX
    # used for the totals and for the ranks: one shuffle serves both
    bins = _bins(keyed, ["_g"], column, shift)
    totals = bins.groupBy("_g").agg(F.sum("_n").alias("n"), (F.sum("_sum").cast("double") / F.sum("_n")).alias("mean"))
    wanted = totals.select("_g", "n", "mean", F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("_i", "_rank"))
    # rank inside the part of the values that is still looked at, and that part (all, at first)
    wanted = wanted.withColumn("_part", F.lit(None).cast("long"))
    bins = bins.withColumn("_part", F.lit(None).cast("long"))
    while True:
        inside = W.partitionBy("_g", "_part").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
        # 2 ** RADIX bins of a part at most
        placed = bins.select("_g", "_part", "_bin", "_n", "_min", "_max").withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        placed = placed.withColumnRenamed("_g", "_h")
        same = (F.col("_g") == F.col("_h")) & F.col("_of").eqNullSafe(F.col("_part"))
        met = wanted.withColumnRenamed("_part", "_of").join(placed, same)
        met = met.filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        found = written(
            met.select("_g", "n", "mean", "_i", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_bin").alias("_part"), "_min", "_max"), "ranked"
        )
        # bits that differ in the widest bin that is still open
        differing = F.when(F.col("_min") != F.col("_max"), F.length(F.bin(F.col("_min").bitwiseXOR(F.col("_max")))))
        widest = found.agg(F.max(differing)).first()[0]
        if widest is None:
            break
        lower = max(0, widest - RADIX)
        # the parts that are still open, at most one a rank, and the bits they were told apart by
        parts = found.filter("_min != _max").groupBy("_g").agg(F.collect_set("_part").alias("_parts"))
        own = F.call_function("shiftright", F.col(column).cast("long"), F.lit(shift))
        rows = keyed.join(parts, "_g").filter(F.array_contains("_parts", own)).withColumn("_part", own)
        done = found.filter("_min = _max")
        bins = _bins(rows, ["_g"], column, lower, ["_part"])
        # ranks whose bin holds one value only stay as they are
        closed = done.select("_g", F.col("_part"), F.call_function("shiftright", "_min", F.lit(lower)).alias("_bin"), "_min", "_max", "_rank")
        closed = closed.groupBy("_g", "_part", "_bin", "_min", "_max").agg((F.max("_rank") + 1).alias("_n"))
        bins = bins.select("_g", "_part", "_bin", "_n", "_min", "_max").unionByName(closed.select("_g", "_part", "_bin", "_n", "_min", "_max"))
        wanted, shift = found.select("_g", "n", "mean", "_i", "_rank", "_part"), lower
    values = found.groupBy("_g", "n", "mean").agg(F.array_sort(F.collect_list(F.struct("_i", "_min"))).alias("_v"))
    return values.select(*[F.col("_g").getField(c).alias(c) for c in on], "n", "mean", F.col("_v._min").alias("values"))


def percentile_summary(df: DataFrame, group: Sequence[str], column: str, probs: dict[str, float]) -> DataFrame:
    """Count, mean and exact interpolated percentiles of an integer column per group."""

    def ranks(n: Column) -> list[Column]:
        return [side(F.lit(p) * (n - 1)) for p in probs.values() for side in (F.floor, F.ceil)]

    found = rank_values(df, group, column, ranks)
    for k, (name, p) in enumerate(probs.items()):
        rank = F.lit(p) * (F.col("n") - 1)
        low, high = F.get("values", F.lit(2 * k)), F.get("values", F.lit(2 * k + 1))
        found = found.withColumn(name, low + (rank - F.floor(rank)) * (high - low))
    return found.drop("values")


# fixed values: the order of the seven counters in a counter text
COUNTERS = ["selects", "inserts", "updates", "deletes", "commits", "rollbacks", "sleep"]


def counter_totals(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Sum each of the seven comma-separated counters per group."""
    parts = F.split(column, ",")
    return df.groupBy(*group).agg(*[F.sum(parts.getItem(i).cast("long")).alias(c) for i, c in enumerate(COUNTERS)])
