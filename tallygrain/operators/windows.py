"""Rankings, lags, running and moving aggregates.

Rankings keep only the first places, which Spark applies before the shuffle
(window group limit), so a hot group sends at most a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tallygrain.operators.joins import split_join
from tallygrain.session import written


def _descending(column: str) -> Column:
    return F.col(column).desc_nulls_first()


def top_ranked(df: DataFrame, part: Sequence[str], measure: str, k: int, out: str = "rank") -> DataFrame:
    """Rows ranked ``k`` or better by ``measure``, highest first; ties share a rank and are kept."""
    order = W.partitionBy(*part).orderBy(_descending(measure))
    return df.withColumn(out, F.rank().over(order)).filter(F.col(out) <= k)


def first_per(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], n: int, out: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group in a total order."""
    name = out or "_row"
    kept = df.withColumn(name, F.row_number().over(W.partitionBy(*part).orderBy(*order))).filter(F.col(name) <= n)
    return kept if out else kept.drop(name)


def topk_enrich(df: DataFrame, part: Sequence[str], measure: str, k: int, dim: DataFrame, on: str) -> DataFrame:
    """Rank first, then join the few kept rows to the dimension.

    The ranked rows are written first: when they are small, as they should be,
    the dimension is scanned in place instead of being shuffled.
    """
    return dim.join(written(top_ranked(df, part, measure, k), "ranked"), on)


def running_sum(df: DataFrame, part: Sequence[str], order: str, column: str, out: str) -> DataFrame:
    """Sum up to and including peers of the current row (RANGE frame). For calendar-sized groups."""
    frame = W.partitionBy(*part).orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.sum(column).over(frame))


def lag_by(df: DataFrame, part: Sequence[str], order: str | Column, column: str, n: int, out: str, default=None) -> DataFrame:
    """Value ``n`` rows earlier. For calendar-sized groups; see ``ordered.following`` for large ones."""
    return df.withColumn(out, F.lag(column, n, default).over(W.partitionBy(*part).orderBy(order)))


def moving_average(df: DataFrame, date: str, column: str, days: int, out: str, part: Sequence[str] = ()) -> DataFrame:
    """Average over the rows within ``days`` days on both sides.

    Expects one row per day (and ``part``); missing days are not counted as zero.
    """
    frame = W.partitionBy(*part).orderBy(F.unix_date(date)).rangeBetween(-days, days)
    return df.withColumn(out, F.avg(column).over(frame))


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The greatest row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def earliest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row of each key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def last_n(df: DataFrame, keys: Sequence[str], number: str, upper: DataFrame, next_number: str, n: int) -> DataFrame:
    """Rows numbered in ``[max(1, next - n), next)`` of each key; ``upper`` holds the next number per key."""
    low = F.greatest(F.lit(1), F.col(next_number) - n)
    return split_join(df, upper, keys).filter((F.col(number) >= low) & (F.col(number) < F.col(next_number)))


def pct_change(df: DataFrame, order: str, column: str, out: str, part: Sequence[str] = ()) -> DataFrame:
    """Percent change to the previous row, null where that is zero or missing."""
    previous = F.lag(column).over(W.partitionBy(*part).orderBy(order))
    change = (F.col(column) - previous) / F.nullif(previous, F.lit(0)) * 100
    return df.withColumn(out, F.round(change, 2))
