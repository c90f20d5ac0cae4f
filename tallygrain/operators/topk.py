"""Top rows, per-parent browsing, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.scalars import hash_key
from tallygrain.operators.joins import with_details
from tallygrain.operators.windows import first_per


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows (each task keeps its own ``n``, the driver side merges them)."""
    return df.orderBy(*order).limit(n)


def browse(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, out: str | None = None) -> DataFrame:
    """Up to ``n`` child rows per parent in a stable order."""
    return first_per(df, keys, order, n, out)


def worklist(orders: DataFrame, order: Sequence[str | Column], n: int, *details: tuple[DataFrame, str, str]) -> DataFrame:
    """A bounded work list joined to its details: limit before join."""
    out = orders.orderBy(*order).limit(n)
    for other, on, how in details:
        out = with_details(out, other, [on], how)
    return out


def sample_by(df: DataFrame, column: str, fractions: dict, key: str, seed: int) -> DataFrame:
    """Each row kept with its stratum's probability; strata not named are dropped.

    The draw is a hash of ``key`` and the seed, so a task that runs again, or
    a table laid out in other files, keeps the same rows.
    """
    share = F.lit(0.0)
    for value, fraction in fractions.items():
        share = F.when(F.col(column) == value, F.lit(float(fraction))).otherwise(share)
    return df.filter(hash_key(_salted(key, seed)) < share * 2.0**32)


def _salted(key: str, seed: int) -> Column:
    return F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))


def _draw_order(key: str, seed: int) -> list[Column]:
    # a hash of the key, not rand(): the same draw after a task is run again
    return [F.md5(_salted(key, seed)), F.col(key)]


def random_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn at random, repeatable for a seed."""
    return df.orderBy(*_draw_order(key, seed)).limit(n)


def draw_categories(df: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    """Rows of ``k`` distinct values of ``column`` drawn without replacement."""
    drawn = random_n(df.select(column).distinct(), column, k, seed)
    return df.join(drawn, column, "left_semi")
