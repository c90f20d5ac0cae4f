"""Rows with a validity range: circle members and their history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.operators.changes import append
from tallygrain.operators.ordered import following
from tallygrain.operators.windows import first_per, lag_by
from tallygrain.session import written


def scd2_current(df: DataFrame) -> DataFrame:
    """Members valid now."""
    return df.filter(F.col("valid_to").isNull())


def scd2_history(
    events: DataFrame, key: Sequence[str], ts: Sequence[str], out: str, blocks: Sequence[Column]
) -> DataFrame:
    """All versions of every key; a version ends where the next one begins."""
    return following(events, key, ts, ts[0], out, blocks)


def scd2_apply(
    members: DataFrame, changes: DataFrame, owner: str, index: str, seq: Sequence[str], allowance: int
) -> tuple[DataFrame, DataFrame]:
    """Set members of a circle; returns the new versions table and the rejected changes.

    The first ``allowance`` changes of an owner, in ``seq`` order, are taken and
    the rest rejected; ``seq`` tells an owner's changes apart and holds no nulls. A taken change closes the open version of its member and
    opens a new one at ``seq[0]``; of several to one member each closes the one before.
    """
    taken = written(first_per(changes, [owner], seq, allowance), "taken")
    rejected = changes.join(taken.select(owner, *seq), [owner, *seq], "left_anti")
    # at most `allowance` rows per owner from here on
    since = seq[0]
    opened = taken.withColumn("valid_from", F.col(since))
    ended = lag_by(opened.withColumn("_s", F.struct(*seq)), [owner, index], F.col("_s").desc(), since, 1, "valid_to")
    first_change = taken.groupBy(owner, index).agg(F.min(since).alias("_closed"))
    closed = members.join(first_change, [owner, index], "left").withColumn(
        "valid_to", F.coalesce("valid_to", "_closed")
    )
    return append(closed.select(*members.columns), ended.select(*members.columns)), rejected
