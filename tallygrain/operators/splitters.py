"""Equi-depth blocks: cut points drawn from the data itself.

A sample of rows, taken by a hash of the named columns, is sorted; every so
many samples one becomes a *cut*. The block of a row is the number of cuts that
are not behind it, found by binary search, so blocks are runs of consecutive
rows and hold about the same number of rows whatever the values look like:
names of any length, one common prefix, ids in clusters. Equal rows cannot be
told apart, so name enough columns (an id last) to keep them different.

Cuts are values of rows, hence a recomputed task finds the same blocks. The
sample has at most ``MOST_SAMPLES`` rows; larger tables get larger blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_BLOCK = 4096
SAMPLES_A_BLOCK = 128  # a block is then within twice the mean, five deviations away
MOST_SAMPLES = 1 << 20
SMALL_BYTES = 1 << 30  # by Spark's estimate; larger tables are counted
# times in full
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sampled_every(df: DataFrame, rows: int) -> int:
    """One row in how many is drawn: enough for the blocks, and no more than ``MOST_SAMPLES`` in all."""
    every = max(1, rows // SAMPLES_A_BLOCK)
    # a small table need not be counted first
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return every
    return max(every, -(-df.count() // MOST_SAMPLES))


def cuts(df: DataFrame, columns: Sequence[str], rows: int = ROWS_A_BLOCK) -> tuple[Column, int]:
    """The cut points as one array of structs, the table's first row leading, and their number; null columns sort first.

    They are computed at once and handed on as a constant, since an array that
    comes from a subquery would be copied into every row.
    """
    key, drawn = F.struct(*columns), F.xxhash64(*columns)
    each = min(SAMPLES_A_BLOCK, rows)
    taken = F.when(F.pmod(drawn, F.lit(_sampled_every(df, rows))) == 0, key)
    found = df.agg(F.sort_array(F.collect_list(taken)).alias("s"), F.min(key).alias("first"))
    marks = F.filter("s", lambda x, i: i % each == each - 1)
    marks = found.select(F.array_distinct(F.filter(F.concat(F.array("first"), marks), lambda x: x.isNotNull())).alias("cuts"))
    text, size = marks.select(F.to_json("cuts", FORMATS), F.size("cuts")).first()
    return F.from_json(F.lit(text), marks.schema["cuts"].dataType, FORMATS), size


def with_block(
    df: DataFrame,
    columns: Sequence[str],
    out: str,
    rows: int = ROWS_A_BLOCK,
    head: str | None = None,
    last: str | None = None,
) -> DataFrame:
    """Add ``out``: the row's block, 1, 2, .. in the order of ``columns``.

    ``head`` names an optional column that tells whether the row is the first
    of its block, ``last`` one with the number of blocks.
    """
    key = F.struct(*columns)
    marks, size = cuts(df, columns, rows)
    if size <= 1 and not head:
        return df.withColumns({out: F.lit(1)} | ({last: F.lit(size)} if last else {}))
    steps = F.array(*[F.lit(1 << i) for i in range(max(size, 1).bit_length() - 1, -1, -1)])

    def place(marks: Column) -> Column:
        found = F.aggregate(
            steps, F.lit(0), lambda at, step: F.when(F.get(marks, at + step - 1) <= key, at + step).otherwise(at)
        )
        return once(found, lambda at: F.struct(at.alias("at"), (F.get(marks, at - 1) == key).alias("head"), F.size(marks).alias("last")))

    df = df.withColumn("_place", once(marks, place))
    named = {out: "at"} | ({head: "head"} if head else {}) | ({last: "last"} if last else {})
    return df.withColumns({name: F.col("_place").getField(field) for name, field in named.items()}).drop("_place")
