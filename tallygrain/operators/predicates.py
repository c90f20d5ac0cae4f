"""Filters and key lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.operators import joins


def lookup(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``."""
    return joins.semi(df, keys, on)


def lookup_count(df: DataFrame, keys: DataFrame, on: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key of ``keys``, zero included. Counted before the join, so a hot key is one row in it."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias(out))
    return keys.select(*on).distinct().join(counts, list(on), "left").withColumn(out, F.coalesce(out, F.lit(0)))


def where_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column, or SQL expression, is one of the values."""
    return df.filter(F.expr(column).isin(*values))


def where_between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Closed range."""
    return df.filter(F.col(column).between(F.lit(low), F.lit(high)))


def find_by_name(
    df: DataFrame, names: dict[str, str], order: Sequence[str | Column], n: int
) -> DataFrame:
    """First ``n`` rows whose named columns equal the given texts, ignoring case."""
    match = reduce(and_, [F.lower(F.col(c)) == F.lower(F.lit(v)) for c, v in names.items()])
    return df.filter(match).orderBy(*order).limit(n)


def filter_by_example(df: DataFrame, example: dict) -> DataFrame:
    """Rows equal to the example document in every field it gives; nested dicts name nested fields."""

    def paths(prefix: str, spec: dict):
        for name, wanted in spec.items():
            path = f"{prefix}{name}"
            if isinstance(wanted, dict):
                yield from paths(f"{path}.", wanted)
            else:
                yield F.col(path).eqNullSafe(F.lit(wanted))

    return df.filter(reduce(and_, paths("", example), F.lit(True)))


def exists_flag(candidates: DataFrame, df: DataFrame, on: Sequence[str], out: str = "found") -> DataFrame:
    """Mark the candidates whose key occurs in ``df``."""
    present = df.select(*on).distinct().withColumn(out, F.lit(True))
    return joins.split_join(candidates, present, on, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def word_prefix(column: str, term: str) -> Column:
    """True where some word of the text starts with ``term`` (an optional trailing ``*`` is dropped)."""
    stem = term.rstrip("*").strip().lower()
    escaped = "".join(ch if ch.isalnum() else "\\" + ch for ch in stem)
    text = F.lower(F.col(column))
    # the plain search turns most texts away before the pattern sees them
    return text.contains(stem) & text.rlike(rf"(^|[^\p{{L}}\p{{N}}]){escaped}")


def text_prefix_search(
    df: DataFrame, column: str, term: str, order: Sequence[str | Column], n: int
) -> DataFrame:
    """First ``n`` rows, in ``order``, with a word starting with ``term``."""
    return df.filter(word_prefix(column, term)).orderBy(*order).limit(n)


def json_contains(column: str, terms: Sequence[str], mode: str = "&") -> Column:
    """Token search in a JSON text array written with single quotes: all terms (``&``) or any (``|``)."""
    values = F.from_json(F.replace(F.col(column), F.lit("'"), F.lit('"')), "array<string>")
    wanted = F.array(*[F.lit(t) for t in terms])
    if mode == "|":
        return F.arrays_overlap(values, wanted)
    return F.size(F.array_except(wanted, values)) == 0


def indexed_words(term: str) -> list[str] | None:
    """The terms that find a word prefix in an index of letter tokens; None if the term is not a run of letters and digits."""
    stem = term.rstrip("*").strip().lower()
    return [f"{stem}*"] if stem and all(c.isalnum() for c in stem) else None


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
