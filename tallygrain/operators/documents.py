"""Nested documents: unnesting, assembling, shredding and editing.

An array of any length is kept as chunks: a document is one row per chunk,
chunk 0 always present, element ``i`` at place ``i % rows`` of chunk
``i div rows``. An ordinary document is a single row with chunk 0; one with a
million comments is many rows of bounded size, edited in place chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tallygrain.operators.aggregates import collect_chunks
from tallygrain.operators.joins import new_only, semi, split_join
from tallygrain.operators.ordered import block_of, position
from tallygrain.operators.windows import latest_per
from tallygrain.session import written


def json_value(column: str | Column, path: str, kind: str) -> Column:
    """A value by JSON path as ``kind``; null when absent or not of that kind."""
    return F.get_json_object(column, path).try_cast(kind)


def unnest_count(df: DataFrame, array: str, field: str | None, out: str = "name") -> DataFrame:
    """Rows per element value; documents with an empty array count under null."""
    element = F.explode_outer(array)
    names = df.select(element.alias("_e")).select((F.col("_e")[field] if field else F.col("_e")).alias(out))
    return names.groupBy(out).agg(F.count(F.lit(1)).alias("n"))


def unnest_measure(df: DataFrame, key: str, array: str, measured: str) -> DataFrame:
    """Per element of ``array``: documents holding it (each repeat counts) and the total size of ``measured``."""
    # sizes add up over chunks; the unnested array sits in chunk 0
    sizes = df.groupBy(key).agg(F.sum(F.size(measured)).alias("_size"))
    named = df.filter("chunk = 0").select(key, F.explode_outer(array).alias("name"))
    return named.join(sizes, key).groupBy("name").agg(
        F.count(F.lit(1)).alias("total_articles"), F.sum("_size").alias("total_comments")
    )


def largest_arrays(df: DataFrame, key: str, array: str, n: int, out: str = "n") -> DataFrame:
    sizes = df.groupBy(key).agg(F.sum(F.size(array)).alias(out))
    return sizes.orderBy(F.desc(out), key).limit(n)


def assemble(parent: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parent rows with one array column per child table, empty where there is nothing.

    Each child is ``(key, chunk, <name>)`` as made by ``collect_chunks`` or
    ``collect_ordered``.
    """
    chunks: DataFrame | None = None
    for child in children.values():
        chunks = child if chunks is None else chunks.join(child, [key, "chunk"], "full")
    out = parent.join(chunks, key, "left").withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("long")))
    for name in children:
        kind = out.schema[name].dataType
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def to_document(columns: dict[str, str | Column]) -> Column:
    """One JSON text from the given fields, nulls kept."""
    fields = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def normalise_json_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of JSON text arrays written with single quotes, as arrays; null becomes empty."""
    repaired = {
        c: F.from_json(F.replace(F.coalesce(c, F.lit("[]")), F.lit("'"), F.lit('"')), "array<string>") for c in columns
    }
    return df.withColumns(repaired)


def shred(df: DataFrame, key: str, arrays: Sequence[str], rows: int) -> dict[str, DataFrame]:
    """One flat table ``(key, idx, value)`` per array column."""
    tables = {}
    for name in arrays:
        flat = df.select(key, "chunk", F.posexplode(name).alias("_p", "value"))
        tables[name] = flat.select(key, (F.col("chunk") * rows + F.col("_p")).alias("idx"), "value")
    return tables


def doc_set(df: DataFrame, changes: DataFrame, key: str, field: str, value: str, seq: Sequence[str]) -> DataFrame:
    """Set ``field`` of a document's ``doc`` struct; the last change of a key wins."""
    last = latest_per(changes.select(key, value, *seq), [key], seq).select(
        key, F.col(value).alias("_value"), F.lit(True).alias("_hit")
    )
    joined = df.join(last, key, "left")
    edited = F.when(F.col("_hit"), F.col("doc").withField(field, F.col("_value"))).otherwise(F.col("doc"))
    return joined.withColumn("doc", edited).drop("_value", "_hit")


def doc_append(
    df: DataFrame,
    new: DataFrame,
    key: str,
    array: str,
    order: Sequence[str],
    blocks: Sequence[Column],
    fields: Callable[[Column], list[Column]],
    rows: int,
) -> DataFrame:
    """Append elements; ``fields(i)`` builds an element from its change row and its index ``i``.

    Appends to documents that do not exist are ignored. Elements beyond a full
    chunk open the next one.
    """
    sizes = df.groupBy(key).agg(F.sum(F.size(array)).alias("_size"))
    placed = position(split_join(new, sizes, [key]), [key], order, "_n", blocks).withColumn(
        "_i", F.col("_size") + F.col("_n") - 1
    )
    built = placed.select(key, "_i", F.struct(*fields(F.col("_i"))).alias("_e")).select(key, "_i", "_e.*")
    names = [c for c in built.columns if c not in (key, "_i")]
    # read twice: for the chunks it changes or opens, and to tell the rest, which stays where it is
    added = written(collect_chunks(built, [key], "_i", names, "_added", rows), "added")
    kind = added.schema["_added"].dataType
    empty = F.array().cast(kind)
    on = [key, "chunk"]
    # both sides have a chunk once
    changed = added.join(df.join(added.select(*on), on, "left_semi"), on, "left")
    longer = F.concat(F.coalesce(F.col(array).cast(kind), empty), F.col("_added"))
    rest = df.join(added.select(*on), on, "left_anti")
    return rest.unionByName(changed.withColumn(array, longer).select(*df.columns))


def _changes_per_chunk(changes: DataFrame, key: str, index: str, rows: int, collected: Column) -> DataFrame:
    # one change per element by now: at most `rows` entries per chunk
    return changes.groupBy(key, block_of(index, rows).alias("chunk")).agg(collected.alias("_changes"))


def doc_set_element(
    df: DataFrame, changes: DataFrame, key: str, array: str, index: str, field: str, value: str, seq: Sequence[str], rows: int
) -> DataFrame:
    """Set ``field`` of element ``index``; the last change of an element wins."""
    last = latest_per(changes.select(key, index, value, *seq), [key, index], seq)
    place = F.pmod(F.col(index).cast("long"), F.lit(rows)).cast("int")
    per_chunk = _changes_per_chunk(
        last, key, index, rows, F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.col(value).alias("v"))))
    )
    edited = F.transform(
        array,
        lambda e, i: F.when(F.map_contains_key("_changes", i), e.withField(field, F.col("_changes")[i])).otherwise(e),
    )
    joined = df.join(per_chunk, [key, "chunk"], "left")
    return joined.withColumn(array, F.when(F.col("_changes").isNull(), F.col(array)).otherwise(edited)).drop("_changes")


def doc_remove_element(df: DataFrame, changes: DataFrame, key: str, array: str, index: str, rows: int) -> DataFrame:
    """Drop the elements at the given indexes; later elements move up, so chunks stay full.

    A chunk whose arrays are all empty goes, chunk 0 stays.
    """
    place = F.pmod(F.col(index).cast("long"), F.lit(rows)).cast("int")
    per_chunk = _changes_per_chunk(changes, key, index, rows, F.collect_set(place))
    joined = semi(df, changes, [key]).join(per_chunk, [key, "chunk"], "left")
    kept = F.filter(array, lambda e, i: ~F.array_contains(F.col("_changes"), i))
    cut = joined.withColumn(array, F.when(F.col("_changes").isNull(), F.col(array)).otherwise(kept)).drop("_changes")
    # where each chunk's elements go: one narrow row a chunk
    earlier = W.partitionBy(key).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = cut.select(key, "chunk", F.size(array).cast("long").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = cut.join(before, [key, "chunk"])
    room = (rows - F.pmod("_before", F.lit(rows))).cast("int")
    into = F.floor(F.col("_before") / rows)
    # a chunk has at most ``rows`` elements, so they fall into two new chunks at most
    parts = F.explode(
        F.array(
            F.struct(into.alias("to"), F.slice(array, F.lit(1), room).alias("part")),
            F.struct((into + 1).alias("to"), F.slice(array, room + 1, F.lit(rows)).alias("part")),
        )
    )
    pieces = placed.select(key, "chunk", parts.alias("_p")).filter(F.size("_p.part") > 0)
    rows_of = F.array_sort(F.collect_list(F.struct("chunk", "_p.part")))
    moved = pieces.groupBy(key, F.col("_p.to").alias("_to")).agg(rows_of.alias("_parts"))
    moved = moved.select(key, F.col("_to").alias("chunk"), F.flatten(F.col("_parts.part")).alias("_moved"))
    empty = F.array().cast(df.schema[array].dataType)
    full = cut.drop(array).join(moved, [key, "chunk"], "left").withColumn(array, F.coalesce("_moved", empty)).drop("_moved")
    some = F.col("chunk") == 0
    for f in df.schema:
        if isinstance(f.dataType, ArrayType):
            some = some | (F.size(f.name) > 0)
    return new_only(df, changes, [key]).unionByName(full.filter(some))


def expand_offers(df: DataFrame, array: str, out: str) -> DataFrame:
    """One row per element of an array column."""
    return df.withColumn(out, F.explode(array)).drop(array)
