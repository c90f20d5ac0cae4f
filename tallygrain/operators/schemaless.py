"""Documents without a declared schema, as VARIANT columns.

A collection is read as lines of JSON; fields may be absent, null, a scalar in
one document and an array in the next. Paths are read with a check of the
value's own type, so a number written as a text is no number. The schema is
found by aggregation, and fields that most documents have can be shredded into
typed columns, the whole document staying beside them for the rest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# what a value's own type must begin with to be read as a type
KINDS = {
    "bigint": ("BIGINT",),
    "double": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
}


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """A JSON collection, a document a line: ``doc``, null where the line is no JSON, and the line as ``value``."""
    return spark.read.text(path).select("value", F.try_parse_json("value").alias("doc"))


def at(doc: str | Column, path: str) -> Column:
    """The value at a path, null if absent."""
    return F.try_variant_get(doc, path, "variant")


def kind(value: Column) -> Column:
    """The type of a value: ``OBJECT``, ``ARRAY``, ``STRING``, ``BIGINT``, ..; ``VOID`` for a null, null for an absent one."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def typed(doc: str | Column, path: str, wanted: str) -> Column:
    """The value at a path if it is of the wanted type itself, else null."""
    return F.when(kind(at(doc, path)).isin(*KINDS[wanted]), F.try_variant_get(doc, path, wanted))


def elements(doc: str | Column, path: str) -> Column:
    """What is at a path as an array: its elements, a single value as one, nothing for a null or absent one."""
    value = at(doc, path)
    empty = F.array().cast("array<variant>")
    many = F.try_variant_get(doc, path, "array<variant>")
    return F.when(value.isNull() | (kind(value) == "VOID"), empty).when(kind(value) == "ARRAY", many).otherwise(F.array(value))


def matches(doc: str | Column, example: Mapping) -> Column:
    """Whether a document has every field of the example with that value; None stands for null or absent."""

    def paths(prefix: str, spec: Mapping):
        for name, wanted in spec.items():
            path = f"{prefix}.{name}"
            if isinstance(wanted, Mapping):
                yield from paths(path, wanted)
            elif wanted is None:
                yield F.coalesce(kind(at(doc, path)), F.lit("VOID")) == "VOID"
            else:
                types = {bool: "boolean", int: "bigint", float: "double", str: "string"}
                yield F.coalesce(typed(doc, path, types[type(wanted)]) == F.lit(wanted), F.lit(False))

    out = F.lit(True)
    for part in paths("$", example):
        out = out & part
    return out


def schema_of(docs: DataFrame, doc: str = "doc") -> str:
    """The one schema that holds all documents, as text; fields of several types are VARIANT."""
    return docs.agg(F.schema_of_variant_agg(doc)).first()[0]


def fields_of(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Per top-level field and type: field, kind, n (documents that have it so)."""
    held = docs.select(F.col(doc).alias("_doc"))
    parts = docs.sparkSession.sql("select key as field, value from {held}, lateral variant_explode(_doc)", held=held)
    return parts.groupBy("field", kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def shred(docs: DataFrame, doc: str = "doc", share: float = 0.9) -> DataFrame:
    """The documents with a typed column for each scalar field that a ``share`` of them have, all of one type.

    Columns are named like the fields; other fields, and other types, are found
    in the document itself.
    """
    size = docs.count()
    types = {"BIGINT": "bigint", "STRING": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "DECIMAL": "double"}
    # as many rows as the collection has fields
    found = [r for r in fields_of(docs, doc).collect() if r["kind"] in types and r["n"] >= share * size > 0]
    taken = {c.lower() for c in docs.columns}
    hot = {r["field"]: types[r["kind"]] for r in found if r["field"].lower() not in taken and "'" not in r["field"]}
    return docs.withColumns({name: typed(doc, f"$['{name}']", t) for name, t in sorted(hot.items())})
