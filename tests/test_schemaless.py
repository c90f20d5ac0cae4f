"""VARIANT documents: fields absent, null, scalar or array in one collection."""

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import schemaless as sl

LINES = [
    '{"id": 1, "name": {"first": "Ann", "age": 30}, "tags": ["a", "b"], "ok": true, "price": 1.5}',
    '{"id": 2, "name": {"first": "Bob"}, "tags": "a", "ok": false, "price": 2}',
    '{"id": 3, "name": null, "tags": null, "ok": true, "price": 0.25}',
    '{"id": 4, "tags": [], "ok": true, "price": -1}',
    '{"id": "5", "name": "Eve", "tags": {"k": 1}, "ok": "true", "price": "3"}',
    '{"id": 6, "name": {"first": 7, "age": "30"}, "tags": [["x"], null, 3], "ok": null, "price": 1e3}',
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "lines")
    spark.createDataFrame([(x,) for x in [*LINES, "not json", ""]], "value string").coalesce(1).write.text(path)
    return sl.read_variants(spark, path)


def column(docs, value):
    return [r[0] for r in docs.filter("doc is not null").orderBy("value").select(value).collect()]


def test_lines_that_are_no_json_are_null(docs):
    assert docs.filter("doc is null").count() == 2 and docs.count() == 8


def test_values_by_path_and_type(docs):
    docs = docs.orderBy("value")
    assert column(docs, sl.typed("doc", "$.id", "bigint")) == [None, 1, 2, 3, 4, 6]
    assert column(docs, sl.typed("doc", "$.id", "string")) == ["5", None, None, None, None, None]
    assert column(docs, sl.typed("doc", "$.name.first", "string")) == [None, "Ann", "Bob", None, None, None]
    assert column(docs, sl.typed("doc", "$.name.age", "bigint")) == [None, 30, None, None, None, None]
    assert column(docs, sl.typed("doc", "$.ok", "boolean")) == [None, True, False, True, True, None]
    assert column(docs, sl.typed("doc", "$.price", "double")) == [None, 1.5, 2.0, 0.25, -1.0, 1000.0]
    assert column(docs, sl.kind(sl.at("doc", "$.name"))) == ["STRING", "OBJECT", "OBJECT", "VOID", None, "OBJECT"]
    assert column(docs, sl.typed("doc", "$.no.where", "bigint")) == [None] * 6


def test_elements_of_absent_single_and_arrays(docs):
    assert column(docs, F.size(sl.elements("doc", "$.tags"))) == [1, 2, 1, 0, 0, 3]
    texts = F.transform(sl.elements("doc", "$.tags"), lambda v: F.to_json(v))
    assert column(docs, texts) == [['{"k":1}'], ['"a"', '"b"'], ['"a"'], [], [], ['["x"]', "null", "3"]]


def test_examples_match_by_value_and_type(docs):
    def ids(example):
        return [r[0] for r in docs.filter(sl.matches("doc", example)).orderBy("value").select(F.substr("value", F.lit(1), F.lit(9))).collect()]

    assert len(ids({"name": {"first": "Ann"}, "ok": True})) == 1
    assert len(ids({"ok": True})) == 3 and len(ids({"price": 2.0})) == 1 and len(ids({"id": 5})) == 0 and len(ids({"id": "5"})) == 1
    assert len(ids({"name": None})) == 2 + 2  # null, absent, and the two lines that are no documents
    assert len(ids({})) == 8


def test_schema_and_fields_by_aggregation(docs):
    found = {(r["field"], r["kind"]): r["n"] for r in sl.fields_of(docs).collect()}
    assert found["id", "BIGINT"] == 5 and found["id", "STRING"] == 1 and found["tags", "ARRAY"] == 3 and found["name", "VOID"] == 1
    text = sl.schema_of(docs)
    assert text.startswith("OBJECT<") and "id: VARIANT" in text


def test_hot_fields_become_columns(spark):
    rows = [(f'{{"a": {i}, "b": "t{i}", "c d": {i}.5' + (f', "rare": {i}' if i % 10 == 0 else "") + (', "mixed": 1' if i % 2 else ', "mixed": "x"') + "}",) for i in range(100)]
    docs = spark.createDataFrame(rows, "value string").select(F.try_parse_json("value").alias("doc"), F.lit("mine").alias("B"))
    shredded = sl.shred(docs)
    assert shredded.dtypes[2:] == [("a", "bigint"), ("c d", "double")] and shredded.columns[:2] == ["doc", "B"]
    assert sorted(r["a"] for r in shredded.collect()) == list(range(100))
    assert sl.shred(docs.limit(0)).columns == ["doc", "B"]
