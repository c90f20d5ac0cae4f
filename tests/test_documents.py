"""Nested documents, chunked arrays, sources and files."""

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import documents
from tallygrain.operators.aggregates import collect_chunks
from tallygrain.operators.ordered import block_of
from tallygrain.session import work_folder
from tallygrain.sources import files, tables

ROWS = 4  # a small chunk, so that documents span several


@pytest.fixture(scope="module")
def comments(table):
    return table([(1, i, f"n{i}", f"c{i}") for i in range(10)] + [(2, 0, "n", "c")], "id int, idx long, name string, comment string")


@pytest.fixture(scope="module")
def docs(table, comments):
    parent = table([(1,), (2,), (3,)], "id int")
    chunks = collect_chunks(comments, ["id"], "idx", ["name", "comment"], "comments", ROWS)
    return documents.assemble(parent, "id", {"comments": chunks})


def flat(df, field="comment"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["chunk"])):
        assert len(r["comments"]) <= ROWS
        out.setdefault(r["id"], []).extend(e[field] for e in r["comments"])
    return out


def test_assemble_spans_chunks_and_keeps_empty_documents(docs):
    assert flat(docs) == {1: [f"c{i}" for i in range(10)], 2: ["c"], 3: []}
    assert docs.filter("chunk = 0").count() == 3


def test_shred_undoes_assemble(docs, comments, rows):
    back = documents.shred(docs, "id", ["comments"], ROWS)["comments"]
    assert rows(back.select("id", "idx", "value.name", "value.comment")) == rows(comments)


def test_assemble_aligns_children_of_different_length(table):
    parent = table([(1,)], "id int")
    kids = {
        "a": collect_chunks(table([(1, i, i) for i in range(9)], "id int, idx long, v int"), ["id"], "idx", ["v"], "a", ROWS),
        "b": collect_chunks(table([(1, 0, 5)], "id int, idx long, v int"), ["id"], "idx", ["v"], "b", ROWS),
    }
    got = documents.assemble(parent, "id", kids).orderBy("chunk").collect()
    assert [(len(r["a"]), len(r["b"])) for r in got] == [(4, 1), (4, 0), (1, 0)]


def test_append_numbers_elements_from_the_old_size(docs, table):
    new = table([(1, 5, "x"), (1, 7, "y"), (2, 1, "z"), (3, 1, "e"), (9, 1, "none")], "id int, seq long, text string")

    def fields(i):
        return [F.col("text").alias("name"), F.concat(F.lit("/comments/"), i.cast("string")).alias("comment")]

    after = documents.doc_append(docs, new, "id", "comments", ["seq"], [block_of("seq", 2)], fields, ROWS)
    got = flat(after)
    assert got[1][10:] == ["/comments/10", "/comments/11"]
    assert got[2] == ["c", "/comments/1"] and got[3] == ["/comments/0"] and 9 not in got


def test_append_many_to_one_document(docs, table):
    new = table([(2, i, f"t{i}") for i in range(50)], "id int, seq long, text string")
    after = documents.doc_append(
        docs, new, "id", "comments", ["seq"], [block_of("seq", 8)],
        lambda i: [F.col("text").alias("name"), i.cast("string").alias("comment")], ROWS,
    )
    assert flat(after, "name")[2] == ["n", *[f"t{i}" for i in range(50)]]


def test_set_element_last_change_wins_across_chunks(docs, table):
    ch = table([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 9, 1, "z"), (1, 77, 1, "gone"), (2, 0, 1, None)], "id int, i int, seq int, v string")
    got = flat(documents.doc_set_element(docs, ch, "id", "comments", "i", "comment", "v", ["seq"], ROWS))
    assert got[1] == ["b", *[f"c{i}" for i in range(1, 9)], "z"] and got[2] == [None]


def test_remove_element(docs, table):
    ch = table([(1, 0), (1, 5), (1, 5), (3, 0)], "id int, i int")
    got = flat(documents.doc_remove_element(docs, ch, "id", "comments", "i", ROWS))
    assert got == {1: ["c1", "c2", "c3", "c4", "c6", "c7", "c8", "c9"], 2: ["c"], 3: []}


def test_edits_after_a_removal_find_their_elements(docs, table):
    """Remove, set, append and remove again over three chunks, against a plain list."""
    want = [f"c{i}" for i in range(10)]
    gone = table([(1, 0), (1, 1), (1, 6), (2, 0)], "id int, i int")
    after = documents.doc_remove_element(docs, gone, "id", "comments", "i", ROWS)
    want = [w for i, w in enumerate(want) if i not in (0, 1, 6)]
    assert flat(after) == {1: want, 2: [], 3: []}
    ch = table([(1, 1, 1, "one"), (1, 4, 1, "four"), (1, 6, 1, "six"), (1, 7, 1, "none")], "id int, i int, seq int, v string")
    after = documents.doc_set_element(after, ch, "id", "comments", "i", "comment", "v", ["seq"], ROWS)
    want[1], want[4], want[6] = "one", "four", "six"
    assert flat(after)[1] == want
    new = table([(1, s, f"new{s}") for s in range(6)] + [(2, 1, "first")], "id int, seq long, text string")
    after = documents.doc_append(
        after, new, "id", "comments", ["seq"], [block_of("seq", 2)],
        lambda i: [i.cast("string").alias("name"), F.col("text").alias("comment")], ROWS,
    )
    want += [f"new{s}" for s in range(6)]
    assert flat(after) == {1: want, 2: ["first"], 3: []}
    sizes = {(r["id"], r["chunk"]): len(r["comments"]) for r in after.collect()}
    assert [sizes[1, c] for c in range(4)] == [4, 4, 4, 1] and (2, 0) in sizes and (3, 0) in sizes
    gone = table([(1, i) for i in range(1, 12)], "id int, i int")
    after = documents.doc_remove_element(after, gone, "id", "comments", "i", ROWS)
    assert flat(after)[1] == [want[0], want[12]] and after.filter("id = 1").count() == 1


def test_unnest_keeps_parents_without_elements(table, rows):
    df = table([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, None)], "id int, tags array<string>")
    assert rows(documents.unnest_count(df, "tags", None)) == [("a", 2), ("b", 1), (None, 2)]


def test_repeated_category_counts_differ_by_form(table, rows):
    df = table([(1, 0, ["x", "x"], ["c", "c"]), (2, 0, ["x"], [])], "id int, chunk long, cats array<string>, comments array<string>")
    assert rows(documents.unnest_measure(df, "id", "cats", "comments")) == [("x", 3, 4)]


def test_largest_arrays_adds_chunks(docs, rows):
    assert rows(documents.largest_arrays(docs, "id", "comments", 2)) == [(1, 10), (2, 1)]


def test_doc_set_changes_only_named_documents(table, rows):
    df = table([(1, ("a", "t")), (2, ("b", "t"))], "id int, doc struct<name: string, title: string>")
    ch = table([(1, 1, "x"), (1, 3, "z"), (1, 2, "y")], "id int, seq int, v string")
    assert rows(documents.doc_set(df, ch, "id", "title", "v", ["seq"]), "id", "doc.title") == [(1, "z"), (2, "t")]


def test_quoted_json_is_repaired(table):
    df = documents.normalise_json_text(table([(1, "['a','b']"), (2, None)], "id int, g string"), ["g"])
    assert {r["id"]: r["g"] for r in df.collect()} == {1: ["a", "b"], 2: []}


def test_json_value_is_null_when_absent_or_wrong_kind(table):
    df = table([('{"a":{"b":"7"},"t":"x"}',)], "j string")
    row = df.select(
        documents.json_value("j", "$.a.b", "int"), documents.json_value("j", "$.a.z", "int"), documents.json_value("j", "$.t", "int")
    ).first()
    assert tuple(row) == (7, None, None)


# --- sources ------------------------------------------------------------------------
def test_documents_round_trip_with_nulls(spark, table, rows):
    path = work_folder(spark, "t")
    df = table([(1, ("a", None)), (2, None)], "id int, n struct<f: string, g: string>")
    files.write_documents(df, path)
    assert sorted(r["value"] for r in files.read_lines(spark, path).collect()) == [
        '{"id":1,"n":{"f":"a","g":null}}', '{"id":2,"n":null}']
    assert rows(files.read_documents(spark, path, df.schema)) == rows(df)


def test_line_list_skips_blank_lines(spark):
    path = work_folder(spark, "t")
    spark.createDataFrame([("a",), ("",), (" ",), ("b c",)], "v string").write.text(path)
    assert sorted(r[0] for r in files.read_lines(spark, path).collect()) == ["a", "b c"]


def test_malformed_delimited_line_stops_the_read(spark):
    path = work_folder(spark, "t")
    spark.createDataFrame([("1,x",), ("no,y",)], "v string").write.text(path)
    with pytest.raises(Exception):
        files.read_delimited(spark, path, "n int, s string").collect()


def test_marker_groups_span_blocks(table, rows):
    recs = [(1, i, "New" if i in (0, 3, 40) else "Upd") for i in range(60)] + [(2, 0, "Upd"), (2, 1, "New")]
    got = tables.group_by_marker(table(recs, "f int, pos long, tag string"), ["f"], ["pos"], "tag", "New", [block_of("pos", 7)], "g")
    counts = rows(got.groupBy("f", "g").count())
    assert counts == [(1, 1, 3), (1, 2, 37), (1, 3, 20), (2, 0, 1), (2, 1, 1)]


def test_metadata_bounds_fall_back_to_the_data(table):
    meta = table([("MIN", "5"), ("OTHER", "1")], "metadata_key string, metadata_value string")
    row = tables.metadata_bounds(meta, {"MIN": F.min("k"), "MAX": F.max("k")}, table([(7,), (9,)], "k int")).first()
    assert (row["MIN"], row["MAX"]) == (5, 9)


def test_statements_run_in_order(spark, table):
    views = {"t": table([(1,), (2,)], "x int")}
    got = tables.run_statements(spark, [("b", "select * from {t}"), ("a", "select * from {t} where x > 1")], views)
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(1, "b", 2), (2, "a", 1)]


def test_validate_reports_wrong_and_missing(table, rows):
    got = tables.validate({"t": table([(1, "x")], "a int, b string")}, {"t": {"a": "int", "b": "int", "c": "int"}, "u": {"z": "int"}})
    assert rows(got) == [("t", "invalid", 1, 1, 1, 1), ("u", "missing", 0, 0, 1, 0)]


def test_jdbc_options_split_the_key_range():
    options = tables.jdbc_options("jdbc:x", "t", '"ID"', 0, 1000, 16)
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == ('"ID"', "0", "1000", "16")
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "t", "id", 5, 4, 1)
