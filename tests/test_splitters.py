"""Equi-depth blocks: even in size, in order, whatever the values look like."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import splitters


def names(kind, n):
    rng = random.Random(5)
    letters = "abcdefghij"
    size = {"one length": lambda: 8, "mixed": lambda: rng.choice([1, 2, 3, 5, 40]), "long": lambda: 6, "prefix": lambda: 5}[kind]
    out = ["".join(rng.choice(letters) for _ in range(size())) for _ in range(n)]
    if kind == "prefix":
        out = ["the same beginning " * 20 + x for x in out]
    if kind == "long":
        out[7] = "z" * 200
    return out


@pytest.mark.parametrize("kind", ["one length", "mixed", "long", "prefix"])
def test_blocks_are_even_and_in_order(table, kind):
    n, rows = 20_000, 1000
    found = names(kind, n)
    # a third of all rows in one group
    data = [("hot" if i % 3 == 0 else f"g{i % 50}", x, i) for i, x in enumerate(found)]
    df = splitters.with_block(table(data, "g string, name string, id long"), ["g", "name", "id"], "b", rows, "head", "last")
    got = df.collect()
    sizes, spans, heads = {}, {}, {}
    for r in got:
        key = (r["g"], r["name"].encode(), r["id"])
        sizes[r["b"]] = sizes.get(r["b"], 0) + 1
        low, high = spans.get(r["b"], (key, key))
        spans[r["b"]] = min(low, key), max(high, key)
        if r["head"]:
            heads[r["b"]] = key
    assert sum(sizes.values()) == n and sorted(sizes) == list(range(1, len(sizes) + 1))
    assert max(sizes.values()) <= 2 * n / len(sizes)
    assert {r["last"] for r in got} == {len(sizes)}
    assert all(spans[b][1] < spans[b + 1][0] for b in range(1, len(sizes)))
    assert heads == {b: low for b, (low, _) in spans.items()}


def test_types_nulls_and_ties(table):
    when = dt.datetime(2024, 1, 1, 1, 2, 3, 456789)
    data = [(None if i % 7 == 0 else i / 3, when + dt.timedelta(microseconds=i), "x\"\\\n" + str(i % 3), None) for i in range(3000)]
    data += [(1.0, when, "tie", None)] * 500
    df = table(data, "x double, t timestamp, s string, n int")
    for columns in (["x", "t", "s", "n"], ["t", "x"], ["n", "s", "t"]):
        found = splitters.with_block(df, columns, "b", 200)
        edges = found.groupBy("b").agg(F.min(F.struct(*columns)).alias("lo"), F.max(F.struct(*columns)).alias("hi"))
        wrong = edges.alias("p").join(edges.alias("q"), F.col("q.b") == F.col("p.b") + 1).filter(F.col("p.hi") >= F.col("q.lo"))
        assert wrong.isEmpty() and found.count() == 3500 and edges.count() > 5


def test_few_rows_and_none(table):
    one = splitters.with_block(table([(3,)], "id long"), ["id"], "b", 10, "head", "last").collect()
    assert [tuple(r) for r in one] == [(3, 1, True, 1)]
    assert splitters.with_block(table([], "id long"), ["id"], "b").count() == 0
