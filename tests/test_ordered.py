"""Ordered operators on skewed groups against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import aggregates
from tallygrain.operators.ordered import block_of, following, nth_row, position, prefix_block, running_total


def skewed(n=600, seed=1):
    """A third of the rows under one key, some under a null key, ids over many blocks."""
    rnd = random.Random(seed)
    ids = rnd.sample(range(-2000, 20000), n)
    keys = ["hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{rnd.randrange(40)}" for i in range(n)]
    return [(k, i, rnd.randrange(-5, 50)) for k, i in zip(keys, ids)]


@pytest.fixture(scope="module")
def data(table):
    return table(skewed(), "k string, id long, v long")


def groups():
    out = defaultdict(list)
    for k, i, v in skewed():
        out[k].append((i, v))
    return {k: sorted(rs) for k, rs in out.items()}


def test_block_of_handles_negative_numbers(spark):
    got = spark.createDataFrame([(x,) for x in (-11, -10, -1, 0, 9, 10)], "x long").select(block_of("x", 10)).collect()
    assert [r[0] for r in got] == [-2, -1, -1, 0, 0, 1]


def test_position_and_group_size(data, rows):
    got = rows(position(data, ["k"], ["id"], "n", [block_of("id", 100)], total="all"), "k", "id", "n", "all")
    want = [(k, i, n, len(rs)) for k, rs in groups().items() for n, (i, _) in enumerate(rs, 1)]
    assert got == sorted(want, key=repr)


def test_position_without_keys(data, rows):
    got = rows(position(data, [], ["id"], "n", [block_of("id", 100)]), "id", "n")
    assert got == sorted(((i, n) for n, i in enumerate(sorted(i for _, i, _ in skewed()), 1)), key=repr)


def test_running_total(data, rows):
    got = rows(running_total(data, ["k"], ["id"], F.col("v"), "t", [block_of("id", 64)]), "k", "id", "t")
    want = []
    for k, rs in groups().items():
        total = 0
        for i, v in rs:
            total += v
            want.append((k, i, total))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("column", ["id", "v"])
def test_following(data, rows, column):
    got = rows(following(data, ["k"], ["id"], column, "nxt", [block_of("id", 50)]), "k", "id", "nxt")
    want = []
    for k, rs in groups().items():
        for here, there in zip(rs, [*rs[1:], None]):
            want.append((k, here[0], None if there is None else there[0 if column == "id" else 1]))
    assert got == sorted(want, key=repr)


def test_following_tells_a_null_value_from_the_last_row(table, rows):
    df = table([("a", 1, 5), ("a", 70, None), ("a", 140, 7)], "k string, id long, v long")
    got = rows(following(df, ["k"], ["id"], "v", "nxt", [block_of("id", 64)]), "id", "nxt")
    assert got == [(1, None), (140, None), (70, 7)]


def test_nth_row_middle(data, rows):
    middle = nth_row(data, ["k"], ["id"], lambda n: F.floor((n - 1) / 2) + 1, [block_of("id", 100)])
    want = [(k, rs[(len(rs) - 1) // 2][0]) for k, rs in groups().items()]
    assert rows(middle, "k", "id") == sorted(want, key=repr)


def test_collect_ordered_cuts_large_groups_into_chunks(data):
    got = aggregates.collect_ordered(data, ["k"], ["id"], ["id", "v"], "kids", [block_of("id", 100)], rows=16)
    by_key = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (str(r["k"]), r["chunk"])):
        assert 0 < len(r["kids"]) <= 16
        by_key[r["k"]] += [tuple(e) for e in r["kids"]]
    assert dict(by_key) == groups()


def test_percentiles_match_interpolation(data):
    import numpy as np

    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: r for r in aggregates.percentile_summary(data, ["k"], "v", probs).collect()}
    for k, rs in groups().items():
        values = [v for _, v in rs]
        assert got[k]["n"] == len(values)
        assert got[k]["mean"] == pytest.approx(np.mean(values))
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100))


def test_percentiles_skip_nulls(table):
    df = table([("a", 1), ("a", None), ("a", 3)], "k string, v long")
    row = aggregates.percentile_summary(df, ["k"], "v", {"p50": 0.5}).collect()[0]
    assert (row["n"], row["p50"]) == (2, 2.0)


def test_names_of_any_length_stay_in_order(table):
    numbers = [5, 17, 99, 100, 1234, 99999, 100000, 100009999, 1000000005, 1000000006, 7]
    names = [f"Customer#{n:09d}" for n in numbers] + ["", "A", "Customer#", "Zoë"]
    df = table([("g", n, i) for i, n in enumerate(names)], "g string, name string, i int")
    for nth in range(1, len(names) + 1):
        got = nth_row(df, ["g"], ["name"], lambda n, nth=nth: F.lit(nth), [prefix_block(df, "name")]).collect()
        assert [r["name"] for r in got] == [sorted(names, key=str.encode)[nth - 1]]


def spread(kind, n=9000):
    """(key, name, id) with a third of the rows under one key, names of one length, of mixed lengths, or with one prefix."""
    rnd = random.Random(4)
    size = {"one": lambda: 6, "mixed": lambda: rnd.choice([1, 2, 4, 60]), "prefix": lambda: 4}[kind]
    head = "common beginning of all the names " if kind == "prefix" else ""
    names = [head + "".join(rnd.choice("abcd") for _ in range(size())) for _ in range(n)]
    return [("hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{rnd.randrange(40)}", x, i) for i, x in enumerate(names)]


@pytest.mark.parametrize("kind", ["one", "mixed", "prefix"])
def test_ordered_work_at_splitters(table, rows, kind, monkeypatch):
    from tallygrain.operators import ordered, splitters

    monkeypatch.setattr(splitters.with_block, "__defaults__", (300, None, None))
    data = spread(kind)
    df = table(data, "k string, name string, id long")
    want = defaultdict(list)
    for k, name, i in sorted(data, key=lambda r: (r[1].encode(), r[2])):
        want[k].append((name, i))
    order = ["name", "id"]
    got = rows(position(df, ["k"], order, "n", None, total="all"), "k", "id", "n", "all")
    assert got == sorted(((k, i, n, len(v)) for k, v in want.items() for n, (_, i) in enumerate(v, 1)), key=repr)
    middle = nth_row(df, ["k"], order, lambda n: F.floor((n - 1) / 2) + 1, None)
    assert rows(middle, "k", "id") == sorted(((k, v[(len(v) - 1) // 2][1]) for k, v in want.items()), key=repr)
    after = following(df, ["k"], order, "id", "nxt", None)
    assert rows(after, "id", "nxt") == sorted(((a[1], b and b[1]) for v in want.values() for a, b in zip(v, [*v[1:], None])), key=repr)
    lists = aggregates.collect_ordered(df, ["k"], order, ["id"], "kids", rows=100).collect()
    for k, v in want.items():
        assert [e["id"] for r in sorted(lists, key=lambda r: r["chunk"]) if r["k"] == k for e in r["kids"]] == [i for _, i in v]
    # blocks of the hot key are even
    blocked = ordered._with_block(df, ["k"], order, None).filter("k = 'hot'").groupBy("_block").count().collect()
    assert len(blocked) > 5 and max(r["count"] for r in blocked) <= 2 * 300


@pytest.mark.parametrize("key", ["ordered_collect", "middle_row", "ws_order_status", "duality_assemble", "doc_articles_per_person"])
def test_queries_cut_at_splitters(spark, monkeypatch, key):
    """The registered queries place their rows by the splitters, whatever the names."""
    from __spark_entry__ import queries
    from tallygrain.operators import splitters

    used = []
    plain = splitters.with_block
    monkeypatch.setattr(splitters, "with_block", lambda df, columns, *a, **k: used.append(columns) or plain(df, columns, *a, **k))
    queries()[key](spark, "/root/testdata/sf0.001").count()
    assert used


@pytest.mark.parametrize("kind", ["small", "narrow", "all different", "whole range", "two ends", "one value", "negative"])
def test_percentiles_by_radix_selection(table, kind):
    import numpy as np

    rnd = random.Random(6)
    n = 3000
    draw = {
        "small": lambda i: rnd.randrange(5),
        "narrow": lambda i: 10**12 + rnd.randrange(1000),
        "all different": lambda i: i * 7_919_000_003 - 10**13,
        "whole range": lambda i: rnd.randrange(-(2**62), 2**62),
        "two ends": lambda i: rnd.choice([-(2**62), 2**62 - 1]) + rnd.randrange(3),
        "one value": lambda i: 42,
        "negative": lambda i: -rnd.randrange(1, 10**6),
    }[kind]
    data = [("hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{i % 4}", draw(i)) for i in range(n)]
    data += [("hot", None), ("empty", None), ("single", draw(1))]
    seen = []
    plain = aggregates._bins
    aggregates._bins = lambda *a, **k: seen.append(1) or plain(*a, **k)
    try:
        got = aggregates.rank_values(table(data, "k string, v long"), ["k"], "v", lambda n: [F.lit(0), F.floor((n - 1) / 3), n - 1]).collect()
    finally:
        aggregates._bins = plain
    want = defaultdict(list)
    for k, v in data:
        if v is not None:
            want[k].append(v)
    assert {r["k"] for r in got} == set(want)
    for r in got:
        values = sorted(want[r["k"]])
        assert r["n"] == len(values) and r["mean"] == pytest.approx(np.mean(values), rel=1e-9, abs=1.0)
        assert r["values"] == [values[0], values[int((len(values) - 1) / 3)], values[-1]]
    assert len(seen) <= 4
