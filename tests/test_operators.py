"""Edge rows of filters, joins, aggregates, windows and scalars."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallygrain.functions import scalars
from tallygrain.operators import aggregates, joins, predicates, topk, windows


def test_rank_keeps_ties_at_the_cut_and_puts_nulls_first(table, rows):
    df = table([("a", 9, 1), ("a", 9, 2), ("a", 5, 3), ("a", 5, 4), ("a", 1, 5), ("b", None, 6), ("b", 2, 7)],
               "p string, m int, id int")
    got = rows(windows.top_ranked(df, ["p"], "m", 3), "id", "rank")
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (6, 1), (7, 2)]


def test_densify_fills_product_sold_in_one_year(table, rows):
    sold = table([("x", 1999, 1, 5), ("x", 1999, 2, 7), ("y", 2000, 1, 3)], "name string, y int, w int, cents long")
    periods = table([(1999, 1), (1999, 2), (2000, 1), (2000, 1)], "y int, w int")
    got = rows(joins.densify(sold, ["name"], periods, {"cents": 0}), "name", "y", "w", "cents")
    assert got == [("x", 1999, 1, 5), ("x", 1999, 2, 7), ("x", 2000, 1, 0), ("y", 1999, 1, 0), ("y", 1999, 2, 0), ("y", 2000, 1, 3)]


def test_closed_intervals_share_their_boundary(table, rows):
    points = table([(0,), (299,), (300,), (301,), (600,), (601,)], "at long")
    intervals = table([(1, 0, 300), (2, 300, 600)], "no int, low long, high long")
    got = rows(joins.range_join(points, "at", intervals, "low", "high", 300), "at", "no")
    assert got == [(0, 1), (299, 1), (300, 1), (300, 2), (301, 2), (600, 2)]


def test_range_join_equals_brute_force_for_irregular_ranges(table, rows):
    rnd = random.Random(3)
    pts = [(rnd.randrange(-500, 500),) for _ in range(80)]
    rngs = [(i, lo, lo + rnd.randrange(0, 300)) for i, lo in enumerate(rnd.sample(range(-500, 500), 20))]
    got = rows(joins.range_join(table(pts, "at long"), "at", table(rngs, "no int, low long, high long"), "low", "high", 37), "at", "no")
    assert got == sorted([(p, i) for (p,) in pts for i, lo, hi in rngs if lo <= p <= hi], key=repr)


def test_range_owner_takes_greatest_lower_bound_and_keeps_unowned(table, rows):
    ids = table([(5,), (15,), (99,), (15,)], "id long")
    ranges = table([("A", 0, 20), ("B", 10, 30)], "code string, low long, high long")
    assert rows(joins.range_owner(ids, "id", ranges, "low", "high", "code", 10)) == [(15, "B"), (15, "B"), (5, "A"), (99, None)]


def test_left_join_keeps_orders_without_items(table, rows):
    orders = table([(1, "a"), (2, "b"), (None, "c")], "id int, o string")
    items = table([(1, 10), (1, 11), (3, 12)], "id int, item int")
    got = rows(joins.left_join(orders, items, ["id"]), "id", "o", "item")
    assert got == [(1, "a", 10), (1, "a", 11), (2, "b", None), (None, "c", None)]


def test_worklist_keeps_listed_orders_without_details(table, rows):
    orders = table([(3, 30), (1, 10), (2, 20)], "id int, d int")
    items = table([(1, "x"), (3, "y")], "id int, item string")
    assert rows(topk.worklist(orders, ["d"], 2, (items, "id", "left")), "id", "item") == [(1, "x"), (2, None)]


def test_rollup_and_cube_totals(table):
    df = table([("a", "x", 1), ("a", "y", 2), ("b", "x", 4), (None, "x", 8)], "p string, q string, v long")
    rolled = aggregates.rollup_sum(df, ["p", "q"], "v", "s").collect()
    assert [r["s"] for r in rolled if r["level"] == 3] == [15]
    # a null in the data is not a subtotal
    assert [r["s"] for r in rolled if r["level"] == 1 and r["p"] is None] == [8]
    cubed = aggregates.cube_agg(df, ["p", "q"], "v", "s", count="n").collect()
    assert {(r["q"], r["s"], r["n"]) for r in cubed if r["level"] == 2} == {("x", 13, 3), ("y", 2, 1)}


def test_sums_beyond_long_range_do_not_overflow(table):
    big = 6 * 10**18
    df = table([("a", big), ("b", big)], "k string, v long")
    total = [r for r in aggregates.rollup_sum(df, ["k"], "v", "s").collect() if r["level"] == 1]
    assert int(total[0]["s"]) == 2 * big


def test_lookup_count_shows_zero(table, rows):
    df = table([("a",), ("a",), ("z",)], "k string")
    keys = table([("a",), ("b",), ("a",)], "k string")
    assert rows(predicates.lookup_count(df, keys, ["k"])) == [("a", 2), ("b", 0)]


def test_exists_and_new_only_split_the_candidates(table, rows):
    cand, known = table([(1,), (2,), (3,)], "id int"), table([(2,), (2,)], "id int")
    assert rows(predicates.exists_flag(cand, known, ["id"])) == [(1, False), (2, True), (3, False)]
    assert rows(joins.new_only(cand, known, ["id"])) == [(1,), (3,)]


def test_example_filter_matches_nested_and_null(table, rows):
    df = table([(1, ("A", None)), (2, ("A", "x")), (3, ("B", None))], "id int, doc struct<f: string, g: string>")
    assert rows(predicates.filter_by_example(df, {"doc": {"f": "A", "g": None}}), "id") == [(1,)]
    assert len(rows(predicates.filter_by_example(df, {}), "id")) == 3


@pytest.mark.parametrize("text,hit", [
    ("Star Wars", True), ("the star", True), ("superstar", False), ("x-STARk", True), ("éstar", False), ("", False), (None, False),
])
def test_word_prefix(table, text, hit):
    df = table([(text,)], "t string")
    assert df.filter(predicates.word_prefix("t", "Star*")).count() == int(hit)


def test_word_prefix_treats_signs_as_text(table):
    df = table([("c++ book",), ("ccc book",)], "t string")
    assert df.filter(predicates.word_prefix("t", "c+*")).count() == 1


def test_json_contains_modes(table, rows):
    df = table([(1, "['a','b']"), (2, "['a']"), (3, "[]")], "id int, g string")
    assert rows(df.filter(predicates.json_contains("g", ["a", "b"], "&")), "id") == [(1,)]
    assert rows(df.filter(predicates.json_contains("g", ["a", "b"], "|")), "id") == [(1,), (2,)]


def test_moving_average_skips_missing_days(table, rows):
    day = lambda d: dt.date(2000, 1, d)
    df = table([(day(1), 10), (day(2), 20), (day(5), 50)], "d date, v int")
    assert rows(windows.moving_average(df, "d", "v", 2, "a"), "v", "a") == [(10, 15.0), (20, 15.0), (50, 50.0)]


def test_latest_and_earliest(table, rows):
    df = table([("a", 1, 1), ("a", 2, 1), ("a", 2, 9), ("b", 5, 5)], "k string, d int, id int")
    assert rows(windows.latest_per(df, ["k"], ["d", "id"])) == [("a", 2, 9), ("b", 5, 5)]
    assert rows(windows.earliest_per(df, ["k"], ["d", "id"])) == [("a", 1, 1), ("b", 5, 5)]


def test_last_n_starts_at_one(table, rows):
    orders = table([(1, 1), (1, 2), (1, 3), (2, 1)], "d int, id long")
    upper = table([(1, 4), (2, 2)], "d int, nxt long")
    assert rows(windows.last_n(orders, ["d"], "id", upper, "nxt", 2), "d", "id") == [(1, 2), (1, 3), (2, 1)]


def test_percent_change_is_null_after_zero(table, rows):
    df = table([(1, 183.27), (2, 284.13), (3, 656.6), (4, 0.0), (5, 7.0)], "run int, tps double")
    got = rows(windows.pct_change(df, "run", "tps", "c"), "run", "c")
    assert got == [(1, None), (2, 55.03), (3, 131.09), (4, -100.0), (5, None)]


def test_sampling_repeats_over_layouts(table, rows):
    df = table([(i, "ab"[i % 2]) for i in range(2000)], "id long, g string")
    first = rows(topk.sample_by(df, "g", {"a": 0.1}, "id", 4))
    assert first == rows(topk.sample_by(df.repartition(7, "g"), "g", {"a": 0.1}, "id", 4))
    assert {g for _, g in first} == {"a"} and 60 < len(first) < 140


def test_counters(table, rows):
    df = table([("a", "1,2,3,4,5,6,7"), ("a", "1,0,0,0,0,0,9")], "k string, info string")
    assert rows(aggregates.counter_totals(df, ["k"], "info")) == [("a", 2, 2, 3, 4, 5, 6, 16)]


def test_money_text(table):
    cents = [123456789, -150, -50, -49, 0, 99, 999999999949, 10**14, -(10**14), 12345678901234, 1234567890123456, None]
    df = table([(c,) for c in cents], "c long")
    got = {r["c"]: r["t"] for r in df.withColumn("t", scalars.money_text("c")).collect()}
    assert got == {
        123456789: "     1,234,568", -150: "            -2", -50: "            -1", -49: "             0",
        0: "             0", 99: "             1", 999999999949: " 9,999,999,999",
        10**14: "1,000,000,000,000", -(10**14): "-1,000,000,000,000", 12345678901234: "123,456,789,012",
        1234567890123456: "12,345,678,901,235", None: None,
    }
    total = table([(10**15 + i, "x") for i in range(3)], "cents long, k string")
    summed = total.groupBy("k").sum("cents").select(scalars.money_text("sum(cents)").alias("t"))
    assert summed.first()["t"] == "30,000,000,000,000"


def test_syllables(table, rows):
    df = table([(0,), (371,), (999,), (1371,)], "n long")
    assert rows(df.select("n", scalars.syllable_name("n"))) == [
        (0, "BARBARBAR"), (1371, "PRICALYOUT"), (371, "PRICALYOUT"), (999, "EINGEINGEING")]


def test_as_array(table, rows):
    df = table([(1, None), (2, '{"k":1}'), (3, '[{"k":1},{"k":2}]'), (4, "[]"), (5, "null")], "id int, h string")
    got = rows(df.select("id", F.to_json(scalars.as_array("h", "struct<k:bigint>"))))
    assert got == [(1, "[]"), (2, '[{"k":1}]'), (3, '[{"k":1},{"k":2}]'), (4, "[]"), (5, "[]")]


def test_stock_rule_equals_line_by_line(table):
    rnd = random.Random(5)
    cases = [(s, [rnd.randint(1, 81) for _ in range(rnd.randint(0, 60))]) for s in [*range(0, 130, 3), 400, 2500]]
    cases.append((12, [5]))

    def fold(stock, lines):
        for q in lines:
            stock = stock - q if stock - q >= 10 else stock - q + 91
        return stock

    df = table([(i, s, sum(q)) for i, (s, q) in enumerate(cases)], "i int, s long, q long")
    got = {r["i"]: r["left"] for r in df.withColumn("left", scalars.stock_after(F.col("s"), F.col("q"))).collect()}
    assert got == {i: fold(s, q) for i, (s, q) in enumerate(cases)}
    assert fold(12, [5]) == 98


def test_dyadic_pieces_cover_a_range_once(spark):
    rng = random.Random(3)
    spans = [(0, 0), (0, 3), (-5, 5), (1, 62), (-(2**50), 2**50 + 7), (-(2**61), 2**61), (7, 6), (3, None)]
    spans += [(a, a + rng.randrange(1, 3000)) for a in (rng.randrange(-5000, 5000) for _ in range(60))]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "i int, a long, b long")
    got = df.select("i", joins.dyadic_pieces(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        a, b = spans[r["i"]]
        if b is None or a > b:
            assert not r["p"]
            continue
        blocks = sorted((p["place"] << p["level"], (p["place"] + 1) << p["level"]) for p in r["p"])
        # one after the other, from the first cell to the last
        assert blocks[0][0] == a and blocks[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))
        assert len(blocks) <= max(4, 2 * (b - a + 1).bit_length())
    assert max(len(r["p"] or []) for r in got) <= 128


@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join_with_ranges_of_every_width(table, rows, how):
    rng = random.Random(9)
    pts = [(i, rng.randrange(-3000, 3000)) for i in range(400)] + [(900, None), (901, 2**60), (902, -(2**60)), (903, 5), (904, 5)]
    rngs = [(i, a, a + rng.choice([0, 1, 5, 40, 300, 2000])) for i, a in enumerate(rng.randrange(-3000, 3000) for _ in range(60))]
    rngs += [(100, -(2**61), 2**61), (101, 5, 4), (102, None, 7), (103, 0, None), (104, 2**59, 2**61)]
    got = rows(joins.range_join(table(pts, "p long, at long"), "at", table(rngs, "no int, low long, high long"), "low", "high", 16, how), "p", "no")
    want = []
    for p, at in pts:
        hits = [no for no, a, b in rngs if None not in (at, a, b) and a <= at <= b]
        want += [(p, no) for no in hits] or ([(p, None)] if how == "left" else [])
    assert got == sorted(want, key=repr)


def test_a_range_over_all_keys_costs_few_rows(table):
    ranges = table([(0, -(2**62), 2**62 - 1), (1, 10, 20)], "no int, low long, high long")
    found = joins.range_join(table([(i,) for i in range(50)], "at long"), "at", ranges, "low", "high", 1)
    assert found.count() == 50 + 11
    pieces = ranges.select(F.explode(joins.dyadic_pieces(F.col("low"), F.col("high"))))
    assert pieces.count() <= 128 + 8
