"""Change batches: several changes to one key, stale versions, rejects, hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import changes, versions, wholesale
from tallygrain.operators.ordered import block_of


def test_last_update_wins_and_may_set_null(table, rows):
    df = table([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    ch = table([(1, 1, "x"), (1, 2, "y"), (3, 1, None), (9, 1, "z")], "id int, seq int, v string")
    assert rows(changes.apply_update(df, ch, ["id"], ["seq"])) == [(1, "y"), (2, "b"), (3, None)]


def test_increments_add_up_and_commute(table, rows):
    df = table([(1, 10), (2, 20)], "id int, v long")
    deltas = [(1, 5), (1, -2), (7, 100)]
    once = rows(changes.apply_increment(df, table(deltas, "id int, v long"), ["id"], ["v"]))
    other = rows(changes.apply_increment(df, table(deltas[::-1], "id int, v long"), ["id"], ["v"]))
    assert once == other == [(1, 13), (2, 20)]


def test_delete_upsert_append(table, rows):
    df = table([(1, "a"), (2, "b")], "id int, v string")
    assert rows(changes.apply_delete(df, table([(2,), (2,)], "id int"), ["id"])) == [(1, "a")]
    assert rows(changes.upsert(df, table([(2, "B"), (3, "C")], "id int, v string"), ["id"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(changes.append(df, table([(4,)], "id int")), "id", "v") == [(1, "a"), (2, "b"), (4, None)]


def test_insert_if_absent_takes_first_of_the_batch(table, rows):
    df = table([("a@x", 0)], "email string, seq int")
    new = table([("b@x", 2), ("b@x", 1), ("a@x", 3)], "email string, seq int")
    assert rows(changes.insert_if_absent(df, new, ["email"], ["seq"])) == [("a@x", 0), ("b@x", 1)]


def test_assign_ids_are_dense_and_repeatable(table, rows):
    existing = table([(41,), (7,)], "id long")
    new = [(f"n{i}",) for i in range(200)]
    first = rows(changes.assign_ids(table(new, "name string"), existing, "id", "name"), "name", "id")
    again = rows(changes.assign_ids(table(new[::-1], "name string"), existing, "id", "name"), "name", "id")
    assert first == again
    assert sorted(i for _, i in first) == list(range(42, 242))


def test_assign_ids_starts_at_one_in_an_empty_table(table, rows):
    got = changes.assign_ids(table([("x",)], "name string"), table([], "id long"), "id", "name")
    assert rows(got, "id") == [(1,)]


def test_group_ids_go_on_after_the_highest_used(table, rows):
    ranges = table([("A", 1, 1000), ("B", 1001, 2000)], "g string, low long, high long")
    existing = table([("A", 5), ("A", 3)], "g string, id long")
    new = table([("A", 10), ("A", 11), ("B", 70)], "g string, k long")
    got = changes.assign_group_ids(new, existing, ranges, "g", "id", ["k"], [block_of("k", 8)])
    assert rows(got, "g", "k", "id") == [("A", 10, 6), ("A", 11, 7), ("B", 70, 1001)]


def test_a_full_id_range_stops_the_job(table):
    ranges = table([("A", 1000, 1001), ("B", 2000, 2999)], "g string, low long, high long")
    used = table([("A", 1000)], "g string, id long")
    fits = table([("A", 1), ("B", 2)], "g string, k long")
    given = changes.assign_group_ids(fits, used, ranges, "g", "id", ["k"], [block_of("k", 8)])
    assert sorted((r["g"], r["id"]) for r in given.collect()) == [("A", 1001), ("B", 2000)]
    more = table([("A", 1), ("A", 2)], "g string, k long")
    with pytest.raises(Exception, match="id range used up: A"):
        changes.assign_group_ids(more, used, ranges, "g", "id", ["k"], [block_of("k", 8)]).collect()


def test_stale_versions_are_rejected(table, rows):
    df = table([("p", 1, "old"), ("q", 4, "old")], "k string, ver long, body string")
    ch = table([("p", 1, 1, "first"), ("p", 1, 2, "second"), ("q", 3, 3, "stale")], "k string, ver long, seq int, body string")
    after, rejected = changes.replace_if_version(df, ch, "k", "ver", ["seq"])
    assert rows(after) == [("p", 2, "first"), ("q", 4, "old")]
    assert rows(rejected, "k", "seq") == [("p", 2), ("q", 3)]


def test_switch_default_leaves_one_yes_per_customer(table, rows):
    df = table([(1, 7, "Y"), (2, 7, "N"), (3, 8, "Y")], "id int, cust int, d string")
    new = table([(10, 7), (11, 7)], "id int, cust int")
    got = rows(changes.switch_default(df, new, "cust", "d", ["id"]), "id", "d")
    assert got == [(1, "N"), (10, "N"), (11, "Y"), (2, "N"), (3, "Y")]


def test_orders_without_stock_count_nothing(table, rows):
    orders, items = table([(1, 100)], "order_id long, total_cents long"), table([], "order_id long, product_id long, quantity long, amount_cents long")
    inv = table([(1, 1, 5), (2, 1, 0)], "product_id long, warehouse_id long, quantity_on_hand long")
    new = table([(2,), (3,)], "order_id long")
    lines = table([(2, 1, 1, 3, 30), (2, 2, 1, 1, 99), (3, 2, 1, 1, 99), (2, 1, 1, 4, 40)],
                  "order_id long, product_id long, warehouse_id long, quantity long, amount_cents long")
    after = changes.apply_orders(orders, items, inv, new, lines)
    assert rows(after["orders"], "order_id", "total_cents") == [(1, 100), (2, 70), (3, 0)]
    assert rows(after["inventory"]) == [(1, 1, -2), (2, 1, 0)]
    assert len(rows(after["items"])) == 2


def test_process_orders_takes_n_per_warehouse(table, rows):
    df = table([(i, i % 2, dt.date(2000, 1, 1 + i), 2 if i < 8 else 9) for i in range(10)],
               "order_id int, warehouse_id int, order_date date, order_status int")
    got = rows(changes.process_orders(df, 2, 4, 7).filter("order_status = 7"), "order_id")
    assert got == [(0,), (1,), (2,), (3,)]


def test_bump_lines_counts_repeated_picks(table, rows):
    items = table([(1, 1, 5, 10), (1, 2, 5, 20)], "order_id long, line_item_id long, quantity long, unit_cents long")
    orders = table([(1, 1000), (2, 5)], "order_id long, total_cents long")
    picks = table([(1, 1), (1, 1), (1, 2), (8, 8)], "order_id long, line_item_id long")
    after_items, after_orders = changes.bump_lines(items, orders, picks)
    assert rows(after_items, "line_item_id", "quantity") == [(1, 7), (2, 6)]
    assert rows(after_orders) == [(1, 1040), (2, 5)]


def test_scale_up_keeps_joins_valid(table):
    c, o = table([(1,), (2,)], "ck long"), table([(5, 1), (6, 2)], "ok long, ck long")
    step_c, step_o = c.agg(F.max("ck") + 1), o.agg(F.max("ok") + 1)
    big = changes.scale_up({"c": c, "o": o}, 4, {"c": {"ck": step_c}, "o": {"ok": step_o, "ck": step_c}})
    assert big["c"].distinct().count() == big["o"].distinct().count() == 8
    assert big["o"].join(big["c"], "ck").count() == 8


# --- versioned rows -----------------------------------------------------------------
def day(n):
    return dt.date(2000, 1, n)


def test_scd2_closes_opens_and_rejects(table, rows):
    members = table([(1, 1, 50, day(1), None), (1, 2, 60, day(1), None)],
                    "cust int, idx int, line int, valid_from date, valid_to date")
    ch = table([(1, 1, 51, day(5), 1), (1, 1, 52, day(7), 2), (1, 2, 61, day(8), 3), (2, 1, 70, day(3), 4)],
               "cust int, idx int, line int, d date, seq int")
    after, rejected = versions.scd2_apply(members, ch, "cust", "idx", ["d", "seq"], allowance=2)
    assert rows(after, "cust", "idx", "line", "valid_to") == sorted([
        (1, 1, 50, day(5)), (1, 1, 51, day(7)), (1, 1, 52, None), (1, 2, 60, None), (2, 1, 70, None)], key=repr)
    assert rows(rejected, "cust", "line") == [(1, 61)]
    assert len(rows(versions.scd2_current(after))) == 3


def test_current_rows_are_part_of_history(table, rows):
    ev = table([(1, day(1), 5), (1, day(4), 6), (2, day(2), 7)], "k int, d date, line int")
    history = versions.scd2_history(ev, ["k"], ["d", "line"], "valid_to", [F.col("d")])
    assert rows(history, "k", "line", "valid_to") == [(1, 5, day(4)), (1, 6, None), (2, 7, None)]
    assert set(rows(versions.scd2_current(history))) <= set(rows(history))


# --- wholesale ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def shop(table):
    return dict(
        districts=table([(1, 1, 100, 500, 250), (2, 1, 7, 0, 0)], "d_w_id long, d_id long, d_next_o_id long, w_tax_bp long, d_tax_bp long"),
        customers=table([(1, 10), (2, 0)], "c_id long, c_discount_pct long"),
        items=table([(1, 100), (2, 250)], "i_id long, i_price_cents long"),
        stock=table([(1, 1, 12), (1, 2, 50), (2, 1, 9)], "s_w_id long, s_i_id long, s_quantity long"),
    )


def batch(table, orders, lines):
    return (
        table(orders, "batch_id long, w_id long, d_id long, c_id long"),
        table(lines, "batch_id long, w_id long, ol_number long, i_id long, supply_w_id long, quantity long"),
    )


def place(shop, orders, lines):
    return wholesale.new_orders(**shop, orders=orders, lines=lines, order=["batch_id"], blocks=[block_of("batch_id", 2)])


def test_new_orders_reject_whole_order_for_one_bad_line(shop, table, rows):
    orders, lines = batch(
        table,
        [(1, 1, 1, 1), (2, 1, 1, 2), (3, 1, 1, 2), (4, 2, 1, 1), (5, 1, 1, 1)],
        [(1, 1, 1, 1, 1, 5), (1, 1, 2, 2, 1, 1), (2, 1, 1, 1, 1, 1), (2, 1, 2, 99, 1, 1),  # 99: unknown item
         (3, 1, 1, 1, 2, 4), (4, 2, 1, 2, 2, 1)],  # item 2 is not stocked in 2
    )
    after = place(shop, orders, lines)
    assert rows(after["rejected"]) == [(2,), (4,)]
    assert rows(after["orders"], "batch_id", "o_id", "cents", "total_millionths", "all_local") == [
        (1, 100, 750, 750 * 10750 * 90, 1), (3, 101, 400, 400 * 10750 * 100, 0), (5, 102, None, 0, None)]
    assert rows(after["stock"], "s_w_id", "s_i_id", "s_quantity", "s_order_cnt", "s_remote_cnt") == [
        (1, 1, 98, 1, 0), (1, 2, 49, 1, 0), (2, 1, 96, 1, 1)]
    assert rows(after["districts"], "d_w_id", "d_next_o_id") == [(1, 103), (2, 7)]


def test_new_orders_fold_hot_stock_like_line_by_line(shop, table, rows):
    rnd = random.Random(2)
    qty = [rnd.randint(1, 10) for _ in range(300)]
    orders, lines = batch(table, [(i, 1, 1, 1) for i in range(300)], [(i, 1, 1, 1, 1, q) for i, q in enumerate(qty)])
    stock = 12
    for q in qty:
        stock = stock - q if stock - q >= 10 else stock - q + 91
    got = {r["s_i_id"]: r["s_quantity"] for r in place(shop, orders, lines)["stock"].filter("s_w_id = 1").collect()}
    assert got == {1: stock, 2: 50}


def by_hand(stock, quantities):
    for q in quantities:
        stock = stock - q if stock - q >= 10 else stock - q + 91
    return stock


@pytest.mark.parametrize("largest", [81, 100, 500])
@pytest.mark.parametrize("block", [1, 3, 1000])
def test_stock_walk_equals_line_by_line(table, largest, block):
    rnd = random.Random(largest + block)
    data, want = [], {}
    for k in range(120):
        stock = rnd.choice([-1000, -5, 0, 9, 10, 50, 100, 101, 5000, rnd.randrange(-300, 3000)])
        quantities = [rnd.choice([0, 1, 90, 91, 92, rnd.randint(0, largest)]) for _ in range(rnd.randint(1, 30))]
        data += [(k, i, q, stock) for i, q in enumerate(quantities)]
        want[k] = by_hand(stock, quantities)
    rnd.shuffle(data)
    df = table(data, "k long, n long, quantity long, s_quantity long")
    for blocks in ([block_of("n", block)], None):
        got = wholesale.stock_walk(df, ["k"], ["n", "quantity"], blocks).collect()
        assert {r["k"]: r["left"] for r in got} == want


def test_new_orders_with_lines_of_500_pieces_and_a_hot_product(shop, table, rows):
    rnd = random.Random(3)
    # a third of all lines are for one product; stock 12, and 9 for the product of warehouse 2
    lines = [(i // 3, 1, i % 3, 1 if i % 3 == 0 else 2, 1, rnd.randint(1, 500)) for i in range(900)]
    lines += [(400 + i, 2, 1, 1, 2, rnd.choice([0, 500, 40])) for i in range(50)] + [(500, 1, 1, 1, 1, -3), (500, 1, 2, 2, 1, 5), (501, 1, 1, 1, 1, None)]
    rnd.shuffle(lines)
    orders, df = batch(table, [(i, 1, 1, 1) for i in range(502)], lines)
    want = {(1, 1): 12, (1, 2): 50, (2, 1): 9}
    for batch_id, _, _, i, w, q in sorted(lines, key=lambda x: (x[0], x[2])):
        if batch_id < 500:
            want[w, i] = by_hand(want[w, i], [q])
    after = place(shop, orders, df)
    assert {(r["s_w_id"], r["s_i_id"]): r["s_quantity"] for r in after["stock"].collect()} == want
    assert rows(after["rejected"]) == [(500,), (501,)]


def test_payment_notes_keep_the_newest_500_characters(table):
    customers = table([(1, 2, 3, "BC", 10000, "old data"), (1, 2, 4, "GC", 0, "good")],
                      "c_w_id long, c_d_id long, c_id long, c_credit string, c_balance_cents long, c_data string")
    pays = [(1, 2, 3, 1, 2, n, 100 + n) for n in range(60)] + [(1, 2, 4, 1, 2, 99, 500)]
    df = table(pays, "c_w_id long, c_d_id long, c_id long, w_id long, d_id long, seq long, cents long")
    after = wholesale.payments(customers, df, ["seq"])
    note = "old data"
    for *_, cents in pays[:60]:
        note = (f"| 3 2 1 2 1 {cents / 100:.2f} |" + note)[:500]
    got = {r["c_id"]: r for r in after["customers"].collect()}
    assert got[3]["c_data"] == note
    assert got[3]["c_balance_cents"] == 10000 - sum(p[-1] for p in pays[:60])
    assert (got[4]["c_data"], got[4]["c_balance_cents"], got[4]["c_payment_cnt"]) == ("good", -500, 1)
    assert after["history"].count() == 61
    assert after["history"].first()["h_data"] == "W1 D2"


def test_short_note_keeps_old_data(table):
    customers = table([(1, 1, 1, "BC", 0, None)], "c_w_id long, c_d_id long, c_id long, c_credit string, c_balance_cents long, c_data string")
    pays = table([(1, 1, 1, 1, 1, 1, 5)], "c_w_id long, c_d_id long, c_id long, w_id long, d_id long, seq long, cents long")
    assert wholesale.payments(customers, pays, ["seq"])["customers"].first()["c_data"] == "| 1 1 1 1 1 0.05 |"


def test_delivery_of_oldest_order(table, rows):
    waiting = table([(1, 1, 5), (1, 1, 4), (1, 2, 9)], "w_id int, d_id int, o_id int")
    orders = table([(1, 1, 4, 7, None), (1, 1, 5, 7, None), (1, 2, 9, 7, None)], "w_id int, d_id int, o_id int, c_id int, o_carrier_id int")
    lines = table([(1, 1, 4, 30, day(1)), (1, 1, 4, 12, day(1)), (1, 1, 5, 99, day(1))], "w_id int, d_id int, o_id int, ol_cents long, ol_delivery_d date")
    people = table([(7, 100, 0), (8, 1, 0)], "c_id int, c_balance_cents long, c_delivery_cnt long")
    after = wholesale.delivery(waiting, orders, lines, people, 3, F.lit(day(9)))
    assert rows(after["waiting"]) == [(1, 1, 5)]
    assert rows(after["orders"], "o_id", "o_carrier_id") == [(4, 3), (5, None), (9, 3)]
    # both delivered orders belong to customer 7; order 9 has no lines
    assert rows(after["customers"]) == [(7, 142, 2), (8, 1, 0)]
    assert sum(r[0] == day(9) for r in rows(after["lines"], "ol_delivery_d")) == 2


def test_stock_level_counts_distinct_items(table, rows):
    stock = table([(1, 1, 5), (1, 2, 50), (1, 3, 4)], "s_w_id long, s_i_id long, s_quantity long")
    orders = table([(1, 1, 8), (1, 1, 9), (1, 1, 2)], "o_w_id long, o_d_id long, o_id long")
    lines = table([(8, 1), (9, 1), (9, 2), (2, 3)], "ol_o_id long, ol_i_id long")
    districts = table([(1, 1, 10), (1, 2, 3)], "d_w_id long, d_id long, d_next_o_id long")
    assert rows(wholesale.stock_level(stock, orders, lines, districts, 10, 5)) == [(1, 1, 1), (1, 2, 0)]


def test_returns_raise_stock_or_open_it(table, rows):
    stock = table([(1, 1, 10), (1, 10, 4), (2, 1, 0)], "product_id long, warehouse_id int, quantity_on_hand long")
    back = table([(1, 10, 3), (1, 10, 2), (2, 10, 7), (2, 10, 1), (3, 1, 5)], stock.schema.simpleString()[7:-1].replace(":", " "))
    got = changes.add_or_insert(stock, back, ["product_id", "warehouse_id"], "quantity_on_hand")
    assert rows(got) == [
        (1, 1, 10, "kept"),
        (1, 10, 9, "updated"),
        (2, 1, 0, "kept"),
        (2, 10, 8, "new"),
        (3, 1, 5, "new"),
    ]


def test_inventory_ingest_covers_every_warehouse(spark):
    from tallygrain.plans.changes import inventory_ingest

    got = inventory_ingest(spark, "/root/testdata/sf0.001")
    assert sorted(r["warehouse_id"] for r in got.select("warehouse_id").distinct().collect()) == list(range(1, 11))
