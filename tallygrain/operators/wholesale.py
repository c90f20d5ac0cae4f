"""Wholesale order, payment and delivery batches as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.scalars import LEAST_STOCK, REFILL, stock_after
from tallygrain.operators.changes import apply_delete, apply_increment
from tallygrain.operators.joins import semi, split_join
from tallygrain.operators.ordered import position, running_totals
from tallygrain.operators.windows import earliest_per, first_per, latest_per
from tallygrain.session import written

MAX_LINE = 81  # the largest line quantity for which the stock rule is free of line order


def _settled(value: Column) -> Column:
    """The number among 10 to 100 that is ``value`` give or take refills."""
    return F.pmod(value - LEAST_STOCK, F.lit(REFILL)) + LEAST_STOCK


def stock_walk(lines: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Sequence[Column] | None) -> DataFrame:
    """keys and ``left``: the stock after a product's lines, one after the other, for any stock and any quantities from 0 up.

    ``lines`` have ``s_quantity``, the stock before the first of them, and
    ``quantity``. A line takes its quantity ``q``, and 91 is added back where
    less than 10 would remain. Adding refills never changes the stock modulo 91,
    so after each line the stock is ``x - 91 i``, where ``x`` (10 to 100) is
    known from the sum of the quantities. The depth ``i`` walks: a line adds
    ``t``, the refills that ``x - q`` needs to be settled again, and its own
    refill takes one off if that leaves 1 or more. So a stock above 100 (depth
    below 0) only sinks until it is settled; from then on the depth is a walk
    with steps ``t - 1`` held at 0, whose end is told by its total and its
    lowest point. Totals and lowest points of blocks add up: no task walks over
    the lines of a product.
    """
    q = F.col("quantity").cast("long")
    rows = running_totals(lines, keys, order, {"_sum": q, "_place": F.lit(1).cast("long")}, blocks)
    stock, first = F.col("s_quantity").cast("long"), _settled(F.col("s_quantity").cast("long"))
    depth = ((first - stock) / REFILL).cast("long")

    def refills(taken: Column) -> Column:
        """All ``t`` up to where so many pieces are taken."""
        return ((_settled(stock - taken) + taken - first) / REFILL).cast("long")

    before, upto = depth + refills(F.col("_sum") - q), depth + refills(F.col("_sum"))
    walking = before >= 0  # settled before this line
    sinks = ~walking & (upto >= 0)  # settled by this line
    level = refills(F.col("_sum")) - F.col("_place")
    found = rows.groupBy(*keys).agg(
        F.max(stock).alias("_stock"),
        F.sum(q).alias("_all"),
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(sinks, level)).alias("_start"),
        F.max(F.when(sinks, F.greatest(upto - 1, F.lit(0)))).alias("_depth"),
        F.min(F.when(walking, level)).alias("_low"),
    )
    stock = F.col("_stock")
    first = _settled(stock)
    depth, left = ((first - stock) / REFILL).cast("long"), _settled(stock - F.col("_all"))
    end = ((left + F.col("_all") - first) / REFILL).cast("long") - F.col("_n")
    # settled from the beginning: the walk starts at level 0 with the stock's own depth
    start = F.when(depth >= 0, F.lit(0)).otherwise(F.col("_start"))
    at = F.when(depth >= 0, depth).otherwise(F.col("_depth"))
    walked = end - start + F.greatest(at, start - F.coalesce("_low", start))
    return found.select(*keys, F.when(start.isNull(), stock - F.col("_all")).otherwise(left - REFILL * walked).alias("left"))


def new_orders(
    districts: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    stock: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    order: Sequence[str],
    blocks: Sequence[Column],
) -> dict[str, DataFrame]:
    """A batch of orders ``(batch_id, w_id, d_id, c_id)`` and lines
    ``(batch_id, w_id, ol_number, i_id, supply_w_id, quantity)``.

    An order naming an unknown item, or one its supplier does not stock, is
    dropped whole; so is one with a line of no quantity or one below 0. The others get the next numbers of their district in
    ``order``, their lines are priced, and the total is
    ``sum × (1 + taxes) × (1 - discount)`` (taxes in 1/10000, discount in
    1/100, total in millionths of a cent, exact). Stock follows the refill rule.
    """
    stocked = stock.select(F.col("s_w_id").alias("supply_w_id"), F.col("s_i_id").alias("i_id"), F.lit(True).alias("_stocked"))
    known = lines.join(items.select("i_id", "i_price_cents"), "i_id", "left")
    priced = split_join(known, stocked, ["supply_w_id", "i_id"], "left").select(
        "batch_id", "ol_number", "i_id", "supply_w_id", "quantity",
        (F.col("quantity") * F.col("i_price_cents")).alias("ol_cents"),
        (F.col("supply_w_id") != F.col("w_id")).cast("long").alias("remote"),
        (
            F.col("i_price_cents").isNull() | F.col("_stocked").isNull() | ~F.coalesce(F.col("quantity") >= 0, F.lit(False))
        ).alias("_bad"),
    )
    # used by every output below
    priced = written(priced, "priced")
    sums = priced.groupBy("batch_id").agg(
        F.sum("ol_cents").alias("cents"),
        F.count(F.lit(1)).alias("ol_cnt"),
        (F.max("remote") == 0).cast("int").alias("all_local"),
        F.max("_bad").alias("_bad"),
    )
    checked = written(orders.join(sums, "batch_id", "left"), "checked")
    good = checked.filter("not coalesce(_bad, false)").drop("_bad")
    rejected = checked.filter("_bad").select("batch_id")
    taxed = districts.select(F.col("d_w_id").alias("w_id"), "d_id", "d_next_o_id", "w_tax_bp", "d_tax_bp")
    headers = (
        split_join(position(good, ["w_id", "d_id"], order, "_n", blocks), taxed, ["w_id", "d_id"])
        .join(customers.select("c_id", "c_discount_pct"), "c_id")
        .withColumns(
            {
                "o_id": F.col("d_next_o_id") + F.col("_n") - 1,
                # an order may hold a large share of all lines: a decimal, as a long could overflow
                "total_millionths": F.coalesce("cents", F.lit(0).cast("long")).cast("decimal(20,0)")
                * (10000 + F.col("w_tax_bp") + F.col("d_tax_bp")).cast("decimal(8,0)")
                * (100 - F.col("c_discount_pct")).cast("decimal(4,0)"),
            }
        )
    )
    sold = priced.join(rejected, "batch_id", "left_anti")
    moved = sold.groupBy(F.col("supply_w_id").alias("s_w_id"), F.col("i_id").alias("s_i_id")).agg(
        F.sum("quantity").alias("_ordered"),
        F.max("quantity").alias("_largest"),
        F.min("quantity").alias("_smallest"),
        F.count(F.lit(1)).alias("_lines"),
        F.sum("remote").alias("_remote"),
    )
    ordered = F.coalesce("_ordered", F.lit(0).cast("long"))
    # of lines of 1 to 81 pieces and stock from 0 up only the sum matters; the lines of other products are walked
    simple = F.col("_ordered").isNull() | (
        (F.col("s_quantity") >= 0) & (F.col("_smallest") >= 1) & (F.col("_largest") <= MAX_LINE)
    )
    product = ["s_w_id", "s_i_id"]
    met = written(stock.join(moved, product, "left"), "met")
    rest = met.filter(~simple).select(*product, "s_quantity")
    named = sold.withColumnsRenamed({"supply_w_id": "s_w_id", "i_id": "s_i_id"})
    extra = [c for c in order if c != "batch_id"]
    if extra:
        named = named.join(orders.select("batch_id", *extra), "batch_id")
    walked = stock_walk(named.join(rest, product), product, [*order, "ol_number", "quantity"], blocks)
    left = F.when(simple, stock_after(F.col("s_quantity"), ordered)).otherwise(F.col("left"))
    restocked = met.join(walked, product, "left").select(
        "s_w_id",
        "s_i_id",
        left.alias("s_quantity"),
        ordered.alias("s_ytd"),
        F.coalesce("_lines", F.lit(0).cast("long")).alias("s_order_cnt"),
        F.coalesce("_remote", F.lit(0).cast("long")).alias("s_remote_cnt"),
    )
    used = good.groupBy(F.col("w_id").alias("d_w_id"), "d_id").agg(F.count(F.lit(1)).alias("d_next_o_id"))
    return {
        "orders": headers,
        "lines": sold,
        "stock": restocked,
        "districts": apply_increment(districts, used, ["d_w_id", "d_id"], ["d_next_o_id"]),
        "rejected": rejected,
    }


# fixed values: the note put on a payment (customer, their district and
# warehouse, paying district and warehouse, amount) and the room for notes
NOTE = "| %d %d %d %d %d %s |"
NOTE_LENGTH = 500
SHORTEST_NOTE = 18  # "| 0 0 0 0 0 0.00 |"


def payments(customers: DataFrame, pays: DataFrame, seq: Sequence[str]) -> dict[str, DataFrame]:
    """Payments ``(c_w_id, c_d_id, c_id, w_id, d_id, cents)`` in ``seq`` order.

    Lowers the customer's balance, adds to the warehouse and district sums, and
    for bad-credit customers puts a note on each payment in front of the data
    text, cut to 500 characters. Only a customer's latest few notes can fit,
    so only those are gathered.
    """
    key = ["c_w_id", "c_d_id", "c_id"]
    sums = pays.groupBy(*key).agg(F.sum("cents").alias("_paid"), F.count(F.lit(1)).alias("_n"))
    note = F.format_string(
        NOTE,
        "c_id", "c_d_id", "c_w_id", "d_id", "w_id",
        (F.col("cents").cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").cast("string"),
    )
    bad = semi(pays, customers.filter("c_credit like 'BC%'"), key)
    newest = first_per(
        bad, key, [F.col(c).desc() for c in seq], -(-NOTE_LENGTH // SHORTEST_NOTE), out="_k"
    ).withColumn("_note", note)
    texts = newest.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_k", "_note"))).alias("_notes")).select(
        *key, F.array_join(F.transform("_notes", lambda e: e["_note"]), "").alias("_text")
    )
    paid = customers.join(sums, key, "left").join(texts, key, "left").select(
        *[c for c in customers.columns if c not in ("c_balance_cents", "c_data")],
        (F.col("c_balance_cents") - F.coalesce("_paid", F.lit(0))).alias("c_balance_cents"),
        F.coalesce("_paid", F.lit(0).cast("long")).alias("c_ytd_payment_cents"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("c_payment_cnt"),
        F.when(F.col("_text").isNull(), F.col("c_data"))
        .otherwise(F.substring(F.concat("_text", F.coalesce("c_data", F.lit(""))), 1, NOTE_LENGTH))
        .alias("c_data"),
    )
    history = pays.select(
        *key, "d_id", "w_id", "cents",
        F.concat(F.lit("W"), F.col("w_id").cast("string"), F.lit(" D"), F.col("d_id").cast("string")).alias("h_data"),
    )
    return {
        "customers": paid,
        "districts": pays.groupBy("w_id", "d_id").agg(F.sum("cents").alias("d_ytd_cents")),
        "warehouses": pays.groupBy("w_id").agg(F.sum("cents").alias("w_ytd_cents")),
        "history": history,
    }


def delivery(
    waiting: DataFrame, orders: DataFrame, lines: DataFrame, customers: DataFrame, carrier: int, delivered_at: Column
) -> dict[str, DataFrame]:
    """Deliver the oldest waiting order of every district."""
    key = ["w_id", "d_id", "o_id"]
    # one order per district, met by three large tables
    oldest = written(earliest_per(waiting.select(*key), ["w_id", "d_id"], ["o_id"]), "oldest")
    picked = oldest.withColumn("_hit", F.lit(True))
    shipped = orders.join(picked, key, "left").withColumn(
        "o_carrier_id", F.when(F.col("_hit"), F.lit(carrier)).otherwise(F.col("o_carrier_id"))
    )
    dated = lines.join(picked, key, "left").withColumn(
        "ol_delivery_d", F.when(F.col("_hit"), delivered_at).otherwise(F.col("ol_delivery_d"))
    )
    amounts = lines.join(oldest, key, "left_semi").groupBy(*key).agg(F.sum("ol_cents").alias("c_balance_cents"))
    owed = (
        orders.join(oldest, key, "left_semi")
        .select(*key, "c_id")
        .join(amounts, key, "left")
        .select("c_id", F.coalesce("c_balance_cents", F.lit(0).cast("long")).alias("c_balance_cents"),
                F.lit(1).cast("long").alias("c_delivery_cnt"))
    )
    return {
        "waiting": apply_delete(waiting, oldest, key),
        "orders": shipped.drop("_hit"),
        "lines": dated.drop("_hit"),
        "customers": apply_increment(customers, owed, ["c_id"], ["c_balance_cents", "c_delivery_cnt"]),
    }


def order_status(customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Each given customer's latest order and its lines."""
    latest = latest_per(
        orders.select(F.col("o_c_id").alias("c_id"), "o_id", "o_carrier_id", "o_entry_d"), ["c_id"], ["o_id"]
    )
    found = customers.join(latest, "c_id")
    return found.join(lines, F.col("o_id") == F.col("ol_o_id"))


def stock_level(
    stock: DataFrame, orders: DataFrame, lines: DataFrame, districts: DataFrame, threshold: int, last: int
) -> DataFrame:
    """Per district: distinct items of its last orders whose stock in the district's warehouse is low.

    The orders (o_w_id, o_d_id, o_id) are cut to the last ones first; the lines
    (ol_o_id, ol_i_id) meet those alone.
    """
    upper = districts.select(F.col("d_w_id").alias("ol_w_id"), F.col("d_id").alias("ol_d_id"), "d_next_o_id")
    placed = orders.select(F.col("o_w_id").alias("ol_w_id"), F.col("o_d_id").alias("ol_d_id"), F.col("o_id").alias("ol_o_id"))
    newest = split_join(placed, upper, ["ol_w_id", "ol_d_id"]).filter(
        (F.col("ol_o_id") >= F.greatest(F.lit(1), F.col("d_next_o_id") - last)) & (F.col("ol_o_id") < F.col("d_next_o_id"))
    )
    # at most `last` orders a district: written, so that their size is known
    newest = written(newest.drop("d_next_o_id"), "newest")
    recent = lines.select("ol_o_id", "ol_i_id").join(newest, "ol_o_id").select("ol_w_id", "ol_d_id", "ol_i_id").distinct()
    low = stock.filter(F.col("s_quantity") < threshold).select(
        F.col("s_w_id").alias("ol_w_id"), F.col("s_i_id").alias("ol_i_id"), F.lit(1).alias("_low")
    )
    counted = recent.join(low, ["ol_w_id", "ol_i_id"]).groupBy("ol_w_id", "ol_d_id").agg(
        F.count(F.lit(1)).alias("low_stock")
    )
    names = districts.select(F.col("d_w_id").alias("ol_w_id"), F.col("d_id").alias("ol_d_id"))
    return names.join(counted, ["ol_w_id", "ol_d_id"], "left").select(
        F.col("ol_w_id").alias("w_id"), F.col("ol_d_id").alias("d_id"),
        F.coalesce("low_stock", F.lit(0).cast("long")).alias("low_stock"),
    )
