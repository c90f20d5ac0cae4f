"""Change batches applied to tables. Each batch is derived from the whole given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.operators import changes, joins, versions, wholesale
from tallygrain.operators.ordered import block_of
from tallygrain.registry import query
from tallygrain.session import written
from tallygrain.shapes import shape, stored_shape

ID_BLOCK = 1 << 16


def _load(spark, sf, *names):
    return [shape(spark, sf, n) for n in names]


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# --- ids --------------------------------------------------------------------------
@query(
    "assign_ids",
    """select s_suppkey, s_name, (select max(c_custkey) from customer)
              + row_number() over (order by md5(s_name), s_name) as customer_id from supplier""",
)
def assign_ids(spark, sf):
    new, existing = _load(spark, sf, "supplier", "customer")
    return changes.assign_ids(new.select("s_suppkey", "s_name"), existing, "c_custkey", "s_name").withColumnRenamed(
        "c_custkey", "customer_id"
    )


@query(
    "assign_ids_per_group",
    """with r as (select n_nationkey, n_nationkey::bigint * 1000000000 + 1 as low from nation),
            used as (select c_nationkey, max(c_nationkey::bigint * 1000000000 + 1 + c_custkey) as u from customer
                     where c_acctbal > 0 group by 1)
       select s_suppkey, s_nationkey as nation, greatest(low - 1, coalesce(u, low - 1))
              + row_number() over (partition by s_nationkey order by s_suppkey) as id
       from supplier join r on n_nationkey = s_nationkey left join used on c_nationkey = s_nationkey""",
)
def assign_ids_per_group(spark, sf):
    supplier, customer, nation = _load(spark, sf, "supplier", "customer", "nation")
    low = (F.col("nation").cast("long") * 1_000_000_000 + 1).alias("low")
    high = (F.col("nation").cast("long") * 1_000_000_000 + 1_000_000_000).alias("high")
    ranges = nation.select(F.col("n_nationkey").alias("nation")).select("nation", low, high)
    existing = customer.filter("c_acctbal > 0").select(
        F.col("c_nationkey").alias("nation"),
        (F.col("c_nationkey").cast("long") * 1_000_000_000 + 1 + F.col("c_custkey")).alias("id"),
    )
    new = supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return changes.assign_group_ids(
        new, existing, ranges, "nation", "id", ["s_suppkey"], [block_of("s_suppkey", ID_BLOCK)]
    )


# --- keyed changes -------------------------------------------------------------------
@query(
    "keyed_update",
    """with c as (select customer_id, arg_max(total_cents, order_date::varchar || lpad(order_id::varchar, 20, '0')) as v
                  from oe_orders where order_status = 4 group by 1)
       select customer_id, cust_last_name, coalesce(v, credit_cents) as credit_cents
       from oe_customers left join c using (customer_id)""",
)
def keyed_update(spark, sf):
    customers, orders = _load(spark, sf, "oe_customers", "oe_orders")
    limits = orders.filter("order_status = 4").select(
        "customer_id", "order_date", "order_id", F.col("total_cents").alias("credit_cents")
    )
    return changes.apply_update(
        customers.select("customer_id", "cust_last_name", "credit_cents"),
        limits, ["customer_id"], ["order_date", "order_id"],
    )


@query(
    "keyed_increment",
    """with d as (select product_id, supplier_id % 10 + 1 as warehouse_id, sum(quantity) as q
                  from oe_items where return_flag = 'R' group by all)
       select i.product_id, i.warehouse_id, cast(quantity_on_hand + coalesce(q, 0) as bigint) as quantity_on_hand
       from oe_inventories i left join d on d.product_id = i.product_id and d.warehouse_id = i.warehouse_id""",
)
def keyed_increment(spark, sf):
    inventory, items = _load(spark, sf, "oe_inventories", "oe_items")
    returned = items.filter("return_flag = 'R'").select(
        "product_id", (F.col("supplier_id") % 10 + 1).alias("warehouse_id"), F.col("quantity").alias("quantity_on_hand")
    )
    return changes.apply_increment(inventory, returned, ["product_id", "warehouse_id"], ["quantity_on_hand"])


@query(
    "keyed_delete",
    """select order_id, customer_id, total_cents from oe_orders
       where customer_id not in (select customer_id from oe_customers where credit_cents < 0)""",
)
def keyed_delete(spark, sf):
    orders, customers = _load(spark, sf, "oe_orders", "oe_customers")
    return changes.apply_delete(
        orders.select("order_id", "customer_id", "total_cents"), customers.filter("credit_cents < 0"), ["customer_id"]
    )


@query(
    "versioned_replace",
    """with docs as (select customer_id, count(*) as version, max(order_date) as d, max(total_cents) as body from oe_orders group by 1),
            ch as (select o.customer_id, o.order_id as seq, o.total_cents as body, k.expected
                   from oe_orders o join (select customer_id, count(*) as expected from oe_orders
                                          where order_date < date '2001-03-01' group by 1) k using (customer_id)
                   where o.order_status = 2),
            hit as (select c.customer_id, min(seq) as seq, arg_min(c.body, seq) as body
                    from ch c join docs d on d.customer_id = c.customer_id and d.version = c.expected group by 1)
       select d.customer_id, d.version + case when h.seq is null then 0 else 1 end as version,
              coalesce(h.body, d.body) as body,
              (select count(*) from ch) - (select count(*) from hit) as rejected_in_batch
       from docs d left join hit h using (customer_id)""",
)
def versioned_replace(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("customer_id", "order_id", "total_cents", "order_date", "order_status")
    docs = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("version"), F.max("total_cents").alias("body")
    )
    expected = orders.filter("order_date < date '2001-03-01'").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("version")
    )
    batch = joins.split_join(orders.filter("order_status = 2"), expected, ["customer_id"]).select(
        "customer_id", "version", F.col("order_id").alias("seq"), F.col("total_cents").alias("body")
    )
    table, rejected = changes.replace_if_version(docs, batch, "customer_id", "version", ["seq"])
    stale = rejected.agg(F.count(F.lit(1))).scalar()
    return table.withColumn("rejected_in_batch", stale)


@query(
    "insert_if_absent",
    """with cur as (select cust_email, customer_id, 0::bigint as first_order from oe_customers where credit_cents < 500000),
            cand as (select c.cust_email, min(o.order_id) as order_id, arg_min(o.customer_id, o.order_id) as customer_id
                     from oe_orders o join oe_customers c using (customer_id) group by 1)
       select * from cur union all
       select cust_email, customer_id, order_id from cand where cust_email not in (select cust_email from cur)""",
)
def insert_if_absent(spark, sf):
    customers, orders = _load(spark, sf, "oe_customers", "oe_orders")
    emails = customers.select("customer_id", "cust_email")
    current = customers.filter("credit_cents < 500000").select(
        "cust_email", "customer_id", F.lit(0).cast("long").alias("first_order")
    )
    candidates = orders.select("customer_id", F.col("order_id").alias("first_order")).join(emails, "customer_id")
    return changes.insert_if_absent(current, candidates, ["cust_email"], ["first_order"])


@query(
    "switch_default_flag",
    """with cur as (select card_id, customer_id, case when card_id = max(card_id) over (partition by customer_id)
                           then 'Y' else 'N' end as is_default from oe_cards),
            new as (select 1000000000000 + event_id as card_id, user_id as customer_id from events where event_type = 'purchase')
       select card_id, customer_id, case when customer_id in (select customer_id from new) then 'N' else is_default end as is_default
       from cur union all
       select card_id, customer_id, case when card_id = max(card_id) over (partition by customer_id) then 'Y' else 'N' end
       from new""",
)
def switch_default_flag(spark, sf):
    cards, events = _load(spark, sf, "oe_cards", "events")
    newest = cards.groupBy("customer_id").agg(F.max("card_id").alias("_max"))
    current = joins.split_join(cards.select("card_id", "customer_id"), newest, ["customer_id"]).select(
        "card_id", "customer_id", F.when(F.col("card_id") == F.col("_max"), "Y").otherwise("N").alias("is_default")
    )
    new = events.filter("event_type = 'purchase'").select(
        (F.col("event_id") + 1_000_000_000_000).alias("card_id"), F.col("user_id").alias("customer_id")
    )
    return changes.switch_default(current, new, "customer_id", "is_default", ["card_id"])


@query(
    "add_and_prefer",
    """with new as (select 1000000000000 + event_id as address_id, user_id as customer_id, ts from events where event_type = 'signup')
       select c.customer_id, coalesce(p.address_id, c.customer_id) as preferred_address,
              (select count(*) from oe_addresses) + (select count(*) from new) as addresses
       from oe_customers c left join (select customer_id, arg_max(address_id, address_id) as address_id from new group by 1) p
         using (customer_id)""",
)
def add_and_prefer(spark, sf):
    customers, addresses, events = _load(spark, sf, "oe_customers", "oe_addresses", "events")
    new = events.filter("event_type = 'signup'").select(
        (F.col("event_id") + 1_000_000_000_000).alias("address_id"), F.col("user_id").alias("customer_id"),
        F.col("event_id").alias("seq"),
    )
    known = customers.select("customer_id", F.col("customer_id").alias("preferred_address"))
    preferred, table = changes.add_preferred(known, addresses.select("address_id", "customer_id"), new, ["seq"])
    return preferred.withColumn("addresses", table.agg(F.count(F.lit(1))).scalar())


@query(
    "add_customer_bundle",
    """with new as (select s_name, n_name, (select max(c_custkey) from customer) + row_number() over (order by md5(s_name), s_name) as id
                    from supplier join nation on n_nationkey = s_nationkey)
       select 'customers' as table_name, customer_id as id, cust_last_name as detail from oe_customers
       union all select 'customers', id, s_name from new
       union all select 'addresses', address_id, country from oe_addresses
       union all select 'addresses', id, n_name from new
       union all select 'cards', customer_id, null from oe_cards
       union all select 'cards', id, null from new
       union all select 'logon', user_id, cast(cast(ts as date) as varchar) from events where event_type in ('signup', 'view')
       union all select 'logon', id, '2024-02-01' from new""",
)
def add_customer_bundle(spark, sf):
    customers, addresses, cards, events, supplier, nation = _load(
        spark, sf, "oe_customers", "oe_addresses", "oe_cards", "events", "supplier", "nation"
    )
    tables = {
        "customers": customers.select("customer_id", F.col("cust_last_name").alias("name")),
        "addresses": addresses.select("address_id", "customer_id", "country"),
        "cards": cards.select("card_id", "customer_id"),
        "logon": events.filter("event_type in ('signup', 'view')").select(
            F.col("user_id").alias("customer_id"), F.col("ts").cast("date").alias("logon_date")
        ),
    }
    new = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        "s_name", F.col("n_name").alias("country"), F.lit("2024-02-01").cast("date").alias("since")
    )
    after = changes.add_customers(tables, new, "s_name")
    detail = {"customers": "name", "addresses": "country", "cards": None, "logon": "logon_date"}
    parts = [
        after[name].select(
            F.lit(name).alias("table_name"),
            F.col("address_id" if name == "addresses" else "customer_id").alias("id"),
            (F.col(c).cast("string") if c else F.lit(None).cast("string")).alias("detail"),
        )
        for name, c in detail.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# --- orders ----------------------------------------------------------------------------
@query(
    "apply_orders",
    """with inv as (select product_id, warehouse_id, quantity_on_hand - 40 as q from oe_inventories),
            lines as (select i.order_id + 1000000000000 as order_id, i.product_id, o.warehouse_id, i.quantity, i.amount_cents
                      from oe_items i join oe_orders o using (order_id) where o.order_status = 4),
            ok as (select l.* from lines l join inv using (product_id, warehouse_id) where q > 0),
            tot as (select order_id, sum(amount_cents)::bigint as cents from ok group by 1),
            taken as (select product_id, warehouse_id, sum(quantity) as q from ok group by all)
       select 'orders' as table_name, order_id as id, 0::bigint as part, total_cents as amount from oe_orders
       union all select 'orders', o.order_id + 1000000000000, 0, coalesce(cents, 0)
         from oe_orders o left join tot on tot.order_id = o.order_id + 1000000000000 where o.order_status = 4
       union all select 'items', order_id, product_id, amount_cents from oe_items
       union all select 'items', order_id, product_id, amount_cents from ok
       union all select 'inventory', inv.product_id, inv.warehouse_id, cast(inv.q - coalesce(taken.q, 0) as bigint)
         from inv left join taken using (product_id, warehouse_id)""",
)
def apply_orders(spark, sf):
    orders, items = _load(spark, sf, "oe_orders", "oe_items")
    inventory = stored_shape(spark, sf, "oe_inventories")
    # the given stock less 40, so that some lines find none
    stock = inventory.withColumn("quantity_on_hand", F.col("quantity_on_hand") - 40)
    again = orders.filter("order_status = 4").select("order_id", "warehouse_id")
    shift = (F.col("order_id") + 1_000_000_000_000).alias("order_id")
    lines = items.join(again, "order_id").select(shift, "product_id", "warehouse_id", "quantity", "amount_cents")
    after = changes.apply_orders(
        orders.select("order_id", "total_cents"),
        items.select("order_id", "product_id", "quantity", "amount_cents"),
        stock, again.select(shift), lines,
    )
    zero = F.lit(0).cast("long")
    parts = [
        after["orders"].select(F.lit("orders").alias("table_name"), F.col("order_id").alias("id"), zero.alias("part"), F.col("total_cents").alias("amount")),
        after["items"].select(F.lit("items").alias("table_name"), F.col("order_id").alias("id"), F.col("product_id").alias("part"), F.col("amount_cents").alias("amount")),
        after["inventory"].select(F.lit("inventory").alias("table_name"), F.col("product_id").alias("id"), F.col("warehouse_id").alias("part"), F.col("quantity_on_hand").alias("amount")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "advance_status",
    """with work as (select order_id from (select order_id, row_number() over (partition by warehouse_id order by order_date, order_id) as rn
                     from oe_orders where order_status <= 4) where rn <= 9)
       select order_id, warehouse_id, case when order_id in (select order_id from work) then 7 else order_status end as order_status
       from oe_orders""",
)
def advance_status(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("order_id", "warehouse_id", "order_date", "order_status")
    return changes.process_orders(orders, 9, open_status=4, new_status=7).drop("order_date")


@query(
    "bump_line_and_total",
    """with l as (select order_id, line_item_id, quantity, cast(floor(amount_cents / quantity) as bigint) as unit_cents from oe_lines),
            p as (select order_id, product_id * 10 + line_no as line_item_id, count(*) as n from oe_items where return_flag = 'A' group by all),
            t as (select order_id, sum(n * unit_cents) as c from p join l using (order_id, line_item_id) group by 1)
       select 'item' as kind, l.order_id, l.line_item_id, cast(l.quantity + coalesce(n, 0) as bigint) as value
       from l left join p using (order_id, line_item_id)
       union all select 'order', o.order_id, 0, cast(o.total_cents + coalesce(c, 0) as bigint) from oe_orders o left join t using (order_id)""",
)
def bump_line_and_total(spark, sf):
    lines, orders, items = _load(spark, sf, "oe_lines", "oe_orders", "oe_items")
    unit = F.floor(F.col("amount_cents") / F.col("quantity")).alias("unit_cents")
    picks = items.filter("return_flag = 'A'").select(
        "order_id", (F.col("product_id") * 10 + F.col("line_no")).alias("line_item_id")
    )
    raised, totals = changes.bump_lines(
        lines.select("order_id", "line_item_id", F.col("quantity").cast("long").alias("quantity"), unit),
        orders.select("order_id", "total_cents"), picks,
    )
    return raised.select(
        F.lit("item").alias("kind"), "order_id", "line_item_id", F.col("quantity").alias("value")
    ).unionByName(
        totals.select(F.lit("order").alias("kind"), "order_id", F.lit(0).cast("long").alias("line_item_id"),
                      F.col("total_cents").alias("value"))
    )


# --- wholesale --------------------------------------------------------------------------
# the batch: every order of status P placed again
WS_BATCH_SQL = """
  ord as (select o_id as batch_id, o_w_id as w_id, o_d_id as d_id, o_c_id as c_id from ws_orders where o_status = 'P'),
  lin as (select ol_o_id as batch_id, ol_number, ol_i_id as i_id, ol_supply_w_id as supply_w_id, ol_quantity as quantity
          from ws_order_line where ol_status = 'P'),
  bad as (select distinct batch_id from lin where i_id not in (select i_id from ws_item)),
  good as (select * from ord where batch_id not in (select batch_id from bad)),
  num as (select *, row_number() over (partition by w_id, d_id order by batch_id) as n from good),
  priced as (select lin.*, quantity * i_price_cents as ol_cents, case when supply_w_id <> w_id then 1 else 0 end as remote
             from lin join good using (batch_id) join ws_item using (i_id)),
  sums as (select batch_id, sum(ol_cents) as cents, count(*) as ol_cnt, case when max(remote) = 0 then 1 else 0 end as all_local
           from priced group by 1)"""


def _ws_batch(spark, sf):
    orders, lines = _load(spark, sf, "ws_orders", "ws_order_line")
    batch = orders.filter("o_status = 'P'").select(
        F.col("o_id").alias("batch_id"), F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id"), F.col("o_c_id").alias("c_id")
    )
    batch_lines = lines.filter("ol_status = 'P'").select(
        F.col("ol_o_id").alias("batch_id"), F.col("ol_w_id").alias("w_id"), "ol_number", F.col("ol_i_id").alias("i_id"),
        F.col("ol_supply_w_id").alias("supply_w_id"), F.col("ol_quantity").alias("quantity"),
    )
    customers, items = _load(spark, sf, "ws_customer", "ws_item")
    districts, stock = (stored_shape(spark, sf, name) for name in ("ws_district", "ws_stock"))
    return wholesale.new_orders(
        districts, customers, items, stock, batch, batch_lines, ["batch_id"], [block_of("batch_id", ID_BLOCK)]
    )


@query(
    "wholesale_new_order",
    f"""with {WS_BATCH_SQL}
        select 'order' as kind, batch_id as a, d_next_o_id + n - 1 as b, coalesce(ol_cnt, 0) as c,
               cast(coalesce(cents, 0)::hugeint * (10000 + w_tax_bp + d_tax_bp) * (100 - c_discount_pct) as varchar) as d
        from num join ws_district on d_w_id = w_id and ws_district.d_id = num.d_id
             join ws_customer on ws_customer.c_id = num.c_id left join sums using (batch_id)
        union all
        select 'rejected', batch_id, 0, 0, '0' from bad
        union all
        select 'district', d_w_id, dd.d_id, d_next_o_id + coalesce(k, 0), '0'
        from ws_district dd left join (select w_id, d_id, count(*) as k from good group by all) g
             on g.w_id = dd.d_w_id and g.d_id = dd.d_id
        union all
        select 'stock', s_w_id, s_i_id, coalesce(m.remote, 0),
               cast(case when coalesce(m.q, 0) = 0 or s_quantity - m.q >= 10 then s_quantity - coalesce(m.q, 0)
                    else ((s_quantity - m.q - 10) % 91 + 91) % 91 + 10 end as varchar)
        from ws_stock left join (select supply_w_id, i_id, sum(quantity) as q, sum(remote)::bigint as remote from priced group by all) m
             on m.supply_w_id = s_w_id and m.i_id = s_i_id""",
)
def wholesale_new_order(spark, sf):
    """New orders, rejected orders, next order numbers and stock after the batch, as one long table."""
    after = _ws_batch(spark, sf)
    zero = F.lit(0).cast("long")

    def rows(kind, df, a, b, c, d):
        numbers = [x.cast("long").alias(n) for n, x in zip("abc", (a, b, c))]
        return df.select(F.lit(kind).alias("kind"), *numbers, d.cast("string").alias("d"))

    col = F.col
    parts = [
        rows("order", after["orders"], col("batch_id"), col("o_id"), F.coalesce("ol_cnt", zero), col("total_millionths")),
        rows("rejected", after["rejected"], col("batch_id"), zero, zero, zero),
        rows("district", after["districts"], col("d_w_id"), col("d_id"), col("d_next_o_id"), zero),
        rows("stock", after["stock"], col("s_w_id"), col("s_i_id"), col("s_remote_cnt"), col("s_quantity")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "wholesale_payment",
    """with pays as (select c_w_id, c_d_id, c_id, c_w_id as w_id, c_d_id as d_id, o_orderkey as seq,
                            cast(round(o_totalprice * 100) as bigint) as cents
                     from orders join ws_customer on c_id = o_custkey where o_orderstatus <> 'O'),
            notes as (select c_id, string_agg('| ' || c_id || ' ' || c_d_id || ' ' || c_w_id || ' ' || d_id || ' ' || w_id || ' '
                             || cast(cents // 100 as varchar) || '.' || lpad(cast(cents % 100 as varchar), 2, '0') || ' |', '' order by seq desc) as t,
                             sum(cents) as paid, count(*) as n from pays group by c_id)
       select 'customer' as kind, c.c_id as id, (c_balance_cents - coalesce(paid, 0))::bigint as cents, coalesce(n, 0) as n,
              case when c_credit = 'BC' and t is not null then substr(t || c_data, 1, 500) else c_data end as data
       from ws_customer c left join notes using (c_id)
       union all select 'district', w_id * 100 + d_id, sum(cents)::bigint, 0, null from pays group by w_id, d_id
       union all select 'warehouse', w_id, sum(cents)::bigint, 0, null from pays group by w_id
       union all select 'history', c_id, cents, 0, 'W' || w_id || ' D' || d_id from pays""",
)
def wholesale_payment(spark, sf):
    """Customers, sums and history rows after paying every order that is not open."""
    customers, orders = _load(spark, sf, "ws_customer", "orders")
    pays = (
        orders.filter("o_orderstatus <> 'O'")
        .select(F.col("o_custkey").alias("c_id"), F.col("o_orderkey").alias("seq"),
                F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
        .join(customers.select("c_id", "c_w_id", "c_d_id"), "c_id")
        .select("c_w_id", "c_d_id", "c_id", F.col("c_w_id").alias("w_id"), F.col("c_d_id").alias("d_id"), "seq", "cents")
    )
    after = wholesale.payments(customers, pays, ["seq"])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")

    def rows(kind, df, ident, cents, n, data):
        return df.select(F.lit(kind).alias("kind"), ident.cast("long").alias("id"), cents.cast("long").alias("cents"),
                         n.alias("n"), data.alias("data"))

    col = F.col
    parts = [
        rows("customer", after["customers"], col("c_id"), col("c_balance_cents"), col("c_payment_cnt"), col("c_data")),
        rows("district", after["districts"], col("w_id") * 100 + col("d_id"), col("d_ytd_cents"), zero, none),
        rows("warehouse", after["warehouses"], col("w_id"), col("w_ytd_cents"), zero, none),
        rows("history", after["history"], col("c_id"), col("cents"), zero, col("h_data")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "wholesale_delivery",
    """with old as (select o_w_id, o_d_id, min(o_id) as o_id from ws_orders where o_status = 'O' group by all),
            amt as (select ol_o_id as o_id, sum(ol_cents) as cents from ws_order_line group by 1)
       select 'waiting' as kind, o_id as id, 0::bigint as a, null as b from ws_orders
         where o_status = 'O' and o_id not in (select o_id from old)
       union all select 'order', o_id, case when o_id in (select o_id from old) then 6 else o_carrier_id end, null from ws_orders
       union all select 'line', ol_o_id, ol_i_id, case when ol_o_id in (select o_id from old) then '2002-01-01'
                        else cast(ol_delivery_d as varchar) end from ws_order_line
       union all select 'customer', c.c_id, (c.c_balance_cents + coalesce(x.cents, 0))::bigint, cast(coalesce(x.n, 0) as varchar)
         from ws_customer c left join (select o_c_id, sum(coalesce(cents, 0)) as cents, count(*) as n
                                       from old join ws_orders using (o_id) left join amt using (o_id) group by 1) x on x.o_c_id = c.c_id""",
)
def wholesale_delivery(spark, sf):
    """All four tables after delivering the oldest waiting order of every district."""
    orders, lines, customers = _load(spark, sf, "ws_orders", "ws_order_line", "ws_customer")
    keyed = orders.select(
        F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id"), "o_id", F.col("o_c_id").alias("c_id"),
        "o_carrier_id", "o_status",
    )
    keyed_lines = lines.select(
        F.col("ol_w_id").alias("w_id"), F.col("ol_d_id").alias("d_id"), F.col("ol_o_id").alias("o_id"),
        "ol_i_id", "ol_cents", "ol_delivery_d",
    )
    people = customers.select("c_id", "c_balance_cents", F.lit(0).cast("long").alias("c_delivery_cnt"))
    after = wholesale.delivery(
        keyed.filter("o_status = 'O'").select("w_id", "d_id", "o_id"), keyed, keyed_lines, people, 6,
        F.lit("2002-01-01").cast("date"),
    )
    none = F.lit(None).cast("string")

    def rows(kind, df, ident, a, b):
        return df.select(F.lit(kind).alias("kind"), ident.alias("id"), a.cast("long").alias("a"), b.cast("string").alias("b"))

    col = F.col
    parts = [
        rows("waiting", after["waiting"], col("o_id"), F.lit(0), none),
        rows("order", after["orders"], col("o_id"), col("o_carrier_id"), none),
        rows("line", after["lines"], col("o_id"), col("ol_i_id"), col("ol_delivery_d")),
        rows("customer", after["customers"], col("c_id"), col("c_balance_cents"), col("c_delivery_cnt")),
    ]
    return reduce(DataFrame.unionByName, parts)


# fixed values: the three sales channels
CHANNELS = ["store", "catalog", "web"]


@query(
    "sales_returns_ingest",
    """with l as (select order_id, line_item_id, (product_id % 3) as ch, quantity, amount_cents from oe_lines),
            r as (select order_id, product_id * 10 + line_no as line_item_id, sum(quantity) as q, sum(amount_cents) as c
                  from oe_items where return_flag = 'R' group by all)
       select (['store','catalog','web'])[cast(ch as int) + 1] as channel, 'sales' as fact, l.order_id, l.line_item_id,
              cast(case when r.order_id is null then l.quantity else l.quantity - r.q end as bigint) as quantity
       from l left join r using (order_id, line_item_id)
       union all
       select (['store','catalog','web'])[cast(l.ch as int) + 1], 'returns', r.order_id, r.line_item_id, cast(r.q as bigint)
       from r join l using (order_id, line_item_id)""",
)
def sales_returns_ingest(spark, sf):
    """Sales and returns of three channels: returns appended, the sale of a returned line updated."""
    lines, items = _load(spark, sf, "oe_lines", "oe_items")
    key = ["order_id", "line_item_id"]
    channel = F.get(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("product_id") % 3).cast("int"))
    sales = lines.select(channel.alias("channel"), *key, F.col("quantity").cast("long").alias("quantity"))
    returned = (
        items.filter("return_flag = 'R'")
        .groupBy("order_id", (F.col("product_id") * 10 + F.col("line_no")).alias("line_item_id"), "product_id")
        .agg(F.sum("quantity").cast("long").alias("quantity"))
        .select(channel.alias("channel"), *key, "quantity")
    )
    left = sales.join(returned.select(*key, F.col("quantity").alias("_back")), key).select(
        "channel", *key, (F.col("quantity") - F.col("_back")).alias("quantity")
    )
    after = changes.upsert(sales, left, key).withColumn("fact", F.lit("sales"))
    return changes.append(after, returned.withColumn("fact", F.lit("returns")))


@query(
    "inventory_ingest",
    """with back as (select product_id, supplier_id % 10 + 1 as warehouse_id, sum(quantity) as q
                     from oe_items where return_flag = 'R' group by all)
       select product_id, warehouse_id, cast(coalesce(quantity_on_hand, 0) + coalesce(q, 0) as bigint) as quantity_on_hand,
              case when quantity_on_hand is null then 'new' when q is null then 'kept' else 'updated' end as change
       from oe_inventories full join back using (product_id, warehouse_id)""",
)
def inventory_ingest(spark, sf):
    """Returned pieces go back to stock: known stock is raised, a product new to a warehouse gets a row."""
    inventory, items = _load(spark, sf, "oe_inventories", "oe_items")
    back = items.filter("return_flag = 'R'").select(
        "product_id", (F.col("supplier_id") % 10 + 1).alias("warehouse_id"), F.col("quantity").alias("quantity_on_hand")
    )
    return changes.add_or_insert(inventory, back, ["product_id", "warehouse_id"], "quantity_on_hand")


# --- versioned rows ------------------------------------------------------------------------
CIRCLE_SQL = """
  ev as (select customer_id, line_no as index_id, product_id as line, ship_date as d, order_id, supplier_id, quantity, amount_cents
         from oe_items join oe_orders using (order_id))"""


def _circle_events(spark, sf):
    items, orders = _load(spark, sf, "oe_items", "oe_orders")
    return items.join(orders.select("order_id", "customer_id"), "order_id").select(
        "customer_id", F.col("line_no").alias("index_id"), F.col("product_id").alias("line"),
        F.col("ship_date").alias("d"), "order_id", "supplier_id", "quantity", "amount_cents",
    )


CIRCLE_ORDER = ["d", "order_id", "line", "supplier_id", "quantity", "amount_cents"]


@query(
    "scd2_history",
    f"""with {CIRCLE_SQL}
        select customer_id, index_id, line, cast(d as varchar) as valid_from,
               cast(lead(d) over (partition by customer_id, index_id order by d, order_id, line, supplier_id, quantity, amount_cents) as varchar) as valid_to
        from ev""",
)
def scd2_history(spark, sf):
    history = versions.scd2_history(
        written(_circle_events(spark, sf), "circle"), ["customer_id", "index_id"], CIRCLE_ORDER, "valid_to", [F.col("d")]
    )
    return _text(
        history.select("customer_id", "index_id", "line", F.col("d").alias("valid_from"), "valid_to"),
        "valid_from", "valid_to",
    )


@query(
    "scd2_current",
    f"""with {CIRCLE_SQL}, h as (
          select *, lead(d) over (partition by customer_id, index_id order by d, order_id, line, supplier_id, quantity, amount_cents) as valid_to from ev)
        select customer_id, index_id, line, cast(d as varchar) as valid_from from h where valid_to is null""",
)
def scd2_current(spark, sf):
    history = versions.scd2_history(
        written(_circle_events(spark, sf), "circle"), ["customer_id", "index_id"], CIRCLE_ORDER, "valid_to", [F.col("d")]
    )
    current = versions.scd2_current(history)
    return _text(current.select("customer_id", "index_id", "line", F.col("d").alias("valid_from")), "valid_from")


@query(
    "scd2_apply",
    f"""with {CIRCLE_SQL},
        base as (select customer_id, index_id, max(product_id) as line, date '1995-01-01' as valid_from
                 from (select customer_id, line_no as index_id, product_id from oe_items join oe_orders using (order_id)
                       where ship_date < date '2001-01-01') group by all),
        ch as (select customer_id, index_id, line, d, order_id, line as l2, supplier_id, quantity, amount_cents from ev where d >= date '2001-01-01'),
        r as (select *, row_number() over (partition by customer_id order by d, order_id, index_id, line, supplier_id, quantity, amount_cents) as rn from ch),
        taken as (select *, lead(d) over (partition by customer_id, index_id order by rn) as nxt from r where rn <= 3)
      select 'version' as kind, b.customer_id, b.index_id, b.line, cast(b.valid_from as varchar) as valid_from, cast(f.d as varchar) as valid_to
      from base b left join (select customer_id, index_id, min(d) as d from taken group by all) f using (customer_id, index_id)
      union all select 'version', customer_id, index_id, line, cast(d as varchar), cast(nxt as varchar) from taken
      union all select 'rejected', customer_id, index_id, line, cast(d as varchar), null from r where rn > 3""",
)
def scd2_apply(spark, sf):
    """A circle's versions after a year of changes, three allowed per customer; the rest is rejected."""
    events = written(_circle_events(spark, sf), "events")
    members = (
        events.filter("d < date '2001-01-01'")
        .groupBy("customer_id", "index_id")
        .agg(F.max("line").alias("line"))
        .withColumns({"valid_from": F.lit("1995-01-01").cast("date"), "valid_to": F.lit(None).cast("date")})
    )
    seq = ["d", "order_id", "index_id", "line", "supplier_id", "quantity", "amount_cents"]
    table, rejected = versions.scd2_apply(
        members, events.filter("d >= date '2001-01-01'"), "customer_id", "index_id", seq, allowance=3
    )
    out = ["customer_id", "index_id", "line", "valid_from", "valid_to"]
    refused = rejected.select(*out[:3], F.col("d").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return _text(
        table.select(F.lit("version").alias("kind"), *out).unionByName(
            refused.select(F.lit("rejected").alias("kind"), *out)
        ),
        "valid_from", "valid_to",
    )


# --- whole tables -----------------------------------------------------------------------------
@query(
    "scale_up",
    """with cs as (select max(c_custkey) + 1 as s from customer), os as (select max(o_orderkey) + 1 as s from orders)
       select o_orderkey + k * os.s as o_orderkey, o_custkey + k * cs.s as o_custkey, c_name
       from orders join customer on c_custkey = o_custkey, cs, os, range(3) r(k)""",
)
def scale_up(spark, sf):
    """Customers and orders three times, then joined."""
    customer, orders = _load(spark, sf, "customer", "orders")
    customer_step = customer.agg(F.max("c_custkey") + 1)
    order_step = orders.agg(F.max("o_orderkey") + 1)
    scaled = changes.scale_up(
        {"customer": customer.select("c_custkey", "c_name"), "orders": orders.select("o_orderkey", "o_custkey")},
        3,
        {"customer": {"c_custkey": customer_step}, "orders": {"o_orderkey": order_step, "o_custkey": customer_step}},
    )
    return scaled["orders"].join(scaled["customer"], F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
