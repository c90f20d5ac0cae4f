"""Order entry, wholesale and decision-support reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.functions.scalars import syllable_name, units
from tallygrain.operators import aggregates, joins, predicates, topk, wholesale, windows
from tallygrain.operators.ordered import nth_row
from tallygrain.plans.relational import LAST_NAME_SQL, MINUTES_5
from tallygrain.registry import query
from tallygrain.session import written
from tallygrain.shapes import shape, stored_shape


def _load(spark, sf, *names):
    return [shape(spark, sf, n) for n in names]


@query(
    "oe_sales_rep_orders",
    """with r as (select *, rank() over (partition by sales_rep_id order by total_cents desc) as place from oe_orders)
       select sales_rep_id, total_cents::double / 100 as order_total, cast(order_date as varchar) as order_date,
              cust_first_name, cust_last_name
       from r join oe_customers using (customer_id) where place <= 10""",
)
def oe_sales_rep_orders(spark, sf):
    """The ten largest orders of every sales rep with the customer's name."""
    orders, customers = _load(spark, sf, "oe_orders", "oe_customers")
    top = windows.topk_enrich(
        orders.select("sales_rep_id", "total_cents", "order_date", "customer_id"), ["sales_rep_id"], "total_cents", 10,
        customers.select("customer_id", "cust_first_name", "cust_last_name"), "customer_id",
    )
    return top.select(
        "sales_rep_id", units("total_cents").alias("order_total"), F.col("order_date").cast("string").alias("order_date"),
        "cust_first_name", "cust_last_name",
    )


NOW = "2024-01-15 12:00:00"


def warehouse_activity(activity, now: str, buckets: int = 12):
    """Value and number of orders per warehouse in the last five-minute intervals, closed at both ends."""
    spark = activity.sparkSession
    end = F.unix_micros(F.lit(now).cast("timestamp"))
    intervals = spark.range(buckets).select(
        (end - F.col("id") * MINUTES_5).alias("high"), (end - (F.col("id") + 1) * MINUTES_5).alias("low")
    )
    # the same closed range as a plain filter reaches the scan
    span = F.expr(f"timestamp_ntz '{now}' - interval {5 * buckets} minutes")
    recent = activity.filter((F.col("order_date") >= span) & (F.col("order_date") <= F.expr(f"timestamp_ntz '{now}'")))
    at = recent.withColumn("at", F.unix_micros(F.col("order_date").cast("timestamp")))
    paired = joins.range_join(at, "at", intervals, "low", "high", MINUTES_5, most_cells=2)
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    sums = paired.groupBy("warehouse_id", "high", "low").agg(
        units(F.sum("total_cents")).alias("order_value"), F.count(F.lit(1)).alias("orders")
    )
    return sums.select("warehouse_id", stamp("high").alias("date1"), stamp("low").alias("date2"), "order_value", "orders")


@query(
    "oe_warehouse_activity",
    f"""with i as (select timestamp '{NOW}' - k * interval 5 minute as date1, timestamp '{NOW}' - (k + 1) * interval 5 minute as date2
                   from range(12) r(k))
        select warehouse_id, strftime(date1, '%Y-%m-%d %H:%M:%S') as date1, strftime(date2, '%Y-%m-%d %H:%M:%S') as date2,
               sum(total_cents)::double / 100 as order_value, count(*) as orders
        from oe_activity join i on order_date between date2 and date1 group by all""",
)
def oe_warehouse_activity(spark, sf):
    return warehouse_activity(shape(spark, sf, "oe_activity"), NOW)


@query(
    "oe_warehouse_orders",
    """select order_mode, warehouse_id, sum(total_cents)::double / 100 as order_total, count(*) as orders,
              grouping_id(order_mode, warehouse_id) as level
       from oe_orders group by cube(order_mode, warehouse_id)""",
)
def oe_warehouse_orders(spark, sf):
    """Cube of order mode and warehouse."""
    keys = ["order_mode", "warehouse_id"]
    cubed = aggregates.cube_agg(shape(spark, sf, "oe_orders"), keys, "total_cents", "cents", count="orders")
    return cubed.select(*keys, units("cents").alias("order_total"), "orders", "level")


@query(
    "oe_orders_by_county",
    "select county, count(*) as n from oe_orders join oe_addresses on delivery_address_id = address_id group by county",
)
def oe_orders_by_county(spark, sf):
    """Orders counted by the county of their delivery address."""
    orders, addresses = _load(spark, sf, "oe_orders", "oe_addresses")
    per_address = aggregates.count_by(orders, ["delivery_address_id"])
    placed = per_address.join(addresses, per_address["delivery_address_id"] == addresses["address_id"])
    return placed.groupBy("county").agg(F.sum("n").alias("n"))


@query(
    "oe_process_orders_list",
    """with work as (select * from (select *, row_number() over (partition by warehouse_id order by order_date, order_id) as rn
                     from oe_orders where order_status <= 4) where rn < 10)
       select w.warehouse_id, w.order_id, w.order_mode, w.order_status, w.total_cents, c.customer_id, c.cust_last_name,
              c.credit_cents, c.cust_first_name, c.cust_email, w.sales_rep_id, w.order_id % 12 + 1 as promotion_id,
              cast(w.order_date as varchar) as order_date, i.line_no, i.product_id, i.quantity, i.amount_cents,
              i.amount_cents / 100.0::double / i.quantity as unit_price
       from work w join oe_customers c on c.customer_id = w.customer_id left join oe_items i on i.order_id = w.order_id""",
)
def oe_process_orders_list(spark, sf):
    """The oldest nine unprocessed orders of every warehouse with customer and items."""
    orders, customers, items = _load(spark, sf, "oe_orders", "oe_customers", "oe_items")
    open_orders = orders.filter("order_status <= 4").select(
        "warehouse_id", "order_id", "order_mode", "order_status", "total_cents", "customer_id", "order_date", "sales_rep_id",
        (F.col("order_id") % 12 + 1).alias("promotion_id"),
    )
    work = written(topk.browse(open_orders, ["warehouse_id"], ["order_date", "order_id"], 9), "work")
    people = customers.select("customer_id", "cust_first_name", "cust_last_name", "credit_cents", "cust_email")
    price = (F.col("amount_cents") / 100.0 / F.col("quantity")).alias("unit_price")
    lines = items.select("order_id", "line_no", "product_id", "quantity", "amount_cents", price)
    listed = joins.with_details(work.join(people, "customer_id"), lines, ["order_id"], "left")
    return listed.withColumn("order_date", F.col("order_date").cast("string"))


@query(
    "oe_browse_customer",
    """select 'address' as kind, customer_id, address_id as id, county as detail from oe_addresses
       union all
       select 'card', customer_id, card_id, card_type from (
         select *, row_number() over (partition by customer_id order by card_id) as rn from oe_cards) where rn < 5
       union all
       select 'order', customer_id, order_id, order_mode from (
         select *, row_number() over (partition by customer_id order by order_id) as rn from oe_orders) where rn < 5
       union all
       select 'customer', customer_id, customer_id, cust_email from oe_customers""",
)
def oe_browse_customer(spark, sf):
    """Every customer with up to four addresses, cards and orders."""
    customers, addresses, cards, orders = _load(spark, sf, "oe_customers", "oe_addresses", "oe_cards", "oe_orders")

    def rows(kind, df, ident, detail):
        few = df.select("customer_id", F.col(ident).alias("id"), F.col(detail).alias("detail"))
        if kind != "customer":
            few = topk.browse(few, ["customer_id"], ["id"], 4)
        return few.withColumn("kind", F.lit(kind))

    return (
        rows("customer", customers.withColumn("_id", F.col("customer_id")), "_id", "cust_email")
        .unionByName(rows("address", addresses, "address_id", "county"))
        .unionByName(rows("card", cards, "card_id", "card_type"))
        .unionByName(rows("order", orders, "order_id", "order_mode"))
    )


@query(
    "oe_browse_products",
    """with stocked as (select * from oe_products join oe_inventories using (product_id))
       select 'product' as browse, product_id, warehouse_id, quantity_on_hand from (
         select *, row_number() over (partition by product_id order by warehouse_id) as rn from stocked) where rn < 15
       union all
       select 'category', product_id, warehouse_id, quantity_on_hand from (
         select *, row_number() over (partition by category_id, warehouse_id order by product_id) as rn from stocked) where rn < 4""",
)
def oe_browse_products(spark, sf):
    """Products with stock: up to 14 warehouses per product, up to 3 products per category and warehouse."""
    products, inventory = shape(spark, sf, "oe_products"), stored_shape(spark, sf, "oe_inventories")
    # warehouses are ranked before the products come in; that a product is listed does not change their order
    by_id = joins.semi(topk.browse(inventory, ["product_id"], ["warehouse_id"], 14), products, ["product_id"])
    stocked = products.select("product_id", "category_id").join(inventory, "product_id")
    by_category = topk.browse(stocked, ["category_id", "warehouse_id"], ["product_id"], 3)
    out = ["product_id", "warehouse_id", "quantity_on_hand"]
    return by_id.select(F.lit("product").alias("browse"), *out).unionByName(
        by_category.select(F.lit("category").alias("browse"), *out)
    )


# --- wholesale ------------------------------------------------------------------------
@query(
    "ws_order_status",
    f"""with named as (select *, {LAST_NAME_SQL} as c_last from ws_customer),
             r as (select *, row_number() over (partition by c_w_id, c_d_id, c_last order by c_first, c_id) as rn,
                          count(*) over (partition by c_w_id, c_d_id, c_last) as n from named),
             mid as (select * from r where rn = (n - 1) // 2 + 1),
             last as (select o_c_id, max(o_id) as o_id from ws_orders group by 1)
        select m.c_w_id, m.c_d_id, m.c_last, m.c_id, m.c_balance_cents, l.o_id, ol_number, ol_i_id, ol_supply_w_id, ol_quantity,
               ol_cents, cast(ol_delivery_d as varchar) as ol_delivery_d
        from mid m join last l on l.o_c_id = m.c_id join ws_order_line on ol_o_id = l.o_id""",
)
def ws_order_status(spark, sf):
    """Per district and last name: the middle customer, their latest order and its lines."""
    customers, orders, lines = _load(spark, sf, "ws_customer", "ws_orders", "ws_order_line")
    named = customers.select("c_w_id", "c_d_id", "c_id", "c_first", "c_balance_cents", syllable_name("c_last_number").alias("c_last"))
    middle = nth_row(
        named, ["c_w_id", "c_d_id", "c_last"], ["c_first", "c_id"], lambda n: F.floor((n - 1) / 2) + 1,
        None,
    )
    detail = lines.select("ol_o_id", "ol_number", "ol_i_id", "ol_supply_w_id", "ol_quantity", "ol_cents",
                          F.col("ol_delivery_d").cast("string").alias("ol_delivery_d"))
    return wholesale.order_status(middle, orders, detail).drop("ol_o_id", "c_first", "o_carrier_id", "o_entry_d")


@query(
    "ws_stock_level",
    """with recent as (select distinct ol_w_id, ol_d_id, ol_i_id from ws_order_line
                       join ws_district on d_w_id = ol_w_id and d_id = ol_d_id
                       where ol_o_id >= greatest(1, d_next_o_id - 2000) and ol_o_id < d_next_o_id)
       select d_w_id as w_id, d_id, count(s_i_id) as low_stock
       from ws_district left join recent on ol_w_id = d_w_id and ol_d_id = d_id
            left join ws_stock on s_w_id = ol_w_id and s_i_id = ol_i_id and s_quantity < 60
       group by all""",
)
def ws_stock_level(spark, sf):
    """Distinct low-stock items in the latest orders of every district."""
    stock, orders, items = _load(spark, sf, "ws_stock", "ws_orders", "oe_items")
    lines = items.select((F.col("order_id") + 1).alias("ol_o_id"), F.col("product_id").alias("ol_i_id"))
    districts = stored_shape(spark, sf, "ws_district")
    return wholesale.stock_level(stock, orders, lines, districts, threshold=60, last=2000)


@query(
    "ds_find_order",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(cast(o_orderdate as date) as varchar) as o_orderdate, o_orderpriority
       from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')""",
)
def ds_find_order(spark, sf):
    """Orders by key, for all keys with a returned line."""
    orders, lines = _load(spark, sf, "orders", "lineitem")
    keys = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    found = predicates.lookup(orders, keys, ["o_orderkey"])
    return found.withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))
