"""The driver's tables in the shapes of the business schemas.

Each shape is one SQL text that Spark and DuckDB both accept, so a query and
its check start from the same rows. ``{name}`` marks an input table or another
shape. Money is carried as whole cents (bigint): sums are exact, order-free
and stay in code-generated long arithmetic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallygrain.session import written
from tallygrain.sources.schemas import read_table

# --- star schema -----------------------------------------------------------
SHAPES: dict[str, str] = {
    # a sale is a line; its order names the customer and the channel
    "sale_lines": """
        select l_orderkey as order_id, l_partkey as prod_id, cast(l_shipdate as date) as time_id,
               cast(l_quantity as bigint) as quantity_sold,
               cast(round(l_extendedprice * 100) as bigint) as amount_cents
        from {lineitem}""",
    "sale_orders": """
        select o_orderkey as order_id, o_custkey as cust_id, cast(substr(o_orderpriority, 1, 1) as int) as channel_id,
               o_orderpriority as channel_desc
        from {orders}""",
    "sales": """
        select prod_id, cust_id, time_id, channel_id, quantity_sold, amount_cents
        from {sale_lines} join {sale_orders} using (order_id)""",
    "times": """
        select time_id, cast(year(time_id) as int) as calendar_year,
               cast(quarter(time_id) as int) as calendar_quarter_number, cast(month(time_id) as int) as calendar_month_number,
               cast(weekofyear(time_id) as int) as calendar_week_number,
               cast(year(time_id) as varchar(4)) || '-Q' || cast(quarter(time_id) as varchar(1)) as calendar_quarter_desc,
               cast(year(time_id) as varchar(4)) || '-' || lpad(cast(month(time_id) as varchar(2)), 2, '0') as calendar_month_desc
        from (select distinct cast(l_shipdate as date) as time_id from {lineitem}) as days""",
    "products": """
        select p_partkey as prod_id, p_name as prod_name, p_size as category_id,
               cast(round(p_retailprice * 100) as bigint) as list_cents from {part}""",
    "customers": """
        select c_custkey as cust_id, c_mktsegment as cust_first_name, c_name as cust_last_name,
               c_nationkey as country_id from {customer}""",
    "countries": """
        select n_nationkey as country_id, n_name as country_name, n_name as country_iso_code from {nation}""",
    "channels": """
        select distinct cast(substr(o_orderpriority, 1, 1) as int) as channel_id,
               o_orderpriority as channel_desc from {orders}""",
    # --- order entry -------------------------------------------------------
    "oe_orders": """
        select o_orderkey as order_id, o_custkey as customer_id,
               cast(round(o_totalprice * 100) as bigint) as total_cents,
               cast(o_orderdate as date) as order_date, o_orderpriority as order_mode,
               case o_orderstatus when 'F' then 10 when 'O' then 2 else 4 end as order_status,
               o_custkey % 10 + 1 as warehouse_id, 145 + o_custkey % 26 as sales_rep_id,
               o_custkey as delivery_address_id
        from {orders}""",
    "oe_items": """
        select l_orderkey as order_id, l_linenumber as line_no, l_partkey as product_id, l_suppkey as supplier_id,
               cast(l_quantity as bigint) as quantity,
               cast(round(l_extendedprice * 100) as bigint) as amount_cents,
               cast(l_shipdate as date) as ship_date, l_returnflag as return_flag, l_linestatus as line_status
        from {lineitem}""",
    # (order, line number) repeats in the source; equal (order, line, product) rows are one line here
    "oe_lines": """
        select order_id, product_id * 10 + line_no as line_item_id, product_id,
               sum(quantity) as quantity, sum(amount_cents) as amount_cents
        from {oe_items} group by order_id, product_id, line_no""",
    "oe_customers": """
        select c_custkey as customer_id, c_mktsegment as cust_first_name, c_name as cust_last_name,
               cast(round(c_acctbal * 100) as bigint) as credit_cents, n_name as country_code,
               lower(c_mktsegment) || '.' || cast(c_custkey as varchar(20)) || '@mail.test' as cust_email
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "oe_addresses": """
        select c_custkey as address_id, c_custkey as customer_id, r_name as county, n_name as country
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "oe_cards": """
        select o_orderkey as card_id, o_custkey as customer_id, o_orderpriority as card_type,
               cast(o_orderdate as date) as issued from {orders}""",
    "oe_products": """
        select p_partkey as product_id, p_name as product_name, p_size as category_id,
               cast(round(p_retailprice * 100) as bigint) as list_cents from {part}""",
    "oe_inventories": """
        select l_partkey as product_id, l_suppkey % 10 + 1 as warehouse_id,
               cast(sum(l_quantity) as bigint) as quantity_on_hand
        from {lineitem} group by l_partkey, l_suppkey % 10 + 1""",
    "oe_activity": """
        select user_id % 10 + 1 as warehouse_id, cast(round(value * 100) as bigint) as total_cents, ts as order_date
        from {events}""",
    # --- wholesale ---------------------------------------------------------
    "ws_customer": """
        select c_custkey % 10 + 1 as c_w_id, cast(floor(c_custkey / 10) as bigint) % 10 + 1 as c_d_id,
               c_custkey as c_id, c_name as c_first, c_custkey % 1000 as c_last_number,
               cast(round(c_acctbal * 100) as bigint) as c_balance_cents,
               case when c_acctbal < 0 then 'BC' else 'GC' end as c_credit,
               c_mktsegment as c_data, c_nationkey % 10 as c_discount_pct
        from {customer}""",
    "ws_orders": """
        select o_custkey % 10 + 1 as o_w_id, cast(floor(o_custkey / 10) as bigint) % 10 + 1 as o_d_id,
               o_orderkey + 1 as o_id, o_custkey as o_c_id, cast(o_orderdate as date) as o_entry_d,
               case when o_orderstatus = 'O' then null else cast(substr(o_orderpriority, 1, 1) as int) end as o_carrier_id,
               o_orderstatus as o_status
        from {orders}""",
    "ws_order_line": """
        select o_w_id as ol_w_id, o_d_id as ol_d_id, o_id as ol_o_id, o_c_id as ol_c_id, l_linenumber as ol_number,
               l_partkey as ol_i_id, l_suppkey % 10 + 1 as ol_supply_w_id, cast(l_quantity as bigint) as ol_quantity,
               cast(round(l_extendedprice * 100) as bigint) as ol_cents, cast(l_shipdate as date) as ol_delivery_d,
               o_status as ol_status
        from {lineitem} join {ws_orders} on l_orderkey + 1 = o_id""",
    "ws_stock": """
        select warehouse_id as s_w_id, product_id as s_i_id, quantity_on_hand as s_quantity from {oe_inventories}""",
    "ws_district": """
        select o_w_id as d_w_id, o_d_id as d_id, max(o_id) + 1 as d_next_o_id, o_w_id * 50 as w_tax_bp, o_d_id * 25 as d_tax_bp
        from {ws_orders} group by o_w_id, o_d_id""",
    # parts of size 50 are not in the wholesale catalogue: an order naming one is invalid
    "ws_item": """
        select p_partkey as i_id, cast(round(p_retailprice * 100) as bigint) as i_price_cents from {part} where p_size < 50""",
    # --- articles, movies --------------------------------------------------
    "art_comments": """
        select conv_id as article_id, turn as idx, role as name, text as comment from {conversations}""",
    "art_articles": """
        select article_id, count(*) as n_comments from {art_comments} group by article_id""",
    "art_categories": """
        select article_id, lang as name from {art_articles} join {documents} on article_id = doc_id
        union all
        select article_id, source as name from {art_articles} join {documents} on article_id = doc_id""",
    "art_people": """
        select distinct ascii(substr(name, 1, 1)) as id, name from {art_comments}""",
    "art_people_articles": """
        select distinct ascii(substr(name, 1, 1)) as people_id, article_id from {art_comments}""",
    "movies": """
        select doc_id as movie_id, text as title, 1990 + doc_id % 35 as year, n_chars,
               '[''' || lang || ''',''' || source || ''']' as genres, lang, source
        from {documents}""",
    # --- events, runs ------------------------------------------------------
    "devices": """
        select user_id as cust_id, cast(substr(props, 7, length(props) - 7) as bigint) as device_id,
               min(ts) as initial_access, max(ts) as last_access, count(*) as access_count
        from {events} group by user_id, cast(substr(props, 7, length(props) - 7) as bigint)""",
    "run_tx": """
        select cast(ts as date) as run_day, event_type as tx, ts, cast(round(value * 100) as bigint) as cents,
               case when event_type = 'error' then 1 else 0 end as failed
        from {events}""",
}


def needed_shapes(text: str) -> list[str]:
    """The shapes a text names as ``{name}``, directly or through others, in dependency order."""
    order: list[str] = []
    for name in dict.fromkeys(re.findall(r"\{(\w+)\}", text)):
        if name in SHAPES:
            order += [n for n in [*needed_shapes(SHAPES[name]), name] if n not in order]
    return order


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or one of the given tables, as a DataFrame."""
    if name not in SHAPES:
        return read_table(spark, sf_dir, name)
    needed = needed_shapes(f"{{{name}}}")
    tables = {t for n in needed for t in re.findall(r"\{(\w+)\}", SHAPES[n]) if t not in SHAPES}
    # shapes become common table expressions of one statement; tables stay parameters
    plain = re.compile(r"\{(" + "|".join(SHAPES) + r")\}")
    views = ",\n".join(f"{n} as ({plain.sub(r'\1', SHAPES[n])})" for n in needed)
    return spark.sql(f"with {views}\nselect * from {name}", **{t: read_table(spark, sf_dir, t) for t in tables})


def stored_shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shape that is a short table of its own in its schema (channels, days, districts).

    Here it is summed up from facts; written out, its true size is known and a
    fact need not be shuffled to meet it.
    """
    return written(shape(spark, sf_dir, name), name)
