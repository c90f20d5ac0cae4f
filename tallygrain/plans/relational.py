"""One query per relational operator: filters, joins, aggregates, windows, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.functions.scalars import quarter_desc, units
from tallygrain.operators import aggregates, joins, postings, predicates, topk, windows
from tallygrain.operators.ordered import nth_row
from tallygrain.registry import query
from tallygrain.shapes import shape, stored_shape


# --- filters ------------------------------------------------------------------
@query(
    "key_lookup",
    """select order_id, customer_id, order_status, total_cents from oe_orders
       where customer_id in (select customer_id from oe_customers where credit_cents < 0)""",
)
def key_lookup(spark, sf):
    keys = shape(spark, sf, "oe_customers").filter("credit_cents < 0")
    orders = shape(spark, sf, "oe_orders").select("order_id", "customer_id", "order_status", "total_cents")
    return predicates.lookup(orders, keys, ["customer_id"])


@query("in_list_filter", "select order_id, order_mode from oe_orders where order_mode in ('1-URGENT', '5-LOW')")
def in_list_filter(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("order_id", "order_mode")
    return predicates.where_in(orders, "order_mode", ["1-URGENT", "5-LOW"])


@query(
    "between_filter",
    """select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as quantity from lineitem
       where l_quantity between 10 and 20""",
)
def between_filter(spark, sf):
    lines = predicates.where_between(shape(spark, sf, "lineitem"), "l_quantity", 10.0, 20.0)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))


@query(
    "ci_name_filter",
    """select customer_id, cust_first_name, country_code from oe_customers
       where lower(country_code) = lower('nation_7') and lower(cust_first_name) = lower('Building')
       order by customer_id limit 4""",
)
def ci_name_filter(spark, sf):
    customers = shape(spark, sf, "oe_customers").select("customer_id", "cust_first_name", "country_code")
    wanted = {"country_code": "nation_7", "cust_first_name": "Building"}
    return predicates.find_by_name(customers, wanted, ["customer_id"], 4)


@query(
    "example_filter",
    """select customer_id, cust_first_name, country_code from oe_customers
       where cust_first_name = 'MACHINERY' and country_code = 'NATION_3'""",
)
def example_filter(spark, sf):
    documents = shape(spark, sf, "oe_customers").select(
        "customer_id",
        F.struct(
            F.struct(F.col("cust_first_name").alias("first"), F.col("cust_last_name").alias("last")).alias("name"),
            F.col("country_code").alias("country"),
        ).alias("doc"),
    )
    found = predicates.filter_by_example(documents, {"doc": {"name": {"first": "MACHINERY"}, "country": "NATION_3"}})
    return found.select(
        "customer_id", F.col("doc.name.first").alias("cust_first_name"), F.col("doc.country").alias("country_code")
    )


URGENT = "select distinct customer_id from oe_orders where order_mode = '1-URGENT' and order_date >= date '2000-01-01'"


def _urgent(spark, sf):
    return shape(spark, sf, "oe_orders").filter("order_mode = '1-URGENT' and order_date >= date '2000-01-01'")


@query(
    "exists_check",
    f"""select customer_id, cust_email, customer_id in ({URGENT}) as found from oe_customers""",
)
def exists_check(spark, sf):
    candidates = shape(spark, sf, "oe_customers").select("customer_id", "cust_email")
    return predicates.exists_flag(candidates, _urgent(spark, sf), ["customer_id"])


@query(
    "prefix_text_search",
    r"""select movie_id, year, n_chars from movies where regexp_matches(lower(title), '(^|[^\p{L}\p{N}])aile')
        order by year desc nulls last, movie_id limit 16""",
)
def prefix_text_search(spark, sf):
    movies = shape(spark, sf, "movies").select("movie_id", "year", "n_chars")
    order = [F.col("year").desc_nulls_last(), "movie_id"]
    found = title_index(spark, sf).search({"aile*": (predicates.indexed_words("aile*"), "&")})
    return joins.semi(movies, found.select(F.col("id").alias("movie_id")), ["movie_id"]).orderBy(*order).limit(16)


def title_index(spark, sf) -> postings.Index:
    """Words of the movies' titles."""

    def make():
        return postings.build(shape(spark, sf, "movies"), "movie_id", postings.letter_tokens("title"), "titles")

    return postings.index_of(spark, sf, "titles", make)


def genre_index(spark, sf) -> postings.Index:
    def make():
        return postings.build(shape(spark, sf, "movies"), "movie_id", postings.quoted_tokens("genres"), "genres")

    return postings.index_of(spark, sf, "genres", make)


@query(
    "json_text_search",
    """select movie_id, (lang = 'en' and source = 'src1') as both_terms, (lang = 'de' or source = 'src2') as any_term
       from movies""",
)
def json_text_search(spark, sf):
    searches = {"both_terms": (["en", "src1"], "&"), "any_term": (["de", "src2"], "|")}
    found = genre_index(spark, sf).search(searches).groupBy(F.col("id").alias("movie_id"))
    flags = found.agg(*[F.max(F.col("search") == name).alias(name) for name in searches])
    movies = shape(spark, sf, "movies").select("movie_id").join(flags, "movie_id", "left")
    return movies.withColumns({name: F.coalesce(name, F.lit(False)) for name in searches})


@query(
    "computed_projection",
    """select order_id, line_no, product_id, cast(product_id as varchar) || ' ' || cast(line_no as varchar) as label,
              (quantity * list_cents)::double / 100 as list_value
       from oe_items join oe_products using (product_id)""",
)
def computed_projection(spark, sf):
    items = shape(spark, sf, "oe_items").select("order_id", "line_no", "product_id", "quantity")
    prices = shape(spark, sf, "oe_products").select("product_id", "list_cents")
    return items.join(prices, "product_id").select(
        "order_id",
        "line_no",
        "product_id",
        F.concat_ws(" ", F.col("product_id").cast("string"), F.col("line_no").cast("string")).alias("label"),
        units(F.col("quantity") * F.col("list_cents")).alias("list_value"),
    )


@query("distinct_values", "select distinct calendar_month_desc from times order by 1")
def distinct_values(spark, sf):
    return predicates.distinct_values(shape(spark, sf, "times"), "calendar_month_desc")


# --- joins --------------------------------------------------------------------
@query(
    "star_join",
    """select prod_name, country_name, channel_desc, calendar_quarter_desc, quantity_sold, amount_cents
       from sales join products using (prod_id) join times using (time_id) join channels using (channel_id)
            join customers using (cust_id) join countries using (country_id)""",
)
def star_join(spark, sf):
    sales, products, customers, countries = (shape(spark, sf, n) for n in ("sales", "products", "customers", "countries"))
    times, channels = stored_shape(spark, sf, "times"), stored_shape(spark, sf, "channels")
    dims = [(products, "prod_id"), (times, "time_id"), (channels, "channel_id"), (customers, "cust_id"),
            (countries, "country_id")]
    return joins.star_join(sales, dims).select(
        "prod_name", "country_name", "channel_desc", "calendar_quarter_desc", "quantity_sold", "amount_cents"
    )


@query(
    "product_inventory_join",
    """select product_id, product_name, list_cents, warehouse_id, quantity_on_hand from (
         select *, row_number() over (partition by product_id order by warehouse_id) as rn
         from oe_products join oe_inventories using (product_id)) where rn <= 14""",
)
def product_inventory_join(spark, sf):
    stocked = shape(spark, sf, "oe_products").join(shape(spark, sf, "oe_inventories"), "product_id")
    return topk.browse(stocked, ["product_id"], ["warehouse_id"], 14).drop("category_id")


@query(
    "category_stock_join",
    """select category_id, warehouse_id, product_id, product_name, quantity_on_hand from (
         select *, row_number() over (partition by category_id, warehouse_id order by product_id) as rn
         from oe_products join oe_inventories using (product_id)) where rn < 4""",
)
def category_stock_join(spark, sf):
    stocked = shape(spark, sf, "oe_products").join(shape(spark, sf, "oe_inventories"), "product_id")
    return topk.browse(stocked, ["category_id", "warehouse_id"], ["product_id"], 3).drop("list_cents")


@query(
    "left_outer_join",
    """select o.order_id, c.cust_last_name, i.line_no, i.product_id, i.quantity
       from oe_orders o join oe_customers c on c.customer_id = o.customer_id
            left join oe_items i on i.order_id = o.order_id""",
)
def left_outer_join(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("order_id", "customer_id")
    customers = shape(spark, sf, "oe_customers").select("customer_id", "cust_last_name")
    items = shape(spark, sf, "oe_items").select("order_id", "line_no", "product_id", "quantity")
    return joins.left_join(orders.join(customers, "customer_id").drop("customer_id"), items, ["order_id"])


@query(
    "partitioned_outer_join",
    """with v as (select prod_name, calendar_month_desc, sum(amount_cents) as cents
                  from sales join products using (prod_id) join times using (time_id) group by all)
       select n.prod_name, t.calendar_month_desc, coalesce(v.cents, 0)::double / 100 as amount_sold
       from (select distinct prod_name from v) n cross join (select distinct calendar_month_desc from times) t
            left join v on v.prod_name = n.prod_name and v.calendar_month_desc = t.calendar_month_desc""",
)
def partitioned_outer_join(spark, sf):
    lines, products = shape(spark, sf, "sale_lines"), shape(spark, sf, "products")
    month = F.trunc("time_id", "MM").alias("month")
    named = lines.select("prod_id", month, "amount_cents").join(products.select("prod_id", "prod_name"), "prod_id")
    monthly = aggregates.group_sum(named, ["prod_name", "month"], "amount_cents", "cents")
    dense = joins.densify(monthly, ["prod_name"], lines.select(month).distinct(), {"cents": 0})
    return dense.select(
        "prod_name", F.date_format("month", "yyyy-MM").alias("calendar_month_desc"), units("cents").alias("amount_sold")
    )


MINUTES_5 = 300_000_000  # microseconds


def _intervals(points, at: str):
    """Five-minute intervals, closed at both ends, from the day of the first point to the last point."""
    first, last = points.agg(F.min(at), F.max(at)).first()
    start = 0 if first is None else first - first % 86_400_000_000
    # as a range: no row holds all of them, and the planner knows how many they are
    numbered = points.sparkSession.range(0 if first is None else (last - start) // MINUTES_5 + 1)
    low = F.col("id") * MINUTES_5 + start
    return numbered.select(F.col("id").alias("interval_no"), low.alias("low"), (low + MINUTES_5).alias("high"))


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


INTERVAL_SQL = """
  bounds as (select epoch_us(date_trunc('day', min(ts))) as first, epoch_us(max(ts)) as last from events),
  intervals as (select i as interval_no, first + i * 300000000 as low, first + (i + 1) * 300000000 as high
                from (select first, unnest(range((last - first) // 300000000 + 1)) as i from bounds))"""


@query(
    "interval_range_join",
    f"""with {INTERVAL_SQL}
        select event_id, interval_no from events join intervals on epoch_us(ts) between low and high""",
)
def interval_range_join(spark, sf):
    events = shape(spark, sf, "events").select("event_id", _micros("ts").alias("at"))
    paired = joins.range_join(events, "at", _intervals(events, "at"), "low", "high", MINUTES_5, most_cells=2)
    return paired.select("event_id", "interval_no")


@query(
    "semi_join",
    """select s_w_id, s_i_id, s_quantity from ws_stock
       where s_i_id in (select product_id from oe_items where ship_date >= date '2001-06-01')""",
)
def semi_join(spark, sf):
    recent = shape(spark, sf, "oe_items").filter("ship_date >= date '2001-06-01'")
    return joins.semi(shape(spark, sf, "ws_stock"), recent.select(F.col("product_id").alias("s_i_id")), ["s_i_id"])


@query("anti_join", f"select customer_id, cust_email from oe_customers where customer_id not in ({URGENT})")
def anti_join(spark, sf):
    candidates = shape(spark, sf, "oe_customers").select("customer_id", "cust_email")
    return joins.new_only(candidates, _urgent(spark, sf), ["customer_id"])


@query(
    "correlated_scalar",
    """select c.name, count(distinct c.article_id) as total_articles,
              cast(sum((select count(*) from art_comments m where m.article_id = c.article_id)) as bigint) as total_comments
       from art_categories c group by c.name""",
)
def correlated_scalar(spark, sf):
    counted = joins.with_related(
        shape(spark, sf, "art_categories"),
        shape(spark, sf, "art_comments"),
        ["article_id"],
        {"n": F.count(F.lit(1))},
    )
    # per article first: both measures then add up without a distinct count
    per_article = counted.groupBy("name", "article_id").agg(F.sum("n").alias("n"))
    return per_article.groupBy("name").agg(
        F.count(F.lit(1)).alias("total_articles"), F.sum("n").alias("total_comments")
    )


@query(
    "hash_range_join",
    """select customer_id, key_hash, cast(least(key_hash // 536870912, 7) as bigint) as chunk_id
       from (select customer_id, cast('0x' || substr(md5(cast(customer_id as varchar)), 1, 8) as bigint) as key_hash
             from oe_customers)""",
)
def hash_range_join(spark, sf):
    customers = shape(spark, sf, "oe_customers").select("customer_id")
    return joins.assign_chunk(customers, "customer_id", joins.hash_chunks(spark, 8))


OWNER_SQL = """
  size as (select (max(customer_id) + 25) // 25 as w from oe_customers),
  ranges as (select n_name as code, n_nationkey * w as low, n_nationkey * w + 2 * w - 1 as high from nation, size)"""


@query(
    "owner_range_lookup",
    f"""with {OWNER_SQL}
        select customer_id, arg_max(code, low) as code from oe_customers left join ranges
          on customer_id between low and high group by customer_id""",
)
def owner_range_lookup(spark, sf):
    customers = shape(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    width = customers.agg(F.expr("(max(customer_id) + 25) div 25")).scalar()
    ranges = shape(spark, sf, "nation").select(
        F.col("n_name").alias("code"),
        (F.col("n_nationkey") * width).alias("low"),
        (F.col("n_nationkey") * width + width * 2 - 1).alias("high"),
    )
    return joins.range_owner(customers, "customer_id", ranges, "low", "high", "code", width)


REP_RANK_SQL = """
  ranked as (select order_id, sales_rep_id, total_cents, order_date, customer_id,
                    rank() over (partition by sales_rep_id order by total_cents desc) as rank from oe_orders)"""


@query(
    "rank_then_join",
    f"""with {REP_RANK_SQL}
        select order_id, sales_rep_id, rank::int as rank, cust_last_name from ranked join oe_customers using (customer_id)
        where rank <= 10""",
)
def rank_then_join(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("order_id", "sales_rep_id", "total_cents", "customer_id")
    customers = shape(spark, sf, "oe_customers").select("customer_id", "cust_last_name")
    return windows.topk_enrich(orders, ["sales_rep_id"], "total_cents", 10, customers, "customer_id").select(
        "order_id", "sales_rep_id", "rank", "cust_last_name"
    )


@query(
    "bridge_join",
    """select p.name, count(*) as n from art_people p join art_people_articles a on a.people_id = p.id group by p.name""",
)
def bridge_join(spark, sf):
    people, bridge = shape(spark, sf, "art_people"), shape(spark, sf, "art_people_articles")
    # counted per person id first; the name join then meets one row per person
    counted = aggregates.count_by(bridge, ["people_id"])
    return people.join(counted, people["id"] == counted["people_id"]).groupBy("name").agg(F.sum("n").alias("n"))


@query(
    "limit_then_join",
    """with work as (select order_id, customer_id, order_status from oe_orders where order_status <= 4
                     order by order_date, order_id limit 9)
       select w.order_id, w.order_status, c.cust_last_name, i.line_no, i.product_id, i.quantity
       from work w join oe_customers c using (customer_id) left join oe_items i on i.order_id = w.order_id""",
)
def limit_then_join(spark, sf):
    open_orders = shape(spark, sf, "oe_orders").filter("order_status <= 4").select(
        "order_id", "customer_id", "order_status", "order_date"
    )
    customers = shape(spark, sf, "oe_customers").select("customer_id", "cust_last_name")
    items = shape(spark, sf, "oe_items").select("order_id", "line_no", "product_id", "quantity")
    listed = topk.worklist(
        open_orders, ["order_date", "order_id"], 9, (customers, "customer_id", "inner"), (items, "order_id", "left")
    )
    return listed.drop("customer_id", "order_date")


@query(
    "composite_key_join",
    """select c.country_code, c.customer_id, c.cust_last_name, a.county
       from oe_customers c join oe_addresses a on a.country = c.country_code and a.customer_id = c.customer_id""",
)
def composite_key_join(spark, sf):
    customers = shape(spark, sf, "oe_customers").select("country_code", "customer_id", "cust_last_name")
    addresses = shape(spark, sf, "oe_addresses").select(F.col("country").alias("country_code"), "customer_id", "county")
    return customers.join(addresses, ["country_code", "customer_id"])


# --- aggregates -----------------------------------------------------------------
@query(
    "group_sum",
    "select warehouse_id, order_mode, sum(total_cents)::double / 100 as order_total from oe_orders group by all",
)
def group_sum(spark, sf):
    sums = aggregates.group_sum(shape(spark, sf, "oe_orders"), ["warehouse_id", "order_mode"], "total_cents", "cents")
    return sums.select("warehouse_id", "order_mode", units("cents").alias("order_total"))


@query(
    "weighted_sum",
    """select category_id, sum(quantity * list_cents)::double / 100 as list_value
       from oe_items join oe_products using (product_id) group by category_id""",
)
def weighted_sum(spark, sf):
    quantities = aggregates.group_sum(shape(spark, sf, "oe_items"), ["product_id"], "quantity", "quantity")
    priced = quantities.join(shape(spark, sf, "oe_products"), "product_id")
    sums = aggregates.group_sum(priced, ["category_id"], F.col("quantity") * F.col("list_cents"), "cents")
    return sums.select("category_id", units("cents").alias("list_value"))


@query(
    "rollup_agg",
    """select order_mode, warehouse_id, sum(total_cents)::double / 100 as order_total,
              grouping_id(order_mode, warehouse_id) as level
       from oe_orders group by rollup(order_mode, warehouse_id)""",
)
def rollup_agg(spark, sf):
    rolled = aggregates.rollup_sum(shape(spark, sf, "oe_orders"), ["order_mode", "warehouse_id"], "total_cents", "c")
    return rolled.select("order_mode", "warehouse_id", units("c").alias("order_total"), "level")


@query(
    "cube_agg",
    """select order_mode, order_status, warehouse_id, sum(total_cents)::double / 100 as order_total, count(*) as orders,
              grouping_id(order_mode, order_status, warehouse_id) as level
       from oe_orders group by cube(order_mode, order_status, warehouse_id)""",
)
def cube_agg(spark, sf):
    keys = ["order_mode", "order_status", "warehouse_id"]
    cubed = aggregates.cube_agg(shape(spark, sf, "oe_orders"), keys, "total_cents", "cents", count="orders")
    return cubed.select(*keys, units("cents").alias("order_total"), "orders", "level")


@query("count_agg", "select order_status, count(*) as n from oe_orders group by order_status")
def count_agg(spark, sf):
    return aggregates.count_by(shape(spark, sf, "oe_orders"), ["order_status"])


@query(
    "count_distinct",
    "select warehouse_id, count(distinct customer_id) as customers from oe_orders group by warehouse_id",
)
def count_distinct(spark, sf):
    return aggregates.count_distinct_by(shape(spark, sf, "oe_orders"), ["warehouse_id"], "customer_id", "customers")


@query(
    "min_max_by_group",
    "select country_code, min(customer_id) as min_id, max(customer_id) as max_id from oe_customers group by country_code",
)
def min_max_by_group(spark, sf):
    return aggregates.bounds_by(shape(spark, sf, "oe_customers"), ["country_code"], "customer_id")


@query(
    "ordered_collect",
    """with placed as (select *, row_number() over (partition by customer_id order by issued, card_id) - 1 as i from oe_cards),
            chunks as (select customer_id, i // 100 as chunk,
                              to_json(list(struct_pack(card_id := card_id, card_type := card_type) order by i))::varchar as cards
                       from placed group by all)
       select c.customer_id, cast(coalesce(k.chunk, 0) as bigint) as chunk, coalesce(k.cards, '[]') as cards
       from oe_customers c left join chunks k using (customer_id)""",
)
def ordered_collect(spark, sf):
    customers = shape(spark, sf, "oe_customers").select("customer_id")
    cards = aggregates.collect_ordered(
        shape(spark, sf, "oe_cards"), ["customer_id"], ["issued", "card_id"], ["card_id", "card_type"], "cards",
        rows=100,
    )
    return customers.join(cards, "customer_id", "left").select(
        "customer_id",
        F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"),
        F.coalesce(F.to_json("cards"), F.lit("[]")).alias("cards"),
    )


@query(
    "interval_sum_count",
    f"""with {INTERVAL_SQL}
        select warehouse_id, interval_no, sum(total_cents)::double / 100 as order_value, count(*) as orders
        from oe_activity join intervals on epoch_us(order_date) between low and high group by all""",
)
def interval_sum_count(spark, sf):
    activity = shape(spark, sf, "oe_activity").withColumn("at", _micros("order_date"))
    paired = joins.range_join(activity, "at", _intervals(activity, "at"), "low", "high", MINUTES_5, most_cells=2)
    return paired.groupBy("warehouse_id", "interval_no").agg(
        units(F.sum("total_cents")).alias("order_value"), F.count(F.lit(1)).alias("orders")
    )


PERCENTILE_SQL = """
select tx, count(*) as n, round(avg(cents), 4) as mean,
       round(quantile_cont(cents::double, 0.1), 4) as p10, round(quantile_cont(cents::double, 0.5), 4) as p50,
       round(quantile_cont(cents::double, 0.9), 4) as p90
from run_tx group by tx"""


@query("percentile_summary", PERCENTILE_SQL)
def percentile_summary(spark, sf):
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    summary = aggregates.percentile_summary(shape(spark, sf, "run_tx"), ["tx"], "cents", probs)
    return summary.select("tx", "n", *[F.round(c, 4).alias(c) for c in ("mean", *probs)])


@query(
    "counter_totals",
    """select order_mode, sum(order_status)::bigint as selects, count(*) as inserts, sum(warehouse_id)::bigint as updates,
              sum(0)::bigint as deletes, count(*) as commits, sum(case when order_status = 2 then 1 else 0 end)::bigint as rollbacks,
              sum(sales_rep_id)::bigint as sleep
       from oe_orders group by order_mode""",
)
def counter_totals(spark, sf):
    info = F.concat_ws(
        ",", *[F.col("order_status").cast("string"), F.lit("1"), F.col("warehouse_id").cast("string"), F.lit("0"),
               F.lit("1"), F.when(F.col("order_status") == 2, "1").otherwise("0"), F.col("sales_rep_id").cast("string")]
    )
    return aggregates.counter_totals(shape(spark, sf, "oe_orders").withColumn("info", info), ["order_mode"], "info")


# --- windows ----------------------------------------------------------------------
@query(
    "rank_in_partition",
    """with s as (select calendar_quarter_desc, prod_id, sum(amount_cents) as cents
                  from sales join times using (time_id) group by all),
            r as (select *, rank() over (partition by calendar_quarter_desc order by cents desc) as rank from s)
       select calendar_quarter_desc, prod_id, cents::double / 100 as amount_sold, rank::int as rank from r where rank < 16""",
)
def rank_in_partition(spark, sf):
    lines = shape(spark, sf, "sale_lines")
    quarterly = lines.groupBy("prod_id", F.trunc("time_id", "QUARTER").alias("q")).agg(F.sum("amount_cents").alias("cents"))
    return windows.top_ranked(quarterly, ["q"], "cents", 15).select(
        quarter_desc("q").alias("calendar_quarter_desc"), "prod_id", units("cents").alias("amount_sold"), "rank"
    )


@query("rank_global", f"with {REP_RANK_SQL} select sales_rep_id, order_id, rank::int as rank from ranked where rank <= 10")
def rank_global(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("sales_rep_id", "order_id", "total_cents")
    return windows.top_ranked(orders, ["sales_rep_id"], "total_cents", 10).drop("total_cents")


MONTHLY_SQL = """
  m as (select warehouse_id, year(order_date)::int as y, month(order_date)::int as m, sum(total_cents) as cents
        from oe_orders group by all)"""


def _monthly(spark, sf):
    return shape(spark, sf, "oe_orders").groupBy(
        "warehouse_id", F.year("order_date").alias("y"), F.month("order_date").alias("m")
    ).agg(F.sum("total_cents").alias("cents"))


@query(
    "running_sum",
    f"""with {MONTHLY_SQL}
        select warehouse_id, y, m, sum(cents) over (partition by warehouse_id, y order by m)::double / 100 as ytd from m""",
)
def running_sum(spark, sf):
    ytd = windows.running_sum(_monthly(spark, sf), ["warehouse_id", "y"], "m", "cents", "c")
    return ytd.select("warehouse_id", "y", "m", units("c").alias("ytd"))


@query(
    "lag_prior",
    f"""with {MONTHLY_SQL}
        select warehouse_id, y, m, lag(cents) over (partition by warehouse_id, m order by y)::double / 100 as prior from m""",
)
def lag_prior(spark, sf):
    prior = windows.lag_by(_monthly(spark, sf), ["warehouse_id", "m"], "y", "cents", 1, "c")
    return prior.select("warehouse_id", "y", "m", units("c").alias("prior"))


@query(
    "lag_default",
    """with d as (select distinct warehouse_id, order_date from oe_orders)
       select warehouse_id, cast(order_date as varchar) as order_date,
              datediff('day', date '1970-01-01', order_date) as day_no,
              lag(datediff('day', date '1970-01-01', order_date), 1, 0) over (partition by warehouse_id order by order_date) as previous
       from d""",
)
def lag_default(spark, sf):
    # one row per warehouse and calendar day
    days = shape(spark, sf, "oe_orders").select("warehouse_id", "order_date").distinct()
    numbered = days.withColumn("day_no", F.unix_date("order_date").cast("long"))
    lagged = windows.lag_by(numbered, ["warehouse_id"], "day_no", "day_no", 1, "previous", 0)
    return lagged.withColumn("order_date", F.col("order_date").cast("string"))


@query(
    "moving_average",
    """with d as (select warehouse_id, order_date, sum(total_cents)::bigint as cents from oe_orders group by all)
       select warehouse_id, cast(order_date as varchar) as order_date, cents,
              round(avg(cents) over (partition by warehouse_id order by order_date
                    range between interval 2 day preceding and interval 2 day following) / 100, 4) as centered_5_day_avg
       from d""",
)
def moving_average(spark, sf):
    daily = shape(spark, sf, "oe_orders").groupBy("warehouse_id", "order_date").agg(F.sum("total_cents").alias("cents"))
    smoothed = windows.moving_average(daily, "order_date", "cents", 2, "a", part=["warehouse_id"])
    return smoothed.select(
        "warehouse_id", F.col("order_date").cast("string").alias("order_date"), "cents",
        F.round(F.col("a") / 100, 4).alias("centered_5_day_avg"),
    )


# fixed values: the ten syllables of a generated last name
LAST_NAME_SQL = """(['BAR','OUT','ABE','PRI','PRES','ESE','ANTI','CALY','ATN','EING'])[cast(c_last_number // 100 as int) + 1]
 || (['BAR','OUT','ABE','PRI','PRES','ESE','ANTI','CALY','ATN','EING'])[cast(c_last_number // 10 as int) % 10 + 1]
 || (['BAR','OUT','ABE','PRI','PRES','ESE','ANTI','CALY','ATN','EING'])[cast(c_last_number as int) % 10 + 1]"""


@query(
    "middle_row",
    """with r as (select *, row_number() over (partition by cust_first_name, country_code order by cust_last_name, customer_id) as rn,
                         count(*) over (partition by cust_first_name, country_code) as n from oe_customers)
       select cust_first_name, country_code, customer_id, cust_last_name from r where rn = (n - 1) // 2 + 1""",
)
def middle_row(spark, sf):
    customers = shape(spark, sf, "oe_customers").select("cust_first_name", "country_code", "customer_id", "cust_last_name")
    return nth_row(
        customers,
        ["cust_first_name", "country_code"],
        ["cust_last_name", "customer_id"],
        lambda n: F.floor((n - 1) / 2) + 1,
        None,
    )


@query(
    "latest_per_key",
    """select customer_id, order_id, cast(order_date as varchar) as order_date, order_status from (
         select *, row_number() over (partition by customer_id order by order_date desc, order_id desc) as rn from oe_orders)
       where rn = 1""",
)
def latest_per_key(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("customer_id", "order_id", "order_date", "order_status")
    latest = windows.latest_per(orders, ["customer_id"], ["order_date", "order_id"])
    return latest.withColumn("order_date", F.col("order_date").cast("string"))


@query(
    "earliest_per_key",
    "select o_w_id, o_d_id, min(o_id) as o_id from ws_orders where o_status = 'O' group by o_w_id, o_d_id",
)
def earliest_per_key(spark, sf):
    waiting = shape(spark, sf, "ws_orders").filter("o_status = 'O'").select("o_w_id", "o_d_id", "o_id")
    return windows.earliest_per(waiting, ["o_w_id", "o_d_id"], ["o_id"])


@query(
    "last_n_per_key",
    """select o_w_id, o_d_id, o_id from ws_orders join ws_district on d_w_id = o_w_id and d_id = o_d_id
       where o_id >= greatest(1, d_next_o_id - 2000) and o_id < d_next_o_id""",
)
def last_n_per_key(spark, sf):
    orders = shape(spark, sf, "ws_orders").select("o_w_id", "o_d_id", "o_id")
    upper = stored_shape(spark, sf, "ws_district").select(
        F.col("d_w_id").alias("o_w_id"), F.col("d_id").alias("o_d_id"), "d_next_o_id"
    )
    return windows.last_n(orders, ["o_w_id", "o_d_id"], "o_id", upper, "d_next_o_id", 2000).drop("d_next_o_id")


@query(
    "percent_change",
    """with d as (select run_day, count(*) as n from run_tx group by run_day), l as (
         select run_day, n, lag(n) over (order by run_day) as p from d)
       select cast(run_day as varchar) as run_day, n, round((n - p) / nullif(p, 0)::double * 100, 2) as change_pct from l""",
)
def percent_change(spark, sf):
    # one row per day by the time the window runs
    days = aggregates.count_by(shape(spark, sf, "run_tx"), ["run_day"])
    return windows.pct_change(days, "run_day", "n", "change_pct").withColumn("run_day", F.col("run_day").cast("string"))


# --- top-k, sampling, append --------------------------------------------------------
@query("top_n", "select order_id, total_cents from oe_orders order by total_cents desc nulls last, order_id limit 10")
def top_n(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("order_id", "total_cents")
    return topk.top_n(orders, [F.col("total_cents").desc_nulls_last(), "order_id"], 10)


@query(
    "composite_key_top_n",
    """select name, count(distinct article_id) as total_articles, cast(sum(n_comments) as bigint) as total_comments
       from art_categories join art_articles using (article_id) group by name
       order by total_articles desc, total_comments desc, name limit 10""",
)
def composite_key_top_n(spark, sf):
    per_article = shape(spark, sf, "art_categories").join(shape(spark, sf, "art_articles"), "article_id").groupBy(
        "name", "article_id"
    ).agg(F.sum("n_comments").alias("n"))
    totals = per_article.groupBy("name").agg(
        F.count(F.lit(1)).alias("total_articles"), F.sum("n").alias("total_comments")
    )
    return topk.top_n(totals, [F.desc("total_articles"), F.desc("total_comments"), "name"], 10)


@query(
    "multi_sort",
    """select warehouse_id, order_status, sum(total_cents)::double / 100 as order_total from oe_orders
       group by all order by warehouse_id asc nulls first, order_total desc nulls last""",
)
def multi_sort(spark, sf):
    sums = shape(spark, sf, "oe_orders").groupBy("warehouse_id", "order_status").agg(
        units(F.sum("total_cents")).alias("order_total")
    )
    return sums.orderBy(F.col("warehouse_id").asc_nulls_first(), F.col("order_total").desc_nulls_last())


@query(
    "bounded_browse",
    """select customer_id, order_id, total_cents, n::int as n from (
         select *, row_number() over (partition by customer_id order by order_date desc, order_id) as n from oe_orders)
       where n < 5""",
)
def bounded_browse(spark, sf):
    orders = shape(spark, sf, "oe_orders").select("customer_id", "order_id", "total_cents", "order_date")
    return topk.browse(orders, ["customer_id"], [F.desc("order_date"), "order_id"], 4, out="n").drop("order_date")


# the first 32 bits of a key's md5 as a share of the hash space
SHARE_SQL = "cast('0x' || substr(md5(cast(movie_id as varchar) || '|{seed}'), 1, 8) as bigint) / 4294967296.0::double"


@query(
    "bernoulli_sample",
    f"""select movie_id, lang, year from movies
        where {SHARE_SQL.format(seed=11)} < case lang when 'en' then 0.1 when 'de' then 0.2 when 'es' then 0.1 else 0 end""",
)
def bernoulli_sample(spark, sf):
    movies = shape(spark, sf, "movies").select("movie_id", "lang", "year")
    return topk.sample_by(movies, "lang", {"en": 0.1, "de": 0.2, "es": 0.1}, "movie_id", seed=11)


@query(
    "random_n",
    "select customer_id, country_code from oe_customers order by md5(cast(customer_id as varchar) || '|7'), customer_id limit 50",
)
def random_n(spark, sf):
    customers = shape(spark, sf, "oe_customers").select("customer_id", "country_code")
    return topk.random_n(customers, "customer_id", 50, seed=7)


@query(
    "draw_categories",
    """select movie_id, source from movies where source in (
         select source from (select distinct source from movies) order by md5(source || '|3'), source limit 4)""",
)
def draw_categories(spark, sf):
    return topk.draw_categories(shape(spark, sf, "movies").select("movie_id", "source"), "source", 4, seed=3)


@query(
    "append_rows",
    """select c_custkey as id, c_name as name, c_mktsegment as segment from customer
       union all select s_suppkey, s_name, null from supplier""",
)
def append_rows(spark, sf):
    from tallygrain.operators.changes import append

    customers = shape(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    new = shape(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return append(customers, new)
