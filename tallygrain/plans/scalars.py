"""One query per family of scalar functions, over a whole table each; SQL functions too."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.functions import scalars
from tallygrain.functions.sql_functions import register_functions, register_offers
from tallygrain.plans.relational import LAST_NAME_SQL
from tallygrain.registry import query
from tallygrain.shapes import shape


@query(
    "string_functions",
    """select c_custkey, lower(c_name) as lower_name, c_mktsegment || ' ' || c_name as full_name, upper(c_mktsegment) as segment,
              replace('[''' || c_mktsegment || ''']', '''', '"') as requoted, trim(substr(c_name, 1, 9)) || '*' as search_term,
              starts_with(c_mktsegment, 'BU') as is_bu, left('| ' || c_custkey || ' |' || repeat(c_name, 30), 500) as note,
              lower(c_mktsegment) || '.' || lower(c_name) || '@mail.test' as email,
              '+1 ' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || ' ' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') as phone
       from customer""",
)
def string_functions(spark, sf):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    note = F.concat(F.format_string("| %d |", "c_custkey"), F.repeat(name, 30))
    return shape(spark, sf, "customer").select(
        "c_custkey",
        F.lower(name).alias("lower_name"),
        F.concat_ws(" ", segment, name).alias("full_name"),
        F.upper(segment).alias("segment"),
        F.replace(F.concat(F.lit("['"), segment, F.lit("']")), F.lit("'"), F.lit('"')).alias("requoted"),
        F.concat(F.trim(F.substring(name, 1, 9)), F.lit("*")).alias("search_term"),
        F.startswith(segment, F.lit("BU")).alias("is_bu"),
        F.substring(note, 1, 500).alias("note"),
        F.format_string("%s.%s@mail.test", F.lower(segment), F.lower(name)).alias("email"),
        F.format_string("+1 %03d %04d", F.col("c_custkey") % 1000, F.col("c_custkey") % 10000).alias("phone"),
    )


def money_check(cents: str) -> str:
    """The text of an amount digit by digit: units half up, a comma before every three digits, padded to 14."""
    units = f"((abs({cents}) + 50) // 100)::varchar"
    sign = f"case when {cents} <= -50 then '-' else '' end"
    text = f"{sign} || ltrim(reverse(regexp_replace(reverse({units}), '(\\d{{3}})', '\\1,', 'g')), ',')"
    return f"repeat(' ', greatest(0, 14 - length({text}))) || {text}"


@query(
    "number_format",
    f"""select order_id, {money_check("total_cents::hugeint")} as total_text,
              {money_check("(-total_cents)::hugeint")} as negative_text,
              {money_check("total_cents::hugeint * 100000")} as large_text, total_cents * 100000 as large_cents
       from oe_orders""",
)
def number_format(spark, sf):
    large = F.col("total_cents") * 100_000
    return shape(spark, sf, "oe_orders").select(
        "order_id",
        scalars.money_text("total_cents").alias("total_text"),
        scalars.money_text(-F.col("total_cents")).alias("negative_text"),
        scalars.money_text(large).alias("large_text"),
        large.alias("large_cents"),
    )


@query(
    "date_functions",
    """select event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute,
              cast(cast(ts as date) + 5 as varchar) as day_plus_5, cast(cast(ts as date) + 3 as varchar) as delivery,
              cast(cast(cast(ts as date) + interval 36 month as date) as varchar) as expiry,
              strftime(make_timestamp((959337930 + event_id * 61) * 1000000), '%Y-%m-%d %H:%M:%S') as flight,
              strftime(make_timestamp((959337930 + event_id * 61 + 604800) * 1000000), '%Y-%m-%d %H:%M:%S') as return_flight,
              strftime(ts, '%Y-%m-%dT%H:%MZ') as iso_minute,
              cast(cast(cast(ts as date) - interval 30 year as date) as varchar) as born
       from events""",
)
def date_functions(spark, sf):
    ts = F.col("ts").cast("timestamp")
    day = F.col("ts").cast("date")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    flight = F.lit(959337930) + F.col("event_id") * 61
    return shape(spark, sf, "events").select(
        "event_id",
        stamp(scalars.minute_of(ts)).alias("minute"),
        F.date_add(day, 5).cast("string").alias("day_plus_5"),
        F.date_add(day, 3).cast("string").alias("delivery"),
        F.add_months(day, 36).cast("string").alias("expiry"),
        stamp(F.timestamp_seconds(flight)).alias("flight"),
        stamp(F.timestamp_seconds(flight + 604800)).alias("return_flight"),
        scalars.iso_minute(ts).alias("iso_minute"),
        F.add_months(day, -12 * 30).cast("string").alias("born"),
    )


@query(
    "calendar_dimension",
    """select cast(time_id as varchar) as time_id, calendar_year, calendar_quarter_number, calendar_month_number,
              calendar_week_number, calendar_quarter_desc, calendar_month_desc from times""",
)
def calendar_dimension(spark, sf):
    days = shape(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("time_id")).distinct()
    return scalars.calendar(days, "time_id").withColumn("time_id", F.col("time_id").cast("string"))


@query(
    "math_functions",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as quantity,
              greatest(5, least(15, cast(l_quantity as bigint))) as clamped,
              greatest(100, least(500000, cast(round(l_extendedprice * 100) as bigint))) as clipped_cents,
              case when cast(l_quantity as bigint) - 7 >= 10 then cast(l_quantity as bigint) - 7
                   else cast(l_quantity as bigint) + 84 end as stock,
              cast(round(l_extendedprice * 100) as bigint) * (100 + cast(round(l_tax * 100) as bigint)) * (100 - cast(round(l_discount * 100) as bigint)) as taxed,
              round(l_quantity / nullif(l_discount, 0), 2) as per_discount
       from lineitem""",
)
def math_functions(spark, sf):
    quantity = F.col("l_quantity").cast("long")
    money = F.round(F.col("l_extendedprice") * 100).cast("long")
    percent = lambda c: F.round(F.col(c) * 100).cast("long")
    return shape(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        quantity.alias("quantity"),
        scalars.clamp(quantity, 5, 15).alias("clamped"),
        scalars.clamp(money, 100, 500000).alias("clipped_cents"),
        scalars.stock_after(quantity, F.lit(7)).alias("stock"),
        (money * (100 + percent("l_tax")) * (100 - percent("l_discount"))).alias("taxed"),
        F.round(F.col("l_quantity") / F.nullif(F.col("l_discount"), F.lit(0.0)), 2).alias("per_discount"),
    )


@query(
    "null_functions",
    """select o_id, coalesce(o_carrier_id, 0) as carrier, coalesce(cast(o_carrier_id as varchar), 'none') as carrier_text,
              o_carrier_id is null as was_null from ws_orders""",
)
def null_functions(spark, sf):
    carrier = F.col("o_carrier_id")
    return shape(spark, sf, "ws_orders").select(
        "o_id",
        F.nvl(carrier, F.lit(0)).alias("carrier"),
        F.coalesce(carrier.cast("string"), F.lit("none")).alias("carrier_text"),
        carrier.isNull().alias("was_null"),
    )


@query(
    "hash_bucket",
    """select customer_id, (cast('0x' || substr(md5(cust_email), 1, 8) as bigint)::bigint % 25)::int as bucket from oe_customers""",
)
def hash_bucket(spark, sf):
    return shape(spark, sf, "oe_customers").select(
        "customer_id", scalars.hash_bucket("cust_email", 25).alias("bucket")
    )


@query("syllable_name", f"select c_id, {LAST_NAME_SQL} as c_last from ws_customer")
def syllable_name(spark, sf):
    return shape(spark, sf, "ws_customer").select("c_id", scalars.syllable_name("c_last_number").alias("c_last"))


@query(
    "array_functions",
    """select movie_id, len(string_split(title, ' '))::int as words, lang || '|' || source || '|new' as tags,
              string_split(title, ' ')[1] as first_word, list_contains(string_split(title, ' '), 'the') as has_the
       from movies""",
)
def array_functions(spark, sf):
    words = F.split("title", " ")
    return shape(spark, sf, "movies").select(
        "movie_id",
        F.size(words).alias("words"),
        F.array_join(F.array_append(F.array("lang", "source"), F.lit("new")), "|").alias("tags"),
        F.element_at(words, 1).alias("first_word"),
        F.array_contains(words, "the").alias("has_the"),
    )


# --- SQL functions -----------------------------------------------------------------------
def _counter_rows(spark, sf):
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in ("order_status", "warehouse_id", "sales_rep_id")], F.lit("0,1,0,25"))
    return shape(spark, sf, "oe_orders").select("order_id", text.alias("info"))


@query("scalar_udf", "select order_id, order_status + warehouse_id + sales_rep_id + 1 as dml from oe_orders")
def scalar_udf(spark, sf):
    register_functions(spark)
    return _counter_rows(spark, sf).selectExpr("order_id", "dml_total(info) as dml")


@query(
    "array_udf",
    """select order_id, order_status || ',' || warehouse_id || ',' || sales_rep_id || ',0,1,0,25' as parsed, 7 as n from oe_orders""",
)
def array_udf(spark, sf):
    register_functions(spark)
    return _counter_rows(spark, sf).selectExpr("order_id", "counters(info) as c").selectExpr(
        "order_id", "array_join(transform(c, x -> cast(x as string)), ',') as parsed", "size(c) as n"
    )


@query(
    "table_udf",
    """select c.customer_id, o.order_id as offer_no, o.order_mode as offer from oe_customers c
       join oe_orders o using (customer_id) where c.credit_cents < 0""",
)
def table_udf(spark, sf):
    offers = shape(spark, sf, "oe_orders").select(
        "customer_id", F.col("order_id").alias("offer_no"), F.col("order_mode").alias("offer")
    )
    register_offers(spark, offers)
    customers = shape(spark, sf, "oe_customers").filter("credit_cents < 0").select("customer_id")
    return spark.sql(
        "select c.customer_id, o.offer_no, o.offer from {customers} c, lateral offers_for(c.customer_id) o",
        customers=customers,
    )
