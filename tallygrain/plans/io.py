"""Sources, sinks, run results and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import runs
from tallygrain.operators.aggregates import collect_ordered
from tallygrain.operators.documents import json_value
from tallygrain.registry import query
from tallygrain.session import work_folder
from tallygrain.shapes import shape
from tallygrain.sources import files, tables
from tallygrain.streaming.events import FILES_PER_TRIGGER, open_stream

ID_BLOCK = 1 << 16
ROWS = 256


# --- tables -----------------------------------------------------------------------------
@query(
    "table_scan",
    """select 'customer' as table_name, c_custkey as id, c_name as label from customer
       union all select 'supplier', s_suppkey, s_name from supplier
       union all select 'part', p_partkey, p_name from part""",
)
def table_scan(spark, sf):
    columns = {"customer": ["c_custkey", "c_name"], "supplier": ["s_suppkey", "s_name"], "part": ["p_partkey", "p_name"]}
    read = tables.read_tables(spark, sf, columns)
    parts = [df.toDF("id", "label").withColumn("table_name", F.lit(name)) for name, df in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("line_list_scan", "select c_name as value from customer")
def line_list_scan(spark, sf):
    path = work_folder(spark, "lines")
    shape(spark, sf, "customer").select("c_name").write.text(path)
    return files.read_lines(spark, path)


@query(
    "delimited_scan",
    "select c_name as name, n_name as language, r_name as territory from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey",
)
def delimited_scan(spark, sf):
    path = work_folder(spark, "delimited")
    customer, nation, region = (shape(spark, sf, n) for n in ("customer", "nation", "region"))
    located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    located.select("c_name", "n_name", "r_name").write.csv(path)
    return files.read_delimited(spark, path, "name string, language string, territory string")


@query(
    "tagged_record_groups",
    """with h as (select order_id, warehouse_id as file_no, row_number() over (partition by warehouse_id order by order_id) as group_no from oe_orders)
       select file_no, group_no, order_id as owner, count(i.order_id) as records, cast(coalesce(sum(quantity), 0) as bigint) as quantity
       from h left join oe_items i using (order_id) group by all""",
)
def tagged_record_groups(spark, sf):
    """Files of ``New`` order records, each followed by the ``Upd`` records of its items, split into their groups."""
    path = work_folder(spark, "tagged")
    orders, items = shape(spark, sf, "oe_orders"), shape(spark, sf, "oe_items")
    heads = orders.select(F.col("warehouse_id").alias("file_no"), "order_id", F.lit("New").alias("tag"),
                          F.lit(0).alias("line"), F.lit(0).cast("long").alias("quantity"))
    lines = items.join(orders.select("order_id", "warehouse_id"), "order_id").select(
        F.col("warehouse_id").alias("file_no"), "order_id", F.lit("Upd").alias("tag"), F.col("line_no").alias("line"), "quantity"
    )
    heads.unionByName(lines).write.csv(path)
    schema = "file_no bigint, order_id bigint, tag string, line int, quantity bigint"
    records = files.read_delimited(spark, path, schema)
    # order and line as one number: it never decreases along the records, and an order with many lines spans blocks
    longest = records.agg(F.coalesce(F.max("line"), F.lit(0)).cast("decimal(12,0)")).scalar()
    place = F.col("order_id").cast("decimal(20,0)") * (longest + 1).cast("decimal(12,0)") + F.col("line")
    block = F.floor(place / F.lit(ID_BLOCK)).cast("decimal(30,0)")
    grouped = tables.group_by_marker(records, ["file_no"], ["order_id", "line"], "tag", "New", [block], "group_no")
    return grouped.groupBy("file_no", "group_no").agg(
        F.min(F.when(F.col("tag") == "New", F.col("order_id"))).alias("owner"),
        F.count(F.when(F.col("tag") != "New", 1)).alias("records"),
        F.sum("quantity").alias("quantity"),
    )


@query(
    "metadata_bounds",
    """select (select min(c_custkey) from customer) as MIN_CUST_ID, (select max(c_custkey) from customer) as MAX_CUST_ID,
              (select min(o_orderkey) from orders) as MIN_ORDER_ID, (select max(o_orderkey) from orders) as MAX_ORDER_ID""",
)
def metadata_bounds(spark, sf):
    """Customer bounds are stored; order bounds are absent and come from the data."""
    customer, orders = shape(spark, sf, "customer"), shape(spark, sf, "orders")
    stored = customer.agg(F.min("c_custkey").alias("MIN_CUST_ID"), F.max("c_custkey").alias("MAX_CUST_ID"))
    metadata = stored.unpivot([], ["MIN_CUST_ID", "MAX_CUST_ID"], "metadata_key", "metadata_value").withColumn(
        "metadata_value", F.col("metadata_value").cast("string")
    )
    keys = {
        "MIN_CUST_ID": F.min("o_custkey"), "MAX_CUST_ID": F.max("o_custkey"),
        "MIN_ORDER_ID": F.min("o_orderkey"), "MAX_ORDER_ID": F.max("o_orderkey"),
    }
    return tables.metadata_bounds(metadata, keys, orders)


@query(
    "statement_batch",
    """select 1 as place, 'open orders' as statement, count(*) as row_count from orders where o_orderstatus = 'O'
       union all select 2, 'segments', count(distinct c_mktsegment) from customer
       union all select 3, 'big lines', count(*) from lineitem where l_quantity > 40""",
)
def statement_batch(spark, sf):
    views = {n: shape(spark, sf, n) for n in ("orders", "customer", "lineitem")}
    statements = [
        ("open orders", "select o_orderkey from {orders} where o_orderstatus = 'O'"),
        ("segments", "select distinct c_mktsegment from {customer}"),
        ("big lines", "select l_orderkey from {lineitem} where l_quantity > 40"),
    ]
    return tables.run_statements(spark, statements, views)


ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
              "conversations").split()


@query("table_inventory", " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in ALL_TABLES))
def table_inventory(spark, sf):
    return tables.inventory({t: shape(spark, sf, t) for t in ALL_TABLES})


SCHEMA_SPEC = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_since": "date"},
    "lineitem": {"l_orderkey": "bigint", "l_quantity": "bigint"},
    "warehouses": {"warehouse_id": "bigint"},
}


@query(
    "validate_schema",
    """with spec(table_name, column_name, kind) as (values
         ('orders', 'o_orderkey', 'BIGINT'), ('orders', 'o_custkey', 'BIGINT'), ('orders', 'o_totalprice', 'DOUBLE'),
         ('customer', 'c_custkey', 'BIGINT'), ('customer', 'c_name', 'VARCHAR'), ('customer', 'c_since', 'DATE'),
         ('lineitem', 'l_orderkey', 'BIGINT'), ('lineitem', 'l_quantity', 'BIGINT'), ('warehouses', 'warehouse_id', 'BIGINT')),
       present as (select distinct table_name, column_name, data_type from information_schema.columns),
       r as (select s.table_name, count(*) as expected, count(*) filter (where p.data_type = s.kind) as valid_columns,
                    count(*) filter (where p.column_name is null) as missing_columns
             from spec s left join present p using (table_name, column_name) group by 1)
       select table_name, case when not exists (select 1 from present p where p.table_name = r.table_name) then 'missing'
                               when valid_columns = expected then 'valid' else 'invalid' end as state,
              valid_columns::int as valid_columns, (expected - valid_columns - missing_columns)::int as wrong_columns,
              missing_columns::int as missing_columns,
              case table_name when 'orders' then (select count(*) from orders) when 'customer' then (select count(*) from customer)
                   when 'lineitem' then (select count(*) from lineitem) else 0 end as row_count
       from r""",
)
def validate_schema(spark, sf):
    # schemas as the files have them, not as declared
    present = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer", "lineitem")}
    return tables.validate(present, SCHEMA_SPEC)


# --- documents --------------------------------------------------------------------------------
PASSENGER = """PassengerId bigint, Name struct<First: string, Last: string>, Country string, part bigint,
               FlightHistory array<struct<FlightDate: bigint, Airport: string>>"""


def _passengers(spark, sf):
    """Customers as passenger documents with a flight per order."""
    customers, orders = shape(spark, sf, "oe_customers"), shape(spark, sf, "oe_orders")
    flights = orders.select(
        "customer_id", "order_date", "order_id",
        F.unix_seconds(F.col("order_date").cast("timestamp")).alias("FlightDate"), F.col("order_mode").alias("Airport"),
    )
    history = collect_ordered(
        flights, ["customer_id"], ["order_date", "order_id"], ["FlightDate", "Airport"], "FlightHistory",
        [F.col("order_date")], ROWS,
    )
    return customers.join(history, "customer_id", "left").select(
        F.col("customer_id").alias("PassengerId"),
        F.struct(F.col("cust_first_name").alias("First"), F.col("cust_last_name").alias("Last")).alias("Name"),
        F.col("country_code").alias("Country"),
        F.coalesce("chunk", F.lit(0).cast("long")).alias("part"),
        "FlightHistory",
    )


@query(
    "document_scan",
    """select c.customer_id as passenger_id, c.cust_first_name as first_name, count(o.order_id) as flights,
              arg_min(o.order_mode, strftime(o.order_date, '%Y%m%d') || lpad(o.order_id::varchar, 20, '0')) as first_airport
       from oe_customers c left join oe_orders o using (customer_id) group by all""",
)
def document_scan(spark, sf):
    path = work_folder(spark, "passengers")
    files.write_documents(_passengers(spark, sf), path)
    docs = files.read_documents(spark, path, PASSENGER)
    return docs.groupBy(F.col("PassengerId").alias("passenger_id"), F.col("Name.First").alias("first_name")).agg(
        F.sum(F.greatest(F.size("FlightHistory"), F.lit(0))).alias("flights"),
        F.min_by(F.get("FlightHistory", F.lit(0))["Airport"], "part").alias("first_airport"),
    )


@query(
    "document_write",
    """with o as (select *, row_number() over (partition by customer_id order by order_date, order_id) - 1 as i from oe_orders),
            h as (select customer_id, i // 256 as part, list(struct_pack(FlightDate := epoch(order_date)::bigint, Airport := order_mode) order by i) as f
                  from o group by all)
       select to_json(struct_pack(PassengerId := c.customer_id, Name := struct_pack(First := cust_first_name, Last := cust_last_name),
                Country := country_code, part := coalesce(part, 0), FlightHistory := f))::varchar as value
       from oe_customers c left join h using (customer_id)""",
)
def document_write(spark, sf):
    path = work_folder(spark, "passengers")
    files.write_documents(_passengers(spark, sf), path)
    return files.read_lines(spark, path)


# fixed values: the field names of a message (one is spelled LocationLongtitude)
PUBLISH_SQL = """select to_json(struct_pack(EventId := event_id, EventType := event_type, TimeStamp := strftime(ts, '%Y-%m-%dT%H:%MZ'),
              CustomerID := user_id, DeviceID := cast(props->>'$.k' as bigint), LocationLatitude := null, LocationLongtitude := null))::varchar as value
       from events"""


@query("event_publish", PUBLISH_SQL)
def event_publish(spark, sf):
    path = work_folder(spark, "published")
    files.publish_events(shape(spark, sf, "events"), path)
    return files.read_lines(spark, path)


@query("event_publish_stream", PUBLISH_SQL)
def event_publish_stream(spark, sf):
    """The same messages, published by a stream that follows the events."""
    folder = work_folder(spark, "published")
    files.publish_stream(open_stream(spark, f"{sf}/events.parquet", FILES_PER_TRIGGER), f"{folder}/out", f"{folder}/checkpoint")
    return files.read_lines(spark, f"{folder}/out")


# --- runs ------------------------------------------------------------------------------------------
OVERVIEW_SQL = """
  pm as (select run_day, date_trunc('minute', ts) as m, count(*) as n from run_tx group by all),
  ov as (select run_day, count(*) as total, cast(sum(failed) as bigint) as failed,
                (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double as seconds from run_tx group by 1),
  o2 as (select ov.*, total - failed as completed, round((total - failed) / nullif(seconds, 0), 6) as average_tps,
                (select max(n) from pm where pm.run_day = ov.run_day) as max_per_minute from ov)"""
OVERVIEW = ["total", "failed", "completed", "max_per_minute", "average_tps"]


def _overview(spark, sf):
    return runs.run_overview(shape(spark, sf, "run_tx"))


def _named(df):
    return df.withColumn("run_day", F.col("run_day").cast("string"))


@query("run_overview", f"with {OVERVIEW_SQL} select cast(run_day as varchar) as run_day, total, failed, completed, max_per_minute, average_tps, round(seconds, 3) as seconds from o2")
def run_overview(spark, sf):
    return _named(_overview(spark, sf)).select("run_day", *OVERVIEW, F.round("seconds", 3).alias("seconds"))


@query("run_list", f"with {OVERVIEW_SQL} select cast(run_day as varchar) as run_day, completed from o2 order by 1 desc")
def run_list(spark, sf):
    return _named(runs.run_list(_overview(spark, sf))).select("run_day", "completed")


@query(
    "run_compare",
    f"""with {OVERVIEW_SQL},
        l as (unpivot (select cast(run_day as varchar) as run, total::double as total, failed::double as failed, average_tps from o2)
              on total, failed, average_tps into name metric value value)
        select metric, max(value) filter (where run = '2024-01-01') as "2024-01-01", max(value) filter (where run = '2024-01-02') as "2024-01-02",
               max(value) filter (where run = '2024-01-03') as "2024-01-03" from l group by metric""",
)
def run_compare(spark, sf):
    return runs.run_compare(_overview(spark, sf), ["total", "failed", "average_tps"], ["2024-01-01", "2024-01-02", "2024-01-03"])


def _run_documents(spark, sf):
    """Each run as the JSON text of its results document."""
    o = _overview(spark, sf)
    overview = F.struct(
        F.lit("events").alias("BenchmarkName"),
        F.col("run_day").cast("string").alias("TimeOfRun"),
        F.col("average_tps").cast("decimal(20,6)").cast("string").alias("AverageTransactionsPerSecond"),
        F.col("completed").cast("string").alias("TotalCompletedTransactions"),
        F.col("failed").cast("string").alias("TotalFailedTransactions"),
    )
    return o.select(F.struct(overview.alias("Overview")).alias("Results"))


@query(
    "run_trend",
    f"""with {OVERVIEW_SQL}, l as (select run_day, average_tps, lag(average_tps) over (order by run_day) as p from o2)
        select cast(run_day as varchar) as run_day, average_tps, round((average_tps - p) / nullif(p, 0) * 100, 2) as change_pct from l""",
)
def run_trend(spark, sf):
    docs = _run_documents(spark, sf).select(F.to_json(F.struct("Results")).alias("doc"))
    rates = docs.select(
        json_value("doc", "$.Results.Overview.TimeOfRun", "string").alias("run_day"),
        json_value("doc", "$.Results.Overview.AverageTransactionsPerSecond", "double").alias("average_tps"),
    )
    return runs.run_trend(rates, "run_day", "average_tps")


@query(
    "results_scan",
    f"""with {OVERVIEW_SQL}
        select f.fmt, 'events' as benchmark_name, cast(run_day as varchar) as time_of_run, average_tps, completed, failed
        from o2, (values ('json'), ('xml')) f(fmt)""",
)
def results_scan(spark, sf):
    """Run documents written as JSON and as XML and read back."""
    folder = work_folder(spark, "results")
    docs = _run_documents(spark, sf)
    docs.write.json(f"{folder}/json")
    docs.select("Results.*").write.format("xml").option("rootTag", "Runs").option("rowTag", "Results").save(f"{folder}/xml")
    read = {fmt: files.read_runs(spark, f"{folder}/{fmt}", fmt).withColumn("fmt", F.lit(fmt)) for fmt in ("json", "xml")}
    return read["json"].unionByName(read["xml"])
