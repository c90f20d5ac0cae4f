"""Sales history reports over the star schema.

The fact is the sale line; customer and channel are attributes of its order.
So the order side (a quarter of the rows) is joined to customers and countries
first, and the lines are shuffled once, to meet it. The sums that follow
combine before their shuffle. A dimension that is neither filtered nor grouped
on is not joined, since the star's foreign keys are complete; reports by
product or date alone never touch the orders. Calendar columns come from the
date itself, grouped as numbers and dates and written out as text at the end.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.scalars import money_text, quarter_desc, units
from tallygrain.operators import aggregates, joins, predicates, windows
from tallygrain.plans.scalars import money_check
from tallygrain.registry import query
from tallygrain.shapes import shape

# grouping expressions of the calendar periods
WEEK = {"calendar_week_number": "weekofyear(time_id)"}
YEAR_WEEK = {"calendar_year": "year(time_id)", **WEEK}
MONTH = {"calendar_month_desc": "trunc(time_id, 'MM')"}
QUARTER = {"calendar_quarter_desc": "trunc(time_id, 'QUARTER')"}
QUARTER_MONTH = {
    "calendar_year": "year(time_id)", "calendar_quarter_number": "quarter(time_id)", "calendar_month_number": "month(time_id)"
}


def grouping(columns: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in columns.items()]


def labelled(df: DataFrame) -> DataFrame:
    """Period dates as their descriptions."""
    if "calendar_month_desc" in df.columns:
        df = df.withColumn("calendar_month_desc", F.date_format("calendar_month_desc", "yyyy-MM"))
    if "calendar_quarter_desc" in df.columns:
        df = df.withColumn("calendar_quarter_desc", quarter_desc("calendar_quarter_desc"))
    return df


def summed(df: DataFrame, keys: list) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("amount_cents").alias("cents"))


def order_places(orders: DataFrame, customers: DataFrame, countries: DataFrame) -> DataFrame:
    """Orders with their customer's country: the snowflaked arm of the star."""
    people = customers.select("cust_id", "country_id")
    return joins.star_join(orders, [(people, "cust_id"), (countries, "country_id")]).drop("country_id", "cust_id")


class Slice(NamedTuple):
    """What a report is about: value lists, all values where a list is empty.

    ``months`` are texts like ``1999-03``; ``weeks`` are numbers, of every year
    unless ``years`` are given.
    """

    channels: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    months: tuple[str, ...] = ()
    weeks: tuple[int, ...] = ()

    def spans(self) -> list[tuple[dt.date, dt.date]]:
        """First and last days of the chosen months, or else of the years; adjoining ones as one span."""
        if self.months:
            firsts = [dt.date.fromisoformat(f"{m}-01") for m in self.months]
            lasts = [(f + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1) for f in firsts]
            days = [(a, b) for a, b in zip(firsts, lasts) if not self.years or a.year in self.years]
        else:
            days = [(dt.date(y, 1, 1), dt.date(y, 12, 31)) for y in self.years]
        joined: list[tuple[dt.date, dt.date]] = []
        for a, b in sorted(days):
            if joined and a <= joined[-1][1] + dt.timedelta(days=1):
                a, b = joined.pop()[0], b
            joined.append((a, b))
        return joined

    def dated(self, df: DataFrame) -> DataFrame:
        """Rows of the chosen time. Date ranges reach the scan, week numbers cannot."""
        if self.months or self.years:
            within = [F.col("time_id").between(F.lit(a), F.lit(b)) for a, b in self.spans()]
            df = df.filter(reduce(or_, within, F.lit(False)))
        return predicates.where_in(df, "weekofyear(time_id)", self.weeks) if self.weeks else df

    def where(self) -> str:
        """The same as a condition in SQL."""
        lists = {
            "channel_desc": self.channels, "country_iso_code": self.countries, "prod_name": self.products,
            "calendar_year": self.years, "calendar_month_desc": self.months, "calendar_week_number": self.weeks,
        }
        given = [f"{c} in ({', '.join(map(repr, v))})" for c, v in lists.items() if v]
        return "where " + " and ".join(given) if given else ""


def _load(spark, sf, *names):
    return [shape(spark, sf, n) for n in names]


def _placed_lines(spark, sf) -> DataFrame:
    lines, orders, customers, countries = _load(spark, sf, "sale_lines", "sale_orders", "customers", "countries")
    return lines.join(order_places(orders, customers, countries), "order_id")


# --- year over year ----------------------------------------------------------
def year_over_year(
    lines: DataFrame, products: DataFrame, times: DataFrame, target_year: int, weeks: tuple[int, int]
) -> DataFrame:
    """Weekly sales, year-to-date sums and the same week's sum a year before, per product name."""
    keys = ["prod_name", "calendar_year", "calendar_week_number"]
    years = [target_year - 1, target_year]
    span = F.col("calendar_year").isin(years) & F.col("calendar_week_number").between(*weeks)
    # the dates of both years reach the scan, the week numbers cannot
    both = Slice(years=(target_year - 1, target_year))
    dated = both.dated(lines)
    weekly = dated.select("prod_id", "amount_cents", *grouping(YEAR_WEEK)).filter(span)
    by_name = joins.star_join(weekly, [(products.select("prod_id", "prod_name"), "prod_id")])
    periods = both.dated(times).filter(span).select("calendar_year", "calendar_week_number")
    dense = joins.densify(summed(by_name, keys), ["prod_name"], periods, {"cents": 0})
    ytd = windows.running_sum(dense, ["prod_name", "calendar_year"], "calendar_week_number", "cents", "ytd")
    prior = windows.lag_by(ytd, ["prod_name", "calendar_week_number"], "calendar_year", "ytd", 1, "ytd_prior")
    return prior.filter(F.col("calendar_year") == target_year).select(
        *keys,
        units("cents").alias("sales"),
        units("ytd").alias("weekly_ytd_sales"),
        units("ytd_prior").alias("weekly_ytd_sales_prior_year"),
    )


def _yoy_sql(year: int, low: int, high: int) -> str:
    return f"""
with v as (
  select prod_name, calendar_year, calendar_week_number, sum(amount_cents) as cents
  from sales join times using (time_id) join products using (prod_id)
  where calendar_year in ({year - 1}, {year}) and calendar_week_number between {low} and {high}
  group by all),
periods as (
  select distinct calendar_year, calendar_week_number from times
  where calendar_year in ({year - 1}, {year}) and calendar_week_number between {low} and {high}),
dense as (
  select n.prod_name, p.calendar_year, p.calendar_week_number, coalesce(v.cents, 0) as cents
  from (select distinct prod_name from v) n cross join periods p left join v
    on v.prod_name = n.prod_name and v.calendar_year = p.calendar_year
       and v.calendar_week_number = p.calendar_week_number),
ytd as (
  select *, sum(cents) over (partition by prod_name, calendar_year order by calendar_week_number) as y from dense),
lagged as (
  select *, lag(y) over (partition by prod_name, calendar_week_number order by calendar_year) as p from ytd)
select prod_name, calendar_year, calendar_week_number, cents / 100.0::double as sales,
       y::double / 100 as weekly_ytd_sales, p::double / 100 as weekly_ytd_sales_prior_year
from lagged where calendar_year = {year}"""


@query("sh_period_to_period", _yoy_sql(2000, 1, 53))
def sh_period_to_period(spark, sf):
    """All weeks of a year against the year before."""
    return year_over_year(*_load(spark, sf, "sale_lines", "products", "times"), 2000, (1, 53))


@query("sh_week_to_week", _yoy_sql(1999, 23, 23))
def sh_week_to_week(spark, sf):
    """One week against the same week a year before."""
    return year_over_year(*_load(spark, sf, "sale_lines", "products", "times"), 1999, (23, 23))


# --- rollups and cubes ---------------------------------------------------------
def _product_rollup(spark, sf, keys: dict[str, str], pick: Slice, by_name: bool) -> DataFrame:
    """Rollup of periods and, by name, products; countries are joined only if some are chosen."""
    lines, products = _load(spark, sf, "sale_lines", "products")
    sold = pick.dated(lines)
    if pick.countries:
        orders, customers, countries = _load(spark, sf, "sale_orders", "customers", "countries")
        chosen = predicates.where_in(countries, "country_iso_code", pick.countries)
        sold = sold.join(order_places(orders, customers, chosen).select("order_id"), "order_id")
    if pick.products:
        products = predicates.where_in(products, "prod_name", pick.products)
    names = ["prod_name"] if by_name else []
    if by_name:
        sold = joins.star_join(sold, [(products.select("prod_id", "prod_name"), "prod_id")])
    elif pick.products:
        sold = predicates.lookup(sold, products, ["prod_id"])
    columns = [*keys, *names]
    summed_up = aggregates.rollup_sum(sold.select("amount_cents", *names, *grouping(keys)), columns, "amount_cents", "cents")
    return summed_up.select(*columns, units("cents").alias("amount_sold"), "level")


def _product_sql(keys: dict[str, str], pick: Slice, by_name: bool) -> str:
    columns = ", ".join([*keys, *(["prod_name"] if by_name else [])])
    return f"""
select {columns}, sum(amount_cents)::double / 100 as amount_sold, grouping_id({columns}) as level
from sales join times using (time_id) join products using (prod_id) join customers using (cust_id)
     join countries using (country_id) {pick.where()}
group by rollup({columns})"""


SOME_PRODUCTS = ("red widget", "blue bolt", "small ring")
SOME_COUNTRIES = ("NATION_3", "NATION_7", "NATION_19")
SOME_CHANNELS = ("1-URGENT", "5-LOW")

PRODUCT_REPORTS = {
    "sh_product_monthly_rollup": (YEAR_WEEK, Slice(), True),
    "sh_product_monthly_rollup_chosen": (
        YEAR_WEEK, Slice(products=SOME_PRODUCTS, countries=SOME_COUNTRIES, months=("1998-11", "1998-12", "1999-02")), True,
    ),
    "sh_product_rollup": (QUARTER_MONTH, Slice(products=SOME_PRODUCTS), False),
    "sh_product_rollup_chosen": (
        QUARTER_MONTH, Slice(products=SOME_PRODUCTS, countries=SOME_COUNTRIES, years=(1997, 1999)), False,
    ),
}


def _product_report(key: str, args: tuple) -> None:
    @query(key, _product_sql(*args))
    def report(spark, sf):
        return _product_rollup(spark, sf, *args)


for _key, _args in PRODUCT_REPORTS.items():
    _product_report(_key, _args)


def level_report(levels, spark, sf, period: dict[str, str], pick: Slice = Slice()) -> DataFrame:
    """Subtotals of channel, period and country over the leaf sums: as text and in cents."""
    lines, orders, customers, countries = _load(spark, sf, "sale_lines", "sale_orders", "customers", "countries")
    if pick.channels:
        orders = predicates.where_in(orders, "channel_desc", pick.channels)
    if pick.countries:
        countries = predicates.where_in(countries, "country_iso_code", pick.countries)
    placed = order_places(orders, customers, countries)
    sold = pick.dated(lines).select("order_id", "amount_cents", *grouping(period)).join(placed, "order_id")
    keys = ["channel_desc", *period, "country_iso_code"]
    leaves = labelled(summed(sold, keys))
    total = F.col("total")
    return levels(leaves, keys, "cents", "total").select(
        *keys, money_text(total).alias("sales_text"), total.cast("long").alias("sales_cents"), "level"
    )


def _level_sql(grouping: str, period: str, pick: Slice) -> str:
    keys = f"channel_desc, {period}, country_iso_code"
    return f"""
with totals as (
  select {keys}, sum(amount_cents)::hugeint as cents, grouping_id({keys}) as level
  from sales join times using (time_id) join customers using (cust_id) join channels using (channel_id)
       join countries using (country_id) {pick.where()}
  group by {grouping}({keys}))
select {keys}, {money_check("cents")} as sales_text, cents::bigint as sales_cents, level from totals"""


LEVEL_REPORTS = {
    "sh_cube_month": ("cube", MONTH, Slice()),
    "sh_cube_month_chosen": (
        "cube", MONTH, Slice(channels=SOME_CHANNELS, countries=SOME_COUNTRIES, months=("1997-12", "1998-01", "1998-02")),
    ),
    "sh_cube_week": ("cube", WEEK, Slice()),
    "sh_cube_week_chosen": ("cube", WEEK, Slice(channels=SOME_CHANNELS, countries=SOME_COUNTRIES, years=(1999,), weeks=(22, 23, 24))),
    "sh_rollup_month": ("rollup", MONTH, Slice()),
    "sh_rollup_month_chosen": ("rollup", MONTH, Slice(channels=SOME_CHANNELS, countries=SOME_COUNTRIES, years=(1996, 1998))),
    "sh_rollup_week": ("rollup", WEEK, Slice(channels=SOME_CHANNELS)),
    "sh_rollup_week_chosen": ("rollup", WEEK, Slice(channels=SOME_CHANNELS, years=(2000,), weeks=(1, 2, 52))),
}
LEVELS = {"cube": aggregates.cube_agg, "rollup": aggregates.rollup_sum}


def _level_query(key: str, levels: str, period: dict[str, str], pick: Slice) -> None:
    @query(key, _level_sql(levels, *period, pick))
    def report(spark, sf):
        return level_report(LEVELS[levels], spark, sf, period, pick)


for _key, _args in LEVEL_REPORTS.items():
    _level_query(_key, *_args)


# --- grouped sums ----------------------------------------------------------------
@query(
    "sh_sales_by_country_year",
    """
select country_name, calendar_year, sum(quantity_sold * list_cents)::double / 100 as list_value
from sales join products using (prod_id) join customers using (cust_id) join countries using (country_id)
     join times using (time_id)
group by country_name, calendar_year""",
)
def sh_sales_by_country_year(spark, sf):
    """Quantity at list price per country and year."""
    products = shape(spark, sf, "products").select("prod_id", "list_cents")
    priced = joins.star_join(_placed_lines(spark, sf), [(products, "prod_id")])
    value = priced.select(
        "country_name", F.year("time_id").alias("calendar_year"),
        (F.col("quantity_sold") * F.col("list_cents")).alias("amount_cents"),
    )
    keys = ["country_name", "calendar_year"]
    return summed(value, keys).select(*keys, units("cents").alias("list_value"))


def _country_sums(spark, sf, period: dict[str, str]) -> DataFrame:
    keys = [*period, "country_name"]
    sums = summed(_placed_lines(spark, sf).select("country_name", "amount_cents", *grouping(period)), keys)
    return labelled(sums).select(*keys, units("cents").alias("amount_sold"))


@query(
    "sh_sales_by_month_country",
    """
select calendar_month_desc, calendar_week_number, country_name, sum(amount_cents)::double / 100 as amount_sold
from sales join times using (time_id) join customers using (cust_id) join countries using (country_id)
group by all""",
)
def sh_sales_by_month_country(spark, sf):
    """Sales per month, week and country."""
    return _country_sums(spark, sf, {**MONTH, **WEEK})


@query(
    "sh_sales_by_week_country",
    """
select calendar_year, calendar_week_number, country_name, sum(amount_cents)::double / 100 as amount_sold
from sales join times using (time_id) join customers using (cust_id) join countries using (country_id)
group by all""",
)
def sh_sales_by_week_country(spark, sf):
    """Sales per year, week and country."""
    return _country_sums(spark, sf, YEAR_WEEK)


# --- windows -----------------------------------------------------------------------
@query(
    "sh_moving_average",
    """
with daily as (select time_id, sum(amount_cents)::hugeint as cents from sales group by time_id),
avged as (
  select *, avg(cents) over (order by time_id range between interval 2 day preceding and interval 2 day following) as a
  from daily)
select cast(time_id as varchar) as time_id,
       """
    + money_check("cents")
    + """ as sales_text, cents::bigint as sales_cents, round(a / 100, 4) as centered_5_day_avg
from avged""",
)
def sh_moving_average(spark, sf):
    """Daily sales and their centred five-day average."""
    daily = summed(shape(spark, sf, "sale_lines"), ["time_id"])
    # one row per calendar day by now, whatever the size of the facts
    smoothed = windows.moving_average(daily, "time_id", "cents", 2, "average")
    return smoothed.select(
        F.col("time_id").cast("string").alias("time_id"),
        money_text("cents").alias("sales_text"),
        F.col("cents").cast("long").alias("sales_cents"),
        F.round(F.col("average") / 100, 4).alias("centered_5_day_avg"),
    )


def top_customers(sales: DataFrame, customers: DataFrame, period: dict[str, str], k: int) -> DataFrame:
    """The best ``k`` customers of every period; names are joined to the ranked few."""
    sums = summed(sales, ["cust_id", *grouping(period)])
    ranked = labelled(windows.topk_enrich(sums, list(period), "cents", k, customers, "cust_id"))
    return ranked.select(
        *period, "cust_first_name", "cust_last_name", "cust_id", units("cents").alias("amount_sold"), "rank"
    )


def _top_sql(periods: str) -> str:
    return f"""
with sums as (
  select {periods}, cust_id, sum(amount_cents) as cents from sales join times using (time_id) group by all),
ranked as (select *, rank() over (partition by {periods} order by cents desc) as rank from sums)
select {periods}, cust_first_name, cust_last_name, cust_id, cents::double / 100 as amount_sold, rank::int as rank
from ranked join customers using (cust_id) where rank < 16"""


@query("sh_top_quarter", _top_sql("calendar_quarter_desc"))
def sh_top_quarter(spark, sf):
    """Top 15 customers of each quarter, ties kept."""
    return top_customers(*_load(spark, sf, "sales", "customers"), QUARTER, 15)


@query("sh_top_week", _top_sql("calendar_year, calendar_week_number"))
def sh_top_week(spark, sf):
    """Top 15 customers of each week and year, ties kept."""
    return top_customers(*_load(spark, sf, "sales", "customers"), YEAR_WEEK, 15)


@query(
    "sh_simple_lookup",
    """select c.cust_id, count(s.cust_id) as n from customers c left join sales s on s.cust_id = c.cust_id group by 1""",
)
def sh_simple_lookup(spark, sf):
    """Sales rows per customer key."""
    lines, orders, customers = _load(spark, sf, "sale_lines", "sale_orders", "customers")
    # lines are counted per order, so one row per order meets its customer
    per_order = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    placed = joins.split_join(orders.select("order_id", "cust_id"), per_order, ["order_id"])
    per_customer = placed.groupBy("cust_id").agg(F.sum("n").alias("n"))
    found = customers.select("cust_id").distinct().join(per_customer, "cust_id", "left")
    return found.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
