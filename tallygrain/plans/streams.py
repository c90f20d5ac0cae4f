"""Event-stream queries. Each follows the events table as a file stream and returns the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.functions.scalars import units
from tallygrain.operators import changes
from tallygrain.registry import query
from tallygrain.session import work_folder, written
from tallygrain.shapes import shape
from tallygrain.streaming import events as ev
from tallygrain.streaming import late, log


def _followed(spark, sf, build, keys, merge):
    """The state after the events table, each event id taken once.

    The table is one history in no promised file order: no event may be too old,
    so ids are kept in runs on shared storage, not in a state store.
    """
    stream = ev.open_stream(spark, f"{sf}/events.parquet", ev.FILES_PER_TRIGGER)
    state = log.follow(stream, work_folder(spark, "follow"), build, keys, merge)
    return log.merged(build(spark.createDataFrame([], stream.schema)), keys, merge) if state is None else state


def _stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _windows(df, *rest):
    return df.select(_stamp("w.start").alias("window_start"), *rest)


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("event_stream", "select event_type, user_id, count(*) as n from events group by all")
def event_stream(spark, sf):
    def counts(events):
        return events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))

    return _followed(spark, sf, counts, ["event_type", "user_id"], {"n": "sum"})


@query(
    "throughput_tumbling",
    f"""select {STAMP.format("date_trunc('minute', ts)")} as window_start, event_type, count(*) as n from events group by all""",
)
def throughput_tumbling(spark, sf):
    state = _followed(spark, sf, lambda events: ev.throughput(events, "1 minute"), ["w", "event_type"], {"n": "sum"})
    return _windows(state, "event_type", "n")


@query(
    "throughput_sliding",
    f"""with panes as (select date_trunc('second', ts) as s, event_type, count(*) as tps from events group by all)
        select {STAMP.format("s")} as second, event_type, tps,
               cast(sum(tps) over (partition by event_type order by s range between interval 59 second preceding and current row) as bigint) as tpm
        from panes""",
)
def throughput_sliding(spark, sf):
    """Transactions of every second, and of the minute that ends with it."""
    state = _followed(spark, sf, ev.panes, ["second", "event_type"], {"tps": "sum"})
    rates = ev.trailing(state, ["event_type"], "second", "tps", 60, "tpm")
    return rates.select(_stamp("second").alias("second"), "event_type", "tps", "tpm")


@query(
    "activity_last_hour",
    f"""with b as (select time_bucket(interval 5 minute, ts) as s, user_id % 10 + 1 as warehouse_id,
                          sum(cast(round(value * 100) as bigint))::double / 100 as order_value, count(*) as n from events group by all)
        select {STAMP.format("s")} as window_start, warehouse_id, order_value, n
        from b where s > (select max(s) from b) - interval 1 hour""",
)
def activity_last_hour(spark, sf):
    """Value and number of orders of a warehouse in the twelve five-minute buckets up to the newest event's."""
    def buckets(events):
        return ev.activity(events, (F.col("user_id") % 10 + 1).alias("warehouse_id"))

    state = written(_followed(spark, sf, buckets, ["w", "warehouse_id"], {"cents": "sum", "n": "sum"}), "buckets")
    return _windows(ev.last_hour(state), "warehouse_id", units("cents").alias("order_value"), "n")


@query(
    "device_state",
    f"""select user_id, cast(props->>'$.k' as bigint) as device_id, {STAMP.format('min(ts)')} as initial_access,
               {STAMP.format('max(ts)')} as last_access, count(*) as access_count from events group by all""",
)
def device_state(spark, sf):
    merge = {"initial_access": "min", "last_access": "max", "access_count": "sum"}
    state = _followed(spark, sf, ev.device_state, ["user_id", "device_id"], merge)
    return state.withColumns({c: _stamp(c) for c in ("initial_access", "last_access")})


@query(
    "login_state",
    f"""select user_id, {STAMP.format("max(ts) filter (where event_type in ('signup', 'view'))")} as last_login,
               count(*) filter (where event_type = 'error') as failed_logins,
               {STAMP.format("max(ts) filter (where event_type = 'error')")} as last_failed_login
        from events where event_type in ('signup', 'view', 'error') group by user_id""",
)
def login_state(spark, sf):
    merge = {"last_login": "max", "failed_logins": "sum", "last_failed_login": "max"}
    state = _followed(spark, sf, ev.login_state, ["user_id"], merge)
    return state.withColumns({c: _stamp(c) for c in ("last_login", "last_failed_login")})


@query(
    "late_events",
    """with mark as (select max(ts) - interval 1 day as w from events where event_type <> 'error'),
            x as (select event_type, event_type = 'error' and time_bucket(interval 1 hour, ts) + interval 1 hour <= w as late
                  from events, mark)
       select event_type, count(*) as received, count(*) filter (where not late) as kept, count(*) filter (where late) as late
       from x group by event_type""",
)
def late_events(spark, sf):
    """Error events arrive after all others, so most of them lie behind a one-day watermark."""
    events = shape(spark, sf, "events")
    waves = [events.filter("event_type <> 'error'"), events.filter("event_type = 'error'")]
    return ev.late_report(waves, "1 day", "1 hour")


HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds
WAVES = (("view", "signup"), ("click",), ("purchase", "error"))


@query(
    "late_rows",
    """with waves as (select *, case when event_type in ('view', 'signup') then 0 when event_type = 'click' then 1 else 2 end as wave from events),
            marks as (select w.wave, max(e.ts) - interval 1 day as mark from (values (1), (2)) w(wave) join waves e on e.wave < w.wave group by w.wave)
       select event_id, event_type, user_id, wave from waves join marks using (wave)
       where time_bucket(interval 1 hour, ts) + interval 1 hour <= mark""",
)
def late_rows(spark, sf):
    """Three waves of events, the stream stopped after each; the rows that came behind a one-day watermark."""
    folder = work_folder(spark, "late-rows")
    events = shape(spark, sf, "events")
    build = lambda batch: ev.throughput(batch, "1 hour")
    for types in WAVES:
        # one file a wave, so that it is one micro-batch
        events.filter(F.col("event_type").isin(*types)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = ev.open_stream(spark, f"{folder}/in")
        late.follow_late(stream, folder, "ts", HOUR, DAY, build, ["w", "event_type"], {"n": "sum"})
    found = late.late_rows(spark, folder, stream.schema)
    return found.select("event_id", "event_type", "user_id", F.col("batch").cast("int").alias("wave"))


@query(
    "change_feed_apply",
    """select customer_id, cast(credit_cents + coalesce(d, 0) as bigint) as credit_cents from oe_customers left join (
         select user_id as customer_id, sum(cast(round(value * 100) as bigint)) as d from events
         where event_type = 'purchase' group by 1) using (customer_id)""",
)
def change_feed_apply(spark, sf):
    def increments(events):
        bought = events.filter("event_type = 'purchase'")
        return bought.groupBy(F.col("user_id").alias("customer_id")).agg(F.sum(ev.cents()).alias("credit_cents"))

    base = shape(spark, sf, "oe_customers").select("customer_id", "credit_cents")
    added = _followed(spark, sf, increments, ["customer_id"], {"credit_cents": "sum"})
    return changes.apply_increment(base, added, ["customer_id"], ["credit_cents"])
