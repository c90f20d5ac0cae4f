"""Streams over several files with repeated ids, late rows and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallygrain.session import work_folder
from tallygrain.streaming import events as ev


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute, seconds=second)


def event(i, minute, kind="view", user=1, value=1.0, k=5):
    return (i, at(minute), user, kind, value, f'{{"k": {k}}}')


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, ev.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, build, delay="30 minutes"):
    """One micro-batch per call: what is new in the folder, on the same checkpoint."""
    stream = build(ev.dedupe(ev.open_stream(spark, f"{folder}/in"), delay))
    ev.run_batches(stream, "update", ev.batch_writer(f"{folder}/out"), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@pytest.fixture()
def folder(spark):
    return work_folder(spark, "stream-test")


def test_repeats_are_dropped_and_state_goes_on_over_restarts(spark, folder, rows):
    build = ev.device_state
    add_file(spark, f"{folder}/in", [event(1, 0), event(2, 1), event(2, 1)])
    run(spark, folder, build)
    add_file(spark, f"{folder}/in", [event(2, 1), event(3, 9), event(4, 3, k=6)])
    written = run(spark, folder, build)
    state = ev.last_state(written, ["user_id", "device_id"])
    assert rows(state, "device_id", "access_count") == [(5, 3), (6, 1)]
    five = state.filter("device_id = 5").first()
    assert (five["initial_access"], five["last_access"]) == (at(0), at(9))


def test_events_of_any_age_count_once_over_several_batches(spark, folder, rows):
    old = [(90 + i, dt.datetime(2012, 1, 1, 0, i), 1, "view", 1.0, '{"k": 5}') for i in range(3)]
    for batch in ([event(1, 0), event(2, 1)], old, [event(1, 0), old[0], event(3, 2)]):
        add_file(spark, f"{folder}/in", batch)
    stream = ev.device_state(ev.dedupe(ev.open_stream(spark, f"{folder}/in", files_per_trigger=1)))
    ev.run_batches(stream, "update", ev.batch_writer(f"{folder}/out"), f"{folder}/checkpoint")
    written = spark.read.parquet(f"{folder}/out")
    assert written.select("batch_id").distinct().count() == 3
    state = ev.last_state(written, ["user_id", "device_id"]).first()
    assert (state["access_count"], state["initial_access"]) == (6, dt.datetime(2012, 1, 1))


def test_rows_behind_the_watermark_are_counted_as_late(spark, table, rows):
    waves = [
        spark.createDataFrame([event(1, 0), event(2, 120)], ev.EVENT_SCHEMA),
        spark.createDataFrame([event(3, 5), event(4, 119), event(5, 6, kind="error")], ev.EVENT_SCHEMA),
    ]
    got = rows(ev.late_report(waves, "30 minutes", "10 minutes"))
    assert got == [("error", 1, 0, 1), ("view", 4, 3, 1)]


def test_sliding_windows_cover_the_trailing_minute(spark, folder, rows):
    add_file(spark, f"{folder}/in", [event(1, 0), (2, at(0, 30), 1, "view", 1.0, "{}"), event(3, 1)])
    written = run(spark, folder, lambda s: ev.throughput(s, "60 seconds", "30 seconds"))
    got = rows(ev.last_state(written, ["w", "event_type"]).select(F.col("w.start").alias("s"), "n"))
    assert got == sorted([(at(-1, 30), 1), (at(0), 2), (at(0, 30), 2), (at(1), 1)], key=repr)


def test_activity_buckets_are_half_open(spark, folder, rows):
    add_file(spark, f"{folder}/in", [event(1, 0, value=2.5), event(2, 5, value=1.0), event(3, 4, value=0.1)])
    written = run(spark, folder, lambda s: ev.activity(s, "user_id"))
    got = rows(ev.last_state(written, ["w", "user_id"]).select("w.start", "cents", "n"))
    assert got == [(at(0), 260, 2), (at(5), 100, 1)]


def test_login_state(spark, folder):
    add_file(spark, f"{folder}/in", [event(1, 0), event(2, 1, "error"), event(3, 2, "error"), event(4, 3, "click")])
    row = ev.last_state(run(spark, folder, ev.login_state), ["user_id"]).first()
    assert (row["last_login"], row["failed_logins"], row["last_failed_login"]) == (at(0), 2, at(2))


def test_feed_is_idempotent_by_batch(spark, folder, table, rows):
    base = table([(1, 100), (2, 50)], "k long, v long")
    assert rows(ev.feed_state(base, ["k"], ["v"], f"{folder}/deltas")) == [(1, 100), (2, 50)]

    def follow():
        stream = ev.open_stream(spark, f"{folder}/in").select(F.col("user_id").alias("k"), ev.cents().alias("v"))
        ev.apply_feed(stream, ["k"], ["v"], f"{folder}/deltas", f"{folder}/checkpoint")
        return rows(ev.feed_state(base, ["k"], ["v"], f"{folder}/deltas"))

    add_file(spark, f"{folder}/in", [event(1, 0, value=1.0), event(2, 1, value=2.0)])
    assert follow() == [(1, 400), (2, 50)]
    assert follow() == [(1, 400), (2, 50)]  # nothing new
    add_file(spark, f"{folder}/in", [event(3, 0, user=2, value=0.5)])
    assert follow() == [(1, 400), (2, 100)]
    # the same batch run again overwrites its own sums
    again = table([(2, 50)], "k long, v long")
    again.write.mode("overwrite").parquet(f"{folder}/deltas/batch_id=1")
    assert rows(ev.feed_state(base, ["k"], ["v"], f"{folder}/deltas")) == [(1, 400), (2, 100)]
