"""Late rows are rows: stored, the same after a restart, and replayed into the state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallygrain.session import work_folder
from tallygrain.streaming import events as ev
from tallygrain.streaming import late, log
from tests.test_streaming import add_file, at

MINUTE = 60_000_000
MERGE = {"n": "sum"}
KEYS = ["w", "event_type"]


def build(batch):
    return ev.throughput(batch, "10 minutes")


def route(spark, folder, rows, batch_id):
    batch = spark.createDataFrame(rows, ev.EVENT_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    late.route_batch(batch, batch_id, folder, "ts", 10 * MINUTE, 30 * MINUTE, build, KEYS, MERGE)
    return batch.schema


def waves(count=5, size=60):
    rng = random.Random(2)
    return [
        [(100 * w + i, at(60 * w + rng.randrange(-200, 60)), 1, rng.choice(["view", "error"]), 1.0, "{}") for i in range(size)]
        for w in range(count)
    ]


def by_hand(given):
    """Ids of late rows with their wave, and counts of the others by window start and type."""
    newest, out, counts = None, [], {}
    for w, rows in enumerate(given):
        for i, ts, _, kind, _, _ in rows:
            start = ts - dt.timedelta(minutes=ts.minute % 10)
            if newest is not None and start + dt.timedelta(minutes=10) <= newest - dt.timedelta(minutes=30):
                out.append((i, w))
            else:
                counts[start, kind] = counts.get((start, kind), 0) + 1
        newest = max([r[1] for r in rows] + ([newest] if newest else []))
    return sorted(out), counts


def state_of(df):
    return {(r["w"]["start"], r["event_type"]): r["n"] for r in df.collect()}


@pytest.fixture()
def folder(spark):
    return work_folder(spark, "late-test")


def test_rows_behind_the_watermark_are_kept_whole(spark, folder, monkeypatch):
    monkeypatch.setattr(log, "TAIL", 3)  # merged on the way
    given = waves()
    for w, rows in enumerate(given):
        schema = route(spark, folder, rows, w)
    want, counts = by_hand(given)
    assert 20 < len(want) < 200
    got = late.late_rows(spark, folder, schema)
    assert sorted((r["event_id"], r["batch"]) for r in got.collect()) == want
    rows = {r[0]: r for w in given for r in w}
    assert all((r["ts"], r["event_type"]) == (rows[r["event_id"]][1], rows[r["event_id"]][3]) for r in got.collect())
    assert state_of(log.read_state(spark, folder, KEYS, MERGE)) == counts
    # replayed, they count as if they had come in time
    every = {}
    for r in rows.values():
        key = r[1] - dt.timedelta(minutes=r[1].minute % 10), r[3]
        every[key] = every.get(key, 0) + 1
    assert state_of(late.replayed(spark, folder, schema, build, KEYS, MERGE)) == every


def test_a_batch_run_again_meets_the_watermark_it_met(spark, folder, monkeypatch):
    given, write = waves(4), log.write_manifest

    def broken(*_):
        raise RuntimeError("lost")

    for w, rows in enumerate(given):
        monkeypatch.setattr(log, "write_manifest", broken)
        with pytest.raises(RuntimeError):
            route(spark, folder, rows, w)
        monkeypatch.setattr(log, "write_manifest", write)
        schema = route(spark, folder, rows, w)
        route(spark, folder, rows, w)
    want, counts = by_hand(given)
    assert sorted((r["event_id"], r["batch"]) for r in late.late_rows(spark, folder, schema).collect()) == want
    assert state_of(log.read_state(spark, folder, KEYS, MERGE)) == counts


def test_spark_drops_the_same_rows(spark, folder):
    """Spark's own windows, fed the same waves with a restart between them, leave out exactly the late rows."""
    given = waves(3)
    for w, rows in enumerate(given):
        add_file(spark, f"{folder}/in", rows)
        windows = build(ev.open_stream(spark, f"{folder}/in").withWatermark("ts", "30 minutes"))
        ev.run_batches(windows, "update", ev.batch_writer(f"{folder}/own"), f"{folder}/own-checkpoint")
        stream = ev.open_stream(spark, f"{folder}/in")
        late.follow_late(stream, folder, "ts", 10 * MINUTE, 30 * MINUTE, build, KEYS, MERGE)
    own = ev.last_state(spark.read.parquet(f"{folder}/own"), KEYS)
    assert state_of(own) == state_of(log.read_state(spark, folder, KEYS, MERGE)) == by_hand(given)[1]
    dropped = sum(map(len, given)) - own.agg(F.sum("n")).first()[0]
    assert dropped == late.late_rows(spark, folder, stream.schema).count() > 0


def test_no_late_rows_and_no_times(spark, folder):
    schema = route(spark, folder, [(1, at(0), 1, "view", 1.0, "{}"), (2, None, 1, "view", 1.0, "{}")], 0)
    assert late.late_rows(spark, folder, schema).count() == 0
    route(spark, folder, [], 1)
    route(spark, folder, [(3, None, 1, "view", 1.0, "{}"), (4, at(-500), 1, "view", 1.0, "{}")], 2)
    assert [r["event_id"] for r in late.late_rows(spark, folder, schema).collect()] == [4]
