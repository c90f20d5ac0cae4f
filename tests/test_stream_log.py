"""Streams that keep ids and state in files: exact, bounded, and unchanged by batches run twice or broken off."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tallygrain.session import work_folder
from tallygrain.streaming import events as ev
from tallygrain.streaming import log
from tests.test_streaming import add_file, at, event

MERGE = {"initial_access": "min", "last_access": "max", "access_count": "sum"}
KEYS = ["user_id", "device_id"]


@pytest.fixture()
def folder(spark):
    return work_folder(spark, "log-test")


@pytest.fixture()
def small(monkeypatch):
    """Several ids a block and bucket, and runs and deltas that are merged soon."""
    for name, value in {"TAIL": 4, "FAN": 3, "IDS_A_BLOCK": 20, "IDS_A_BUCKET": 30}.items():
        monkeypatch.setattr(log, name, value)


def take(spark, folder, rows, batch_id, build=ev.device_state, keys=KEYS, merge=MERGE):
    batch = spark.createDataFrame(rows, ev.EVENT_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    log.apply_batch(batch, batch_id, folder, build, keys, merge)


def state(spark, folder):
    got = log.read_state(spark, folder, KEYS, MERGE)
    return {} if got is None else {(r["user_id"], r["device_id"]): (r["initial_access"], r["last_access"], r["access_count"]) for r in got.collect()}


def plain(rows):
    out, seen = {}, set()
    for i, ts, user, _, _, props in rows:
        if i is not None and i in seen:
            continue
        seen.add(i)
        key = (user, int(props[6:-1]))
        low, high, n = out.get(key, (ts, ts, 0))
        out[key] = (min(low, ts), max(high, ts), n + 1)
    return out


def batches(count, size=40):
    """Batches with repeats of any age, among themselves and within, and events twelve years apart."""
    rng, past, out = random.Random(5), [], []
    for b in range(count):
        rows = []
        for i in range(size):
            if past and rng.random() < 0.3:
                rows.append(rng.choice(past))
            else:
                year = 2012 if rng.random() < 0.2 else 2024
                ts = dt.datetime(year, 1, 1) + dt.timedelta(minutes=rng.randrange(100_000))
                rows.append((b * 1000 + i, ts, rng.randrange(4), "view", 1.0, f'{{"k": {rng.randrange(3)}}}'))
        rows += rows[:3] + [(None, at(b), 1, "view", 1.0, '{"k": 0}')] * 2
        past += [r for r in rows if r[0] is not None]
        out.append(rows)
    return out


def test_ids_of_any_age_count_once_and_state_stays_small(spark, folder, small):
    given = batches(20)
    for b, rows in enumerate(given):
        take(spark, folder, rows, b)
        manifest = log.read_manifest(spark, folder)
        assert manifest["batch"] == b and len(manifest["tail"]) < log.TAIL
        levels = [r["level"] for r in manifest["runs"]]
        assert all(levels.count(x) < log.FAN for x in levels)
        if b % 5 == 4:
            assert state(spark, folder) == plain([r for rows in given[: b + 1] for r in rows])
    assert len(manifest["runs"]) <= 2 * 3 and sum(r["n"] for r in manifest["runs"]) == len({r[0] for x in given for r in x} - {None})
    # what was merged is gone
    assert sorted(os.listdir(f"{folder}/runs")) == sorted(r["name"] for r in manifest["runs"])
    assert sorted(os.listdir(f"{folder}/delta")) == sorted(map(str, manifest["tail"]))
    assert os.listdir(f"{folder}/snapshot") == [str(manifest["snapshot"])] and len(os.listdir(f"{folder}/manifest")) <= 4


def test_a_read_opens_the_snapshot_and_the_tail(spark, folder):
    # 100 batches of one increment each, without ids
    merge = {"n": "sum"}
    for b in range(100):
        batch = spark.range(1).select(F.lit(b % 3).alias("k"), F.lit(1).cast("long").alias("n"))
        log.apply_batch(batch, b, folder, lambda df: df, ["k"], merge, id_col=None)
    manifest = log.read_manifest(spark, folder)
    assert manifest["snapshot"] == 95 and manifest["tail"] == [96, 97, 98, 99]
    assert len(log.opened(folder, manifest)) == 5
    got = log.read_state(spark, folder, ["k"], merge)
    assert {r["k"]: r["n"] for r in got.collect()} == {0: 34, 1: 33, 2: 33}
    files = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert files == {"95", "96", "97", "98", "99"}


def test_repeated_and_broken_off_batches_change_nothing(spark, folder, small, monkeypatch):
    given = batches(9)
    write = log.write_manifest

    def broken(*_):
        raise RuntimeError("the driver is lost")

    for b, rows in enumerate(given):
        # lost between the data and the manifest, with whatever was merged by then
        monkeypatch.setattr(log, "write_manifest", broken)
        with pytest.raises(RuntimeError):
            take(spark, folder, rows, b)
        monkeypatch.setattr(log, "write_manifest", write)
        assert state(spark, folder) == plain([r for x in given[:b] for r in x])
        take(spark, folder, rows, b)
        take(spark, folder, rows, b)  # again, after it was complete
        take(spark, folder, given[0], 0)
    assert state(spark, folder) == plain([r for rows in given for r in rows])


def test_a_manifest_that_broke_off_is_passed_over(spark, folder):
    take(spark, folder, [event(1, 0), event(2, 1)], 0)
    before = log.read_manifest(spark, folder)
    with open(f"{folder}/manifest/{before['version'] + 1:012d}.json", "w") as f:
        f.write('{"version": 2, "ba')
    assert log.read_manifest(spark, folder) == before
    take(spark, folder, [event(2, 1), event(3, 2)], 1)
    assert state(spark, folder) == {(1, 5): (at(0), at(2), 3)}


def test_filters_are_asked_before_a_run_is_read(spark, folder, small):
    rows = spark.range(0, 4000, 2).select(F.col("id").alias("event_id"))
    made = log._write_run(rows, "event_id", f"{folder}/runs/a")
    runs = [{"name": "a", "level": 0, **made}]
    assert made["blocks"] == 100 and made["buckets"] > 50
    # every id that is there is known to the filter; few of the others are
    known = log._suspects(rows, "event_id", folder, runs)
    assert known.count() == 2000
    others = spark.range(1, 4000, 2).select(F.col("id").alias("event_id"))
    assert log._suspects(others, "event_id", folder, runs).count() < 20
    fresh = log.unseen(spark.createDataFrame([(10,), (11,), (4000,)], "event_id long"), "event_id", folder, runs)
    files = [f for f in fresh.inputFiles() if "/ids/" in f]
    assert sorted(r[0] for r in fresh.collect()) == [11, 4000] and 0 < len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 2


def test_the_stream_goes_on_from_its_checkpoint(spark, folder):
    def follow():
        stream = ev.open_stream(spark, f"{folder}/in", files_per_trigger=1)
        return log.follow(stream, folder, ev.device_state, KEYS, MERGE)

    given = batches(6, 15)
    for rows in given[:4]:
        add_file(spark, f"{folder}/in", rows)
    follow()
    for rows in given[4:]:
        add_file(spark, f"{folder}/in", rows)
    follow()
    assert state(spark, folder) == plain([r for rows in given for r in rows])
    assert follow() is not None and state(spark, folder) == plain([r for rows in given for r in rows])
    # nothing in a state store
    assert "state" not in os.listdir(f"{folder}/checkpoint")


def test_nothing_to_follow(spark, folder):
    assert log.read_state(spark, folder, KEYS, MERGE) is None
    take(spark, folder, [], 0)
    assert state(spark, folder) == {}


@pytest.mark.parametrize("block", [60, 100, 3600])
def test_trailing_minute_equals_brute_force(spark, table, monkeypatch, block):
    monkeypatch.setattr(ev, "PANE_BLOCK", block)
    rng = random.Random(1)
    stamps = [(k, at(0) + dt.timedelta(seconds=rng.randrange(2000))) for k in ("a", "a", "b") for _ in range(300)]
    counts = {}
    for k, ts in stamps:
        counts[k, ts] = counts.get((k, ts), 0) + 1
    df = table([(k, ts, n) for (k, ts), n in counts.items()], "k string, second timestamp, tps long")
    got = ev.trailing(df, ["k"], "second", "tps", 60, "tpm")
    assert got.columns == ["k", "second", "tps", "tpm"]
    want = {(k, ts): sum(n for (j, t), n in counts.items() if j == k and 0 <= (ts - t).total_seconds() < 60) for k, ts in counts}
    assert {(r["k"], r["second"]): r["tpm"] for r in got.collect()} == want


def test_last_hour_ends_with_the_newest_bucket(spark):
    rows = [(i, at(7 * i), 1, "view", 1.0, "{}") for i in range(30)]
    buckets = ev.activity(spark.createDataFrame(rows, ev.EVENT_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")), "user_id")
    kept = sorted(r["w"]["start"] for r in ev.last_hour(buckets).collect())
    newest = at(200)  # the bucket of minute 203
    assert kept[-1] == newest and all(newest - dt.timedelta(hours=1) < k for k in kept) and len(kept) == 9
