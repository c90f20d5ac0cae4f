"""Streams that keep what they know in files: exact dedup and mergeable state, both compacted.

Each micro-batch leaves its sums per key as a *delta* and the ids it brought as
a *run*. A manifest names the snapshot, the deltas since (the tail), the runs,
and the last batch that is complete. It is written after everything else, as a
new file under the next number, and read from the highest number that is whole;
so a batch that is run again after the manifest changes nothing, and one that
broke off before it is done anew over its own leftovers.

- When the tail is long, it is merged into the next snapshot; a read opens the
  snapshot and the tail.
- Runs of ids lie in buckets by hash, sorted. Runs of one level are merged into
  one of the next when there are several, so their number grows with the
  logarithm of the batches. Every run has a Bloom filter, in blocks of 4 KB; a
  batch asks the filters first, and opens the buckets that may hold one of its
  ids. Ids are remembered for ever, on shared storage; the state store holds
  nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.session import delete_folders
from tallygrain.streaming.events import run_batches

TAIL = 16  # deltas before they are merged into a snapshot
FAN = 8  # runs of a level before they are merged
BITS = 1 << 15  # of a block of a filter
IDS_A_BLOCK = 3000  # about 11 bits an id: one in a hundred unknown ids looks known
PROBES = 4
IDS_A_BUCKET = 1 << 20

EMPTY = {"version": 0, "batch": -1, "snapshot": None, "tail": [], "runs": []}
MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


# --- the manifest


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The newest manifest that is whole."""
    fs, path = _files(spark, folder)
    names = sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
    for name in names:
        lines = spark.read.text(f"{folder}/manifest/{name}", wholetext=True).collect()
        try:
            found = json.loads(lines[0][0])
        except (IndexError, json.JSONDecodeError):  # broken off while it was written
            continue
        return found
    return dict(EMPTY)


def write_manifest(spark: SparkSession, folder: str, manifest: dict) -> None:
    """The next manifest; older ones than the one before go."""
    fs, path = _files(spark, folder)
    fs.mkdirs(path)
    number = manifest["version"] + 1
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = fs.create(Path(f"{folder}/manifest/{number:012d}.json"), True)
    out.write(bytearray(json.dumps(manifest | {"version": number}).encode()))
    out.close()
    for status in fs.listStatus(path):
        if status.getPath().getName() < f"{number - 1:012d}.json":
            fs.delete(status.getPath(), False)


# --- ids seen before


def _block(id_col: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), blocks)


def _bits(id_col: str) -> Column:
    return F.array(*[F.pmod(F.xxhash64(id_col, F.lit(i)), F.lit(BITS)) for i in range(PROBES)])


def _write_run(ids: DataFrame, id_col: str, path: str) -> dict:
    """Ids in buckets, sorted, and their filter; ``ids`` are different and written."""
    n = ids.count()
    blocks, buckets = max(1, math.ceil(n / IDS_A_BLOCK)), max(1, math.ceil(n / IDS_A_BUCKET))
    bucket = F.pmod(F.xxhash64(id_col, F.lit("bucket")), F.lit(buckets))
    placed = ids.select(id_col, bucket.alias("bucket")).repartition(buckets, "bucket").sortWithinPartitions("bucket", id_col)
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ids")
    marked = ids.select(_block(id_col, F.lit(blocks)).alias("block"), F.explode(_bits(id_col)).alias("bit"))
    filters = marked.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filters.write.mode("overwrite").parquet(f"{path}/filter")
    return {"n": n, "blocks": blocks, "buckets": buckets}


def _read_ids(spark: SparkSession, paths: list[str], id_col: str) -> DataFrame:
    # buckets of several runs: no partition column is made of their names
    return spark.read.option("recursiveFileLookup", "true").parquet(*paths).select(id_col)


def _suspects(rows: DataFrame, id_col: str, folder: str, runs: list[dict]) -> DataFrame:
    """id and run of the rows whose id a run's filter knows."""
    spark = rows.sparkSession
    named = F.explode(F.array(*[F.struct(F.lit(r["name"]).alias("run"), F.lit(r["blocks"]).alias("blocks")) for r in runs]))
    asked = rows.select(id_col, named.alias("r")).select(id_col, "r.run", _block(id_col, F.col("r.blocks")).alias("block"))
    filters = [spark.read.parquet(f"{folder}/runs/{r['name']}/filter").withColumn("run", F.lit(r["name"])) for r in runs]
    met = asked.join(reduce(DataFrame.unionByName, filters), ["run", "block"])
    byte = lambda p: F.conv(F.hex(F.substr("bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.forall(_bits(id_col), lambda p: byte(p).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(p, F.lit(8)).cast("int"))) != 0)
    return met.filter(known).select(id_col, "run")


def unseen(rows: DataFrame, id_col: str, folder: str, runs: list[dict]) -> DataFrame:
    """The rows whose id no run holds. Only buckets that may hold one of the ids are opened."""
    if not runs:
        return rows
    spark = rows.sparkSession
    path = f"{folder}/work/suspects"
    _suspects(rows.select(id_col), id_col, folder, runs).write.mode("overwrite").parquet(path)
    suspects = spark.read.parquet(path)
    buckets = {r["name"]: r["buckets"] for r in runs}
    count = F.lit(1)
    for name, n in buckets.items():
        count = F.when(F.col("run") == name, n).otherwise(count)
    bucket = F.pmod(F.xxhash64(id_col, F.lit("bucket")), count)
    wanted = suspects.select("run", bucket.alias("bucket")).distinct().collect()  # no more than there are buckets
    if not wanted:
        return rows
    held = [f"{folder}/runs/{r['run']}/ids/bucket={r['bucket']}" for r in wanted]
    known = _read_ids(spark, held, id_col)
    return rows.join(known.join(suspects.select(id_col).distinct(), id_col, "left_semi"), id_col, "left_anti")


def _merge_runs(spark: SparkSession, folder: str, id_col: str, runs: list[dict], batch_id: int) -> tuple[list[dict], list[str]]:
    """The runs with those of a full level merged into one of the next, and the names of those merged."""
    gone: list[str] = []
    while True:
        levels: dict[int, list[dict]] = {}
        for r in runs:
            levels.setdefault(r["level"], []).append(r)
        full = next((lv for lv, rs in sorted(levels.items()) if len(rs) >= FAN), None)
        if full is None:
            return runs, gone
        parts = levels[full]
        ids = _read_ids(spark, [f"{folder}/runs/{r['name']}/ids" for r in parts], id_col)
        name = f"level{full + 1}-{batch_id}"
        made = _write_run(ids, id_col, f"{folder}/runs/{name}")
        gone += [r["name"] for r in parts]
        runs = [r for r in runs if r not in parts] + [{"name": name, "level": full + 1, **made}]


# --- following a stream


def merged(rows: DataFrame, keys: Sequence[str], merge: Mapping[str, str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[MERGES[how](c).alias(c) for c, how in merge.items()])


def apply_batch(
    batch: DataFrame,
    batch_id: int,
    folder: str,
    build: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    merge: Mapping[str, str],
    id_col: str | None = "event_id",
) -> None:
    """Take one micro-batch in: rows with new ids, summed by ``build``, as a delta; then the manifest."""
    spark = batch.sparkSession
    manifest = read_manifest(spark, folder)
    if batch_id <= manifest["batch"]:  # complete already
        return
    runs, gone = manifest["runs"], []
    if id_col is not None:
        # ids without a value cannot repeat
        rows = f"{folder}/work/rows"
        batch.filter(F.col(id_col).isNull()).unionByName(batch.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])).write.mode(
            "overwrite"
        ).parquet(rows)
        found = spark.read.schema(batch.schema).parquet(rows)
        named, alone = found.filter(F.col(id_col).isNotNull()), found.filter(F.col(id_col).isNull())
        new = f"{folder}/work/new"
        unseen(named, id_col, folder, runs).write.mode("overwrite").parquet(new)
        named = spark.read.schema(batch.schema).parquet(new)
        if not named.isEmpty():
            name = f"batch-{batch_id}"
            made = _write_run(named.select(id_col), id_col, f"{folder}/runs/{name}")
            runs, gone = _merge_runs(spark, folder, id_col, [*runs, {"name": name, "level": 0, **made}], batch_id)
        batch = named.unionByName(alone)
    merged(build(batch), keys, merge).write.mode("overwrite").parquet(f"{folder}/delta/{batch_id}")
    log, old = with_delta(spark, folder, keys, merge, manifest, batch_id)
    write_manifest(spark, folder, manifest | log | {"batch": batch_id, "runs": runs})
    delete_folders(spark, old + [f"{folder}/runs/{name}" for name in gone])


def with_delta(
    spark: SparkSession, folder: str, keys: Sequence[str], merge: Mapping[str, str], manifest: dict, batch_id: int
) -> tuple[dict, list[str]]:
    """The manifest's snapshot and tail with a delta that has been written, and the folders that are needed no more."""
    tail, snapshot = [*manifest["tail"], batch_id], manifest["snapshot"]
    if len(tail) < TAIL:
        return {"tail": tail, "snapshot": snapshot}, []
    state = read_state(spark, folder, keys, merge, manifest | {"tail": tail})
    state.write.mode("overwrite").parquet(f"{folder}/snapshot/{batch_id}")
    return {"tail": [], "snapshot": batch_id}, opened(folder, manifest | {"tail": tail})


def opened(folder: str, manifest: dict) -> list[str]:
    """The folders that a read opens."""
    head = [] if manifest["snapshot"] is None else [f"{folder}/snapshot/{manifest['snapshot']}"]
    return head + [f"{folder}/delta/{t}" for t in manifest["tail"]]


def read_state(
    spark: SparkSession, folder: str, keys: Sequence[str], merge: Mapping[str, str], manifest: dict | None = None
) -> DataFrame | None:
    """Of every key what all batches so far add up to; None before the first batch."""
    paths = opened(folder, read_manifest(spark, folder) if manifest is None else manifest)
    return merged(spark.read.parquet(*paths), keys, merge) if paths else None


def follow(
    stream: DataFrame,
    folder: str,
    build: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    merge: Mapping[str, str],
    id_col: str | None = "event_id",
) -> DataFrame | None:
    """Take in everything that is there and not yet taken, then read the state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, folder, build, keys, merge, id_col)

    run_batches(stream, "append", write, f"{folder}/checkpoint")
    return read_state(stream.sparkSession, folder, keys, merge)
