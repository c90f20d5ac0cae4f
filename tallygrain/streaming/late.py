"""Late rows as a side output: rows behind the watermark are stored, and can be replayed.

A window is closed once the watermark, the newest event of all earlier batches
less a delay, has reached its end; a row of a closed window is late. Each
micro-batch is parted by that rule: late rows are written under the batch's
number, the others are summed into the state (``streaming/log.py``). The
manifest holds the newest event time with everything else, so a batch that is
run again after a lost driver meets the watermark it met before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.session import delete_folders
from tallygrain.streaming import log
from tallygrain.streaming.events import run_batches


def window_end(at: str, width: int) -> Column:
    """End of the window of ``width`` microseconds that holds the time ``at``, in microseconds."""
    micros = F.unix_micros(at)
    return micros - F.pmod(micros, F.lit(width)) + width


def route_batch(
    batch: DataFrame,
    batch_id: int,
    folder: str,
    at: str,
    width: int,
    delay: int,
    build: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    merge: Mapping[str, str],
) -> None:
    """Late rows of one micro-batch to their folder, the others into the state, then the manifest. Times in microseconds."""
    spark = batch.sparkSession
    manifest = log.read_manifest(spark, folder)
    if batch_id <= manifest["batch"]:
        return
    newest, late = manifest.get("newest"), manifest.get("late", [])
    closed = F.lit(False) if newest is None else window_end(at, width) <= newest - delay
    # a row without a time is in no window and never late
    closed = F.coalesce(closed, F.lit(False))
    path = f"{folder}/late/{batch_id}"
    batch.filter(closed).write.mode("overwrite").parquet(path)
    if not spark.read.schema(batch.schema).parquet(path).isEmpty():
        late = [*late, batch_id]
    log.merged(build(batch.filter(~closed)), keys, merge).write.mode("overwrite").parquet(f"{folder}/delta/{batch_id}")
    last = batch.agg(F.max(F.unix_micros(at))).first()[0]
    newest = max((x for x in (newest, last) if x is not None), default=None)
    state, old = log.with_delta(spark, folder, keys, merge, manifest, batch_id)
    log.write_manifest(spark, folder, manifest | state | {"batch": batch_id, "newest": newest, "late": late})
    delete_folders(spark, old)


def follow_late(
    stream: DataFrame,
    folder: str,
    at: str,
    width: int,
    delay: int,
    build: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    merge: Mapping[str, str],
) -> None:
    """Take in everything that is there and not yet taken."""

    def write(batch: DataFrame, batch_id: int) -> None:
        route_batch(batch, batch_id, folder, at, width, delay, build, keys, merge)

    run_batches(stream, "append", write, f"{folder}/checkpoint")


def late_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows that came behind the watermark, whole, with the batch they came in."""
    late = log.read_manifest(spark, folder).get("late", [])
    if not late:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    found = [spark.read.schema(schema).parquet(f"{folder}/late/{b}").withColumn("batch", F.lit(b).cast("long")) for b in late]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def replayed(
    spark: SparkSession,
    folder: str,
    schema,
    build: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    merge: Mapping[str, str],
) -> DataFrame:
    """The state with the late rows added: what it would be had they come in time."""
    state = log.read_state(spark, folder, keys, merge)
    added = build(late_rows(spark, folder, schema).drop("batch"))
    return log.merged(added if state is None else state.unionByName(added), keys, merge)
