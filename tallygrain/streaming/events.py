"""Event streams: deduplication, rates, keyed state, late rows, change feeds.

Streams write each micro-batch to its own folder and overwrite it when the
batch is run again, so a lost executor or a restarted query leaves one copy.
State lies in RocksDB (``session.SETTINGS``), on disk beside the executors'
memory, and a trigger takes a bounded number of files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tallygrain.session import work_folder
from tallygrain.sources.schemas import SCHEMAS

EVENT_SCHEMA = SCHEMAS["events"]
FILES_PER_TRIGGER = 200


def read_events(
    spark: SparkSession, path: str, delay: str | None = None, files_per_trigger: int | None = FILES_PER_TRIGGER
) -> DataFrame:
    """Interaction events as a stream without repeated event ids."""
    return dedupe(open_stream(spark, path, files_per_trigger), delay)


def open_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern the path may name a single file as well as a folder
    pattern = f"{path[:-1]}[{path[-1]}]"
    # event time must be a zoned timestamp; the session zone is UTC
    return reader.parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def dedupe(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event id once.

    Without a ``delay`` every id is remembered and no event is dropped for its
    age. With one, ids are forgotten once the watermark has passed them, and
    events that come later than that are dropped.
    """
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def cents(column: str = "value"):
    return F.round(F.col(column) * 100).cast("long")


def throughput(stream: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events per window and type; with ``slide`` the windows overlap (a trailing rate)."""
    return stream.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def panes(stream: DataFrame) -> DataFrame:
    """Events per second and type: what rates over any longer span are added up from."""
    return stream.groupBy(F.date_trunc("second", "ts").alias("second"), "event_type").agg(F.count(F.lit(1)).alias("tps"))


PANE_BLOCK = 3600  # seconds of a type that are added up in one task


def trailing(counted: DataFrame, keys: Sequence[str], at: str, value: str, seconds: int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the ``seconds`` that end with a row's own, a row a key and second.

    Seconds are cut into blocks; the last ones of a block also go to the next
    block, which looks back at them. So a pane is copied once at most, and no
    task holds all seconds of a key.
    """
    width = max(seconds, PANE_BLOCK)
    place = F.unix_timestamp(at)
    block = F.floor(place / width)
    own = F.struct(block.alias("_block"), F.lit(False).alias("_guest"))
    onward = F.struct((block + 1).alias("_block"), F.lit(True).alias("_guest"))
    near = F.pmod(place, F.lit(width)) > width - seconds
    rows = counted.select("*", place.alias("_s"), F.inline(F.when(near, F.array(own, onward)).otherwise(F.array(own))))
    span = W.partitionBy(*keys, "_block").orderBy("_s").rangeBetween(-(seconds - 1), 0)
    return rows.withColumn(out, F.sum(value).over(span)).filter(~F.col("_guest")).drop("_s", "_block", "_guest")


def last_hour(buckets: DataFrame, hours: int = 1) -> DataFrame:
    """The buckets of the hour that ends with the newest bucket."""
    newest = buckets.agg(F.max("w.start")).scalar()
    return buckets.filter(F.col("w.start") > newest - F.expr(f"interval {hours} hours"))


def activity(stream: DataFrame, key, width: str = "5 minutes") -> DataFrame:
    """Value and count per key and bucket (half-open)."""
    return stream.groupBy(F.window("ts", width).alias("w"), key).agg(
        F.sum(cents()).alias("cents"), F.count(F.lit(1)).alias("n")
    )


def device_state(stream: DataFrame) -> DataFrame:
    """First access, last access and access count per customer and device."""
    device = F.get_json_object("props", "$.k").cast("long").alias("device_id")
    return stream.groupBy("user_id", device).agg(
        F.min("ts").alias("initial_access"), F.max("ts").alias("last_access"), F.count(F.lit(1)).alias("access_count")
    )


def login_state(stream: DataFrame) -> DataFrame:
    """Last login, failed logins and last failed login per account."""
    ok = F.col("event_type").isin("signup", "view")
    bad = F.col("event_type") == "error"
    return stream.filter(ok | bad).groupBy("user_id").agg(
        F.max(F.when(ok, F.col("ts"))).alias("last_login"),
        F.count(F.when(bad, 1)).alias("failed_logins"),
        F.max(F.when(bad, F.col("ts"))).alias("last_failed_login"),
    )


def run_batches(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available, micro-batch by micro-batch, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a repeated batch replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def materialise(stream: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Run the stream over what is there and return the last state of every key."""
    spark = stream.sparkSession
    folder = work_folder(spark, "stream")
    run_batches(stream, mode, batch_writer(f"{folder}/out"), f"{folder}/checkpoint")
    return last_state(spark.read.parquet(f"{folder}/out"), keys)


def last_state(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of every key the row its latest micro-batch wrote."""
    rest = [c for c in written.columns if c not in (*keys, "batch_id")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_s"))
    return last.select(*keys, "_s.*")


def late_report(waves: Sequence[DataFrame], delay: str, width: str) -> DataFrame:
    """Per event type, how many rows were counted in windows and how many came behind the watermark.

    The waves arrive one after the other; the stream stops between them and
    goes on from its checkpoint. What no window counted was late.
    """
    spark = waves[0].sparkSession
    folder = work_folder(spark, "late")
    received: DataFrame | None = None
    for wave in waves:
        wave.write.mode("append").parquet(f"{folder}/in")
        windows = throughput(open_stream(spark, f"{folder}/in").withWatermark("ts", delay), width)
        run_batches(windows, "update", batch_writer(f"{folder}/out"), f"{folder}/checkpoint")
        received = wave if received is None else received.unionByName(wave)
    counted = last_state(spark.read.parquet(f"{folder}/out"), ["w", "event_type"])
    kept = counted.groupBy("event_type").agg(F.sum("n").alias("kept"))
    arrived = received.groupBy("event_type").agg(F.count(F.lit(1)).alias("received"))
    nothing = F.lit(0).cast("long")
    return arrived.join(kept, "event_type", "left").select(
        "event_type", "received", F.coalesce("kept", nothing).alias("kept"),
        (F.col("received") - F.coalesce("kept", nothing)).alias("late"),
    )


def apply_feed(stream: DataFrame, keys: Sequence[str], columns: Sequence[str], path: str, checkpoint: str) -> None:
    """Follow a feed of increments: each micro-batch leaves its sums per key under ``path``.

    Nothing is rewritten per batch; ``feed_state`` adds the sums to the base table when it is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
        sums.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(stream, "append", write, checkpoint)


def feed_state(base: DataFrame, keys: Sequence[str], columns: Sequence[str], path: str) -> DataFrame:
    """The base table with every applied batch added."""
    from tallygrain.operators.changes import apply_increment

    try:
        deltas = base.sparkSession.read.parquet(path)
    except AnalysisException:  # no batch yet
        return base
    return apply_increment(base, deltas.select(*keys, *columns), keys, columns)
