"""Line lists, delimited files, JSON documents, run results, published events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallygrain.functions.scalars import iso_minute


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A one-value-per-line list; blank lines are skipped."""
    return spark.read.text(path).filter(F.trim("value") != "")


def read_delimited(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",") -> DataFrame:
    """Separated lines with a declared schema; a malformed line stops the read."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "FAILFAST").csv(path)


def read_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON collection, one document per line, with a declared nested schema."""
    return spark.read.schema(schema).json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, null fields kept."""
    df.write.option("ignoreNullFields", "false").json(path)


# fixed values: field names of a run-result document
RUN_SCHEMA = """Results struct<Overview: struct<BenchmarkName: string, TimeOfRun: string,
    AverageTransactionsPerSecond: string, TotalCompletedTransactions: string, TotalFailedTransactions: string>>"""


def read_runs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Run-result documents, JSON or XML, as one row per run."""
    overview = spark.read
    if fmt == "xml":
        fields = RUN_SCHEMA.split("Results struct<", 1)[1].rstrip().removesuffix(">")
        overview = overview.format("xml").option("rowTag", "Results").schema(fields.replace("Overview:", "Overview", 1))
        nested = overview.load(path).select("Overview.*")
    else:
        nested = overview.schema(RUN_SCHEMA).json(path).select("Results.Overview.*")
    return nested.select(
        F.col("BenchmarkName").alias("benchmark_name"),
        F.col("TimeOfRun").alias("time_of_run"),
        F.col("AverageTransactionsPerSecond").cast("double").alias("average_tps"),
        F.col("TotalCompletedTransactions").cast("long").alias("completed"),
        F.col("TotalFailedTransactions").cast("long").alias("failed"),
    )


def interaction_events(events: DataFrame) -> DataFrame:
    """Event rows as interaction messages (one JSON text each); the time is cut to its UTC minute."""
    # fixed values: field names of an interaction message
    message = F.struct(
        F.col("event_id").alias("EventId"),
        F.col("event_type").alias("EventType"),
        iso_minute(F.col("ts").cast("timestamp")).alias("TimeStamp"),
        F.col("user_id").alias("CustomerID"),
        F.get_json_object("props", "$.k").cast("long").alias("DeviceID"),
        F.lit(None).cast("double").alias("LocationLatitude"),
        F.lit(None).cast("double").alias("LocationLongtitude"),
    )
    return events.select(F.to_json(message, {"ignoreNullFields": "false"}).alias("value"))


def publish_events(events: DataFrame, path: str) -> None:
    """Publish interaction messages to a folder that a stream can follow."""
    interaction_events(events).write.mode("append").text(path)


def publish_stream(events: DataFrame, path: str, checkpoint: str) -> None:
    """Publish the messages of an event stream as they come, each once; stops when nothing more is there."""
    query = (
        interaction_events(events)
        .writeStream.format("text")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
