"""Analysis of benchmark runs: lists, overviews, comparison and trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.operators.windows import pct_change


def run_overview(tx: DataFrame) -> DataFrame:
    """Per run: completed and failed transactions, seconds, average rate and the busiest minute.

    ``tx`` holds ``run_day, ts, failed``. Counted per minute first, so each
    run is at most its minutes when runs are summed up.
    """
    per_minute = tx.groupBy("run_day", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("failed").alias("failed"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    runs = per_minute.groupBy("run_day").agg(
        F.sum("n").alias("total"),
        F.sum("failed").alias("failed"),
        F.max("n").alias("max_per_minute"),
        ((F.unix_micros(F.max("last").cast("timestamp")) - F.unix_micros(F.min("first").cast("timestamp"))) / 1_000_000).alias("seconds"),
    )
    completed = F.col("total") - F.col("failed")
    return runs.withColumn("completed", completed).withColumn(
        "average_tps", F.round(completed / F.nullif(F.col("seconds"), F.lit(0.0)), 6)
    )


def run_list(overview: DataFrame) -> DataFrame:
    """Runs, newest first."""
    return overview.orderBy(F.desc("run_day"))


def run_compare(overview: DataFrame, metrics: Sequence[str], runs: Sequence[str]) -> DataFrame:
    """Metric × run table of the chosen runs."""
    chosen = overview.withColumn("run", F.col("run_day").cast("string")).filter(F.col("run").isin(*runs))
    doubles = chosen.select("run", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = doubles.unpivot(["run"], list(metrics), "metric", "value")
    return long.groupBy("metric").pivot("run", list(runs)).agg(F.first("value"))


def run_trend(runs: DataFrame, order: str, rate: str) -> DataFrame:
    """Rate change from each run to the next; one row per run."""
    return pct_change(runs, order, rate, "change_pct")
