"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# What the library expects of a session. On a cluster these belong in
# spark-defaults; shuffle partitions there should be sized so that one
# partition stays near 200 MB (AQE merges the small ones).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def build_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tallygrain") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for data that must outlive one job.

    It lies under the shared folder the cluster names in
    ``spark.checkpoint.dir`` and is deleted when the process ends. Only a local session may fall back to a
    temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base(spark.sparkContext.applicationId)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    _FOLDERS.append(path)
    return path


# what this process has put into the work folder
_FOLDERS: list[str] = []


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in whatever store they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@atexit.register
def clear_work() -> None:
    """At the end of the process its intermediate results go, if the session still lives."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _FOLDERS:
        delete_folders(spark, _FOLDERS)
        _FOLDERS.clear()


@cache
def _local_base(application: str) -> str:
    return tempfile.mkdtemp(prefix="tallygrain-")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from the files.

    For results used more than once (lineage is cut, nothing is computed
    twice) and for short lists (the planner learns their true size, and
    broadcasts them only if that is below its threshold).
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
