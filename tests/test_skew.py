"""One key holding a third of the rows: joins on it are split, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import changes, joins, predicates

# thresholds for tables of a few megabytes
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.shuffle.partitions": "16",
}
N = 120_000


@pytest.fixture()
def tuned(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def facts(tuned):
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    return tuned.range(0, N, 1, 12).select(key.alias("k"), "id", F.md5(F.col("id").cast("string")).alias("v"))


@pytest.fixture()
def dims(tuned):
    return tuned.range(0, 4000, 1, 4).select(F.col("id").alias("k"), F.lit(1).alias("one"))


def final_plan(df):
    rows = df.count()
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def hits(facts):
    return facts.filter("k < 4000").count()


def test_semi_join_splits_the_hot_key(facts, dims):
    rows, plan = final_plan(joins.semi(facts, dims, ["k"]))
    assert rows == hits(facts) and "skew=true" in plan


def test_anti_join_splits_the_hot_key(facts, dims):
    rows, plan = final_plan(changes.apply_delete(facts, dims.filter("k <> 7"), ["k"]))
    assert rows == N - hits(facts) + facts.filter("k = 7").count() and "skew=true" in plan


def test_join_to_an_aggregate_splits_the_hot_key(facts):
    counts = {"n": F.count(F.lit(1))}
    rows, plan = final_plan(joins.with_related(facts, facts.select("k"), ["k"], counts))
    assert rows == N and "skew=true" in plan


def test_left_join_splits_a_hot_right_side(facts, dims):
    orders = dims.select("k")
    rows, plan = final_plan(joins.left_join(orders, facts, ["k"]))
    alone = orders.join(facts, "k", "left_anti").count()
    assert rows == hits(facts) + alone and "skew=true" in plan


def test_counts_per_key_meet_as_single_rows(facts, dims):
    got = {r["k"]: r["n"] for r in predicates.lookup_count(facts, dims, ["k"]).filter("k in (7, 3)").collect()}
    assert got == {7: facts.filter("k = 7").count(), 3: facts.filter("k = 3").count()}
