import math

from pyspark.sql import functions as F

from check import frame
from tallygrain.llm import mixing
from tests.conftest import SF
from tests.llm.conftest import LONG, ODD


def test_matches_sql(spark, duck):
    df = mixing.op7_poisson_mix(spark, SF)
    cursor = duck.execute(mixing._check_sql())
    assert frame(df.columns, df.collect()) == frame([d[0] for d in cursor.description], cursor.fetchall())


def test_copies_follow_a_poisson_distribution(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'x' as text", "if(id % 4 = 0, 'a', 'b') as source")
    # a has a quarter of the bytes and three quarters of the weight: rates 6 and 2/3
    mixed = mixing.poisson_mix(df, {"a": 3.0, "b": 1.0}, epochs=2.0)
    drawn = df.join(mixed.groupBy("doc_id").agg(F.max("n_copies").alias("k"), F.count("*").alias("n")), "doc_id", "left").fillna(0)
    assert drawn.filter("k != n").count() == 0
    for source, mean in (("a", 6.0), ("b", 2 / 3)):
        part = drawn.filter(F.col("source") == source)
        n = part.count()
        got = {r["k"]: r["count"] for r in part.groupBy("k").count().collect()}
        for k in range(8):
            want = n * math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            assert abs(got.get(k, 0) - want) < 5 * math.sqrt(want + 1)


def test_large_rates_are_split(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'x' as text", "'a' as source")
    mixed = mixing.poisson_mix(df, epochs=50.0).groupBy("doc_id").count()
    mean, spread = mixed.agg(F.avg("count"), F.variance("count")).first()
    assert abs(mean - 50) < 1 and abs(spread - 50) < 8


def test_order_is_global_and_repeats(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    keys = [r["order_key"] for r in mixing.poisson_mix(df).collect()]
    assert keys == sorted(keys)
    assert keys == [r["order_key"] for r in mixing.poisson_mix(df.repartition(5)).collect()]
    assert keys != [r["order_key"] for r in mixing.poisson_mix(df, seed=1).collect()]


def test_odd_rows(documents):
    rows = [(i, t, "en", "a") for i, t in enumerate(ODD)] + [(50, LONG, None, None), (51, None, "en", "empty"), (None, "z", "en", "b"), (3, "a", "en", "b"), (3, "a", "en", "b")]
    df = documents(rows, clashing=True).withColumn("rate", F.lit("x"))
    mixed = mixing.poisson_mix(df, {"a": 1.0}, epochs=30.0)
    assert {*mixed.columns} == {*df.columns, "n_copies", "copy", "order_key"}
    got = mixed.collect()
    assert any(r["source"] is None for r in got) and not any(r["source"] == "empty" for r in got)
    twice = [r["copy"] for r in got if r["doc_id"] == 3 and r["source"] == "b"]
    assert sorted(twice) == sorted([*range(1, len(twice) // 2 + 1)] * 2)
    assert mixing.poisson_mix(df.limit(0)).count() == 0
