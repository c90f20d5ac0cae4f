"""SQL functions for use in queries. Spark inlines their bodies; no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_functions(spark: SparkSession) -> None:
    """Scalar and array functions over counter texts."""
    spark.sql(
        """create or replace temporary function counters(info string) returns array<int>
           return transform(split(info, ','), c -> cast(c as int))"""
    )
    spark.sql(
        """create or replace temporary function dml_total(info string) returns bigint
           return aggregate(slice(counters(info), 1, 6), 0L, (total, c) -> total + c)"""
    )


def register_offers(spark: SparkSession, offers: DataFrame) -> None:
    """Table function ``offers_for(customer_id)`` over an offers table."""
    offers.createOrReplaceTempView("offer_rows")
    spark.sql(
        """create or replace temporary function offers_for(wanted bigint)
           returns table (offer_no bigint, offer string)
           return select offer_no, offer from offer_rows where customer_id = wanted"""
    )
