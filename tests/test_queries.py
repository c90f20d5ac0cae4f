"""Every named query against its SQL check on the smallest tables."""

import pytest

from check import frame
from tallygrain.plans import load_all
from tallygrain.registry import ORACLES, QUERIES
from tests.conftest import SF
from __spark_entry__ import entry, oracle_sql, queries

load_all()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, duck, key):
    df = QUERIES[key](spark, SF)
    columns, got = frame(df.columns, df.collect())
    cursor = duck.execute(ORACLES[key])
    expected_columns, expected = frame([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == expected_columns
    assert got == expected


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry_is_lazy_and_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["channel_desc", "calendar_month_desc", "country_iso_code", "sales_text", "sales_cents", "level"]
    assert df.count() > 0
