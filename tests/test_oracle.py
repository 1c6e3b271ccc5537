"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import pytest
from check_oracle import compare, oracle

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SQLS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    ours = queries()[name](spark, SF_DIR).toPandas()
    if name in SQLS:
        assert compare(ours, duck.sql(SQLS[name]).df()) == ""
    else:
        assert len(ours)


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["query_id", "is_anomaly", "confidence", "anomaly_type", "explanation"]
    assert result.count() > 0
