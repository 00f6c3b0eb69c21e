"""Every registered query of the engine equals its SQL."""

import pytest

import oracle
from assetspark.queries import ORACLES, QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, con, name):
    found = oracle.rows_of_frame(QUERIES[name](spark, sf_dir))
    assert found == oracle.rows_of_sql(con, ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
