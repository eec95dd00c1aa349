import pytest

import __spark_entry__
from quern.queries import ORACLE, QUERIES
from tests.against_sql import SF, check, database


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    check(spark, QUERIES[name], ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_twice_alike(spark, name):
    once, again = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert once == again


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
