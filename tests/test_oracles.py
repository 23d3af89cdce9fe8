"""Every registered query against its reference SQL."""

import pytest

from __spark_entry__ import queries
from checks.compare import connect, differences
from checks.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    assert differences(name, spark, SMALL, database, QUERIES, SQL) == []
