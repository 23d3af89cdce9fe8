"""The training-data queries that SQL can express."""

import pytest

from checks.compare import connect, differences
from spanwise.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    assert differences(name, spark, SMALL, connect(SMALL), QUERIES, SQL) == []
