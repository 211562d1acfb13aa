"""Every corpus query that SQL can express, against that SQL."""

import pytest

from paddock.llm import queries as Q
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, name, Q.QUERIES[name], Q.ORACLES[name], SF)
