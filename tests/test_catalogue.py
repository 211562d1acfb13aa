"""Every registered query against its SQL; those without SQL run and give rows."""

import pytest

from paddock.plans import catalogue
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.ORACLES:
        assert_same(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    else:
        frame = catalogue.QUERIES[name](spark, SF)
        assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)
