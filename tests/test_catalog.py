import os

import pytest

from tests.oracle import DATA, assert_same
from verdict.plans.catalog import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
