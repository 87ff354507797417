from __future__ import annotations

import pytest
from comparing import same

from landcube.plans.queries import QUERIES
from landcube.plans.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, SF, QUERIES[name], SQL[name])


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) == set(SQL)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
