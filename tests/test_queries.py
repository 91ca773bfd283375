"""Every core query against its SQL, or at least run whole."""

from __future__ import annotations

import pytest

from compare import duck_rows, spark_rows
from hearthdex import plans


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, data, name):
    got = spark_rows(plans.queries()[name](spark, data))
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got[1]
    else:
        assert got == duck_rows(data, sql)


def test_flagship(spark, data):
    assert plans.flagship(spark, data).count() > 0
