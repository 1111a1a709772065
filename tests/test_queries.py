"""Every registered query with SQL gives the SQL's rows."""

from __future__ import annotations

import pytest

from parleyworks.jobs.queries import ORACLE_SQL, QUERIES

from .oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, small, name):
    assert differences(QUERIES[name](spark, small), ORACLE_SQL[name], small) == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
