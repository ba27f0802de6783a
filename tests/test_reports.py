"""Every report runs, and equals its SQL in another engine where there is one."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_reports import compare, table_connection


@pytest.fixture(scope="module")
def connection(folder):
    return table_connection(folder)


def test_catalogue():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_report(spark, folder, connection, name):
    frame = queries()[name](spark, folder).toPandas()
    assert len(frame)
    if name in oracle_sql():
        assert compare(frame, connection.execute(oracle_sql()[name]).df()) == ""
