"""Every registered query against its SQL statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    rows, verdict = compare(spark, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict in ("ok", "no sql")
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
