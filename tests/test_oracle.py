"""Every registered query at the smallest scale, against its SQL twin where it has one."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import DEFAULT_DIR, compare, duck

needs_data = pytest.mark.skipif(not os.path.isdir(DEFAULT_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(DEFAULT_DIR)


@needs_data
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    rows, problem = compare(spark, con, name, entry.queries()[name], sql, DEFAULT_DIR)
    assert not problem, problem
    assert rows > 0 or name in ("complete_pairs",)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
