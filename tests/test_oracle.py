"""Every registered query against its SQL."""

import pytest
from compare import compare, duck
from conftest import SF

import __spark_entry__ as entry
from tracemill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
