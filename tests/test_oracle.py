"""Every registered query against its SQL on the smallest sample."""

import re

import __spark_entry__ as entry_module
import pytest
from harness import differences, duck

SF = "/root/testdata/sf0.001"
#: The training-data queries have tests of their own.
QUERIES = {n: q for n, q in entry_module.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}
SQL = {n: q for n, q in entry_module.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) is None
