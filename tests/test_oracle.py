"""Every registered query against its SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, QUERIES[name], ORACLE.get(name), FOLDER)
    assert ok, text


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["r", "c", "season", "code1", "b2"] and out.count() > 0
