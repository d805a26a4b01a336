import pytest

from tesserae.plans.catalog import ORACLE_SQL, QUERIES

from .conftest import SF
from .oracle import assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_rebuilt_ranges_equal_the_files(spark):
    out = QUERIES["reconstruct_bytes_equal"](spark, SF)
    assert out.count() > 0 and out.where("equal is null or not equal").isEmpty()


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
