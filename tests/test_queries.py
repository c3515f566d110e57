import pytest

from corpusgraph import queries as Q
from tests.compare import assert_same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_its_sql(spark, name):
    assert_same(Q.queries()[name](spark, DIR), DIR, Q.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
