import pytest

from pipelens.queries import QUERIES, SQL
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"est_grid_search", "tf_hashing_murmur"}))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() == 5 and "relative_ratio_change" in out.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
