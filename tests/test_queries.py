import pytest

from rasterloom.plans import catalog

from .sqlcheck import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    assert not differences(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], con)
