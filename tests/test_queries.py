import pytest

from quillstack import plans

from .oracle import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, connection, name):
    assert compare(spark, connection, plans.queries()[name], plans.oracle_sql()[name], SF) == ""
