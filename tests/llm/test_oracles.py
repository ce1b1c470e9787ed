import pytest

from quillstack.llm import queries

from ..oracle import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(spark, tables(SF), queries.queries()[name], queries.oracle_sql()[name], SF) == ""
