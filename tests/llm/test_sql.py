import pytest

from millrace.llm import queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name])
