import pytest
from compare import rows_of, rows_of_sql

from weftline import more_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    names, rows = rows_of(queries.QUERIES[name](spark, SF))
    if name in queries.SQL:
        assert (names, rows) == rows_of_sql(queries.SQL[name], SF)
    else:
        assert rows
