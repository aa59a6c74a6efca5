import pytest

from tests.oracle import connect, spark_rows, sql_rows
from threadmill.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf))
    if name in ORACLES:
        assert (columns, rows) == sql_rows(con, ORACLES[name])
    elif name != "p5_found":
        assert rows
