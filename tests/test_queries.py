"""Each query against its SQL."""

import pytest
from rows import same_rows

from tidemark.oracle import ORACLE_SQL
from tidemark.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 21
