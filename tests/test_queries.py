"""Every query of the core against its SQL."""

import pytest

from facetcube.operators import fact_queries
from facetcube.plans import cube_queries
from tests.oracle import SF, database, same

ALL = {**fact_queries.QUERIES, **cube_queries.QUERIES}
SQL = {**fact_queries.SQL, **cube_queries.SQL}


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, con, name):
    same(ALL[name](spark, SF), SQL[name], con)


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


def test_entry_adds_optional_modules_only_if_there():
    import __spark_entry__ as e

    assert set(ALL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
