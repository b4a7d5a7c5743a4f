"""Every registered query against its SQL in DuckDB."""

import pytest
from oracle import both, connect

import __spark_entry__ as entry
from tableflow.plans.oracles import ORACLES as SQL
from tableflow.plans.queries import QUERIES



@pytest.fixture(scope="module")
def duck(small):
    con = connect(small)
    yield con
    con.close()


def test_every_query_has_sql_and_the_other_way_round():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    (ours_cols, ours), (sql_cols, theirs) = both(spark, duck, QUERIES[name], SQL[name], small)
    assert ours_cols == sql_cols
    assert ours == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
