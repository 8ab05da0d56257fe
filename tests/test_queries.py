"""Every registered query: against its check SQL, or at least to rows, at the small scale."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    took, n, note = compare(spark, con, name, queries()[name], SQL.get(name), SF)
    assert note is None or note == "" or note.startswith(" "), note
