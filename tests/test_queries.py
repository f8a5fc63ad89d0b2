"""Every registered query with SQL gives the rows of its SQL; the others run."""

import pytest
from oracle import DATA, rows, sql

from grove import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
# Repositories take many small jobs; tests/test_branches.py does the same on small trees.
ELSEWHERE = {"merge_into", "with_tree_merge", "sync_fetch", "one_commit", "branch_list"}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ELSEWHERE))
def test_query(spark, name):
    columns, found = rows(QUERIES[name](spark, DATA))
    if name in SQL:
        assert (columns, found) == sql(SQL[name])
    else:
        assert columns and sum(found.values()) > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
