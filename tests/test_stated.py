"""Operators that no given table can feed, on small inputs: the rows that must come out are stated beside each."""

import oracle
import pytest

from tests import stated_pages, stated_rows, stated_text

CASES = stated_text.QUERIES | stated_rows.QUERIES | stated_pages.QUERIES
ROWS = stated_text.SQL | stated_rows.SQL | stated_pages.SQL


@pytest.mark.parametrize("name", sorted(CASES))
def test_stated_rows(spark, sf, name):
    got, want = oracle.compare(spark, name, sf, CASES, ROWS)
    assert got == want


def test_no_registered_query_is_one_of_these():
    import __spark_entry__

    assert not set(CASES) & set(__spark_entry__.queries())
