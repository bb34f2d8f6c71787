"""Every query of the catalogue with SQL, against that SQL."""

import oracle
import pytest
from docloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, name):
    got, want = oracle.compare(spark, name, sf, catalogue.QUERIES, catalogue.SQL)
    assert got == want


def test_entry_imports_without_extras(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
