"""Every query with SQL gives its rows; the others run."""

import pytest

from newsloom import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF) > 0
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
