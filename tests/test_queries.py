"""Every registered point query: against its SQL, or at least with rows of a schema."""

import oracle
import pytest

from pointloom import catalog


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLES:
        assert oracle.differences(df, con, catalog.ORACLES[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
