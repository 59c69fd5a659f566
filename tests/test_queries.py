"""Every registered query with SQL twin against DuckDB on the smallest tables."""

import pytest
from compare import connect, differences

from runlens.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0
