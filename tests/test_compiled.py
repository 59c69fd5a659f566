"""A few registered queries with code generation on, as in production; the other tests run plans interpreted."""

import pytest
from compare import connect, differences

from runlens.registry import ORACLES, QUERIES


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.mark.parametrize("name", ["fit_order_2", "low_pass", "quantiles", "interpolate", "apply_specs", "read_runs", "category_table_time"])
def test_query(spark, small, name):
    assert differences(QUERIES[name](spark, small), connect(small), ORACLES[name]) is None


def test_scratch_tables_can_be_cleared(spark):
    from runlens.plans import scratch

    df = scratch.written(spark.range(5), "gone")
    assert df.count() == 5 and scratch.clear(spark) > 0
    with pytest.raises(Exception, match="(?i)not exist|no such|not found"):
        spark.read.parquet(df.inputFiles()[0]).count()
