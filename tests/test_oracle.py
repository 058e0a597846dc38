"""Every registered query against its DuckDB oracle (the driver's check,
run here on the smallest scale factor)."""

import os

import pytest

import __spark_entry__ as E
from roamlens import plans
from roamlens.plans.compare import compare, duck

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90
    df = E.entry(spark)
    assert df.columns == ["scene_spot_name", "poi_id", "order_key", "line_no", "comment_time", "comment_star"]
    assert df.count() >= 0


@pytest.mark.parametrize("key", sorted(plans.oracle_sql()))
def test_oracle(spark, con, key):
    r = compare(E.queries()[key](spark, SF), con, E.oracle_sql()[key])
    assert r["columns_match"], r
    assert r["match"], r


@pytest.mark.parametrize("key", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows_only(spark, key):
    assert E.queries()[key](spark, SF).count() > 0
