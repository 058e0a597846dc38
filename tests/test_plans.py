"""Plan-shape checks: pushdown/pruning at the scan, broadcast of bounded
sides, no Cartesian products, no Python UDF nodes in native operators."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["popular_poi_comments", "lexicon_score", "resolve_region", "word_scores",
                                 "tfidf_keywords", "page_links", "latest_per_user", "bigram_scores"])
def test_no_python_udf_no_cartesian(spark, key):
    p = plan(E.queries()[key](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, (key, bad)


def test_scan_is_pruned(spark):
    df = E.queries()["popular_poi_comments"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>" in p


def test_lexicon_is_broadcast(spark):
    df = E.queries()["lexicon_hits"](spark, SF)
    df._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
