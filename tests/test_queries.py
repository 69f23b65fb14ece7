"""Registered queries: SQL twins, plans and the entry points."""

import re
import sys

import pytest

import compare
from queries.registry import REGISTRY

SF = "/root/testdata/sf0.001"

# These fit a model or read back what a job wrote; their plans are those of the parts.
JOBS = {
    "train_category", "train_quality", "top_features", "predict_category", "classify_model",
    "read_split", "stream_classify", "stream_stats",
}


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_its_sql(spark, con, name):
    run, sql = REGISTRY[name]
    ok, message = compare.compare(spark, con, run, sql, SF)
    assert ok, message


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in JOBS])
def test_plan_has_no_python_and_no_cross_product(spark, name):
    plan = REGISTRY[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow", plan)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_language_filter_reaches_the_scan(spark):
    plan = REGISTRY["build_labeled"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan


def test_length_queries_read_two_columns(spark):
    plan = REGISTRY["describe_length"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry_points(spark):
    sys.path.insert(0, str(compare.ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["stratified_split", "split_comparison", "split_drift"])
def test_splits_read_the_texts_once(spark, name):
    plan = REGISTRY[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
