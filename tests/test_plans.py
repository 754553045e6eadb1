"""Joins that check sizes, staging, and the shape of plans."""

import pytest

import __spark_entry__
from factloom.plans import joins
from factloom.plans.staging import Stage, shared_dir


def test_stage_writes_and_drops(spark):
    stage = Stage(spark, "t")
    assert stage.root.startswith(shared_dir(spark))
    cut = stage.cut(spark.range(3), "a")
    assert cut.count() == 3
    stage.drop("a")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        spark.read.parquet(f"{stage.root}/a").count()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("salts", [1, 4])
def test_lookup_join_is_whole_under_skew(spark, monkeypatch, how, salts):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), (None, 2), ("none", 3)], "k string, v int")
    right = spark.createDataFrame([("hot", 1.0), ("b", 2.0), ("c", 3.0)], "k string, w double")
    small = sorted(map(tuple, joins.lookup_join(left, right, "k", how, salts).collect()), key=repr)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    large = joins.lookup_join(left, right, "k", how, salts)
    assert "BroadcastExchange" not in large._jdf.queryExecution().optimizedPlan().toString() and "broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, large.collect()), key=repr) == small


@pytest.mark.parametrize("name", ["facts_filtered", "metric_vocabulary", "stats", "issues_by_reason", "relationship_counts"])
def test_scans_read_few_columns(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "char_start" not in plan and "reconciliation_factors" not in plan


@pytest.mark.parametrize("name", ["relationships", "candidate_pairs", "grounding_check"])
def test_no_plan_has_a_cartesian_product(spark, name):
    assert "CartesianProduct" not in __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
