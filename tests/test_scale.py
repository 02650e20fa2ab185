"""Heavy keys, many copies and half-null columns: same answers, balanced work, sane plans."""

from __future__ import annotations

import pytest
from results import one
from pyspark.sql import functions as F

from crosstally.operators import bridge, compare, duplicates, impact, matching, segments


@pytest.fixture(scope="module")
def skewed(spark):
    """30,000 rows: a third on key 7, a third without a key, the rest spread; many exact copies."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).when(n % 3 == 1, None).otherwise(n)
    return spark.range(0, 30_000, 1, 16).select(
        key.cast("long").alias("k"), (n % 5).cast("double").alias("v"), F.lit("same").alias("c")
    )


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_no_job_runs_before_the_result_is_asked_for(spark, skewed):
    other = spark.range(8, 30_000).select(F.col("id").alias("k"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    matching.unmatched_rows(skewed, other, "k", "k")
    duplicates.duplicate_rows(skewed, ["k", "c"])
    duplicates.find_duplicates(skewed)
    segments.segment_analysis(skewed, "c", "v", "sum", match_against=other, local_key="k", other_key="k", only_unmatched=True)
    impact.business_impact(skewed, "v", None, "c", None, other, "k", "k", True)
    assert not tracker.getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_unmatched_rows_keep_every_row_of_a_heavy_key(spark, skewed):
    other = spark.range(8, 30_000).select(F.col("id").alias("k"))
    found = matching.unmatched_rows(skewed, other, "k", "k")
    assert found.where("k = 7").count() == 10_000
    summary = one(matching.unmatched_summary(skewed, other, "k", "k"))
    assert summary["null_key_count"] == 10_000
    assert summary["unmatched_count"] == found.count()


def test_copies_on_skew(skewed):
    found = one(duplicates.find_duplicates(skewed))
    exact = skewed.groupBy(*skewed.columns).count().where("count > 1").agg(F.sum("count")).first()[0]
    assert found["row_count"] == 30_000 and found["duplicate_row_count"] == exact
    rows = duplicates.duplicate_rows(skewed, ["k", "c"])
    assert rows.count() == 20_000


def test_comparison_and_bridge_on_skew(spark, skewed):
    other = skewed.where("k <> 8").unionByName(skewed.where("k = 11"))
    rows = one(compare.compare_rows(skewed, other, "k", "k"))
    assert rows["duplicate_key_record_count_a"] == 10_000
    assert rows["record_mismatch_count"] == 0
    found = one(bridge.bridge_summary(skewed, other, "k", "k", "v", "v"))
    assert found["null_key_row_count"] == 10_000
    assert (found["dataset_a_only_row_count"], found["dataset_b_extra_exact_copy_count"]) == (1, 1)


def test_counts_need_no_join_and_read_only_keys(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = plan_of(matching.unmatched_both_ways(orders, lineitem, "o_orderkey", "l_orderkey"))
    physical = plan.split("== Physical Plan ==")[1]
    assert "Join" not in physical
    assert "ReadSchema: struct<o_orderkey:bigint>" in physical
    assert "ReadSchema: struct<l_orderkey:bigint>" in physical


def test_alignment_is_one_shuffle_per_key(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = plan_of(compare.compare_values(orders, orders, "o_orderkey", "o_orderkey", "o_totalprice", "o_totalprice"))
    physical = plan.split("== Physical Plan ==")[1]
    assert "Join" not in physical and physical.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in physical


@pytest.mark.parametrize("module", ["operators", "functions", "plans", "sources", "workload"])
def test_no_driver_side_or_python_row_work(module):
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "crosstally" / module
    forbidden = (".toPandas(", ".rdd", "udf(", "crossJoin", "localCheckpoint", "mapInPandas", "applyInPandas")
    for path in root.glob("*.py"):
        text = path.read_text(encoding="utf-8")
        assert not [word for word in forbidden if word in text], path
