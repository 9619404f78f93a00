"""The physical plans that scale: pruning, pushdown, one shuffle, split joins."""

import re

import pytest
from pyspark.sql import functions as F

from firnline.operators import joins, rows, totals
from firnline.plans import bindings
from firnline.plans.trip import run_trip
from firnline.schema import COORD

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned_at_the_scan(spark):
    plan = plan_of(bindings.QUERIES["grand_total"](spark, SF_DIR))
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(bindings.QUERIES["filters"](spark, SF_DIR))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    for part in ("EqualTo(o_orderstatus,F)", "Not(EqualTo(o_custkey,4))", "GreaterThan(o_orderdate"):
        assert part in pushed


@pytest.mark.parametrize(
    "name,exchanges",
    [("rows_per_key", 1), ("average_repeats", 1), ("centroids", 1), ("daily_totals", 1),
     ("multipart_first", 1), ("period_totals", 2), ("slice_range", 0), ("slice_tail", 0),
     ("corrections", 4),  # of the few rules, none of the table
     ("swe_density_a", 0), ("utm_forward", 0), ("to_long", 0)],
)
def test_number_of_shuffles(spark, name, exchanges):
    plan = plan_of(bindings.QUERIES[name](spark, SF_DIR))
    assert len(re.findall(r"\bExchange ", plan)) <= exchanges
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_query_uses_python_or_a_cross_join(spark):
    for name, query in bindings.QUERIES.items():
        plan = plan_of(query(spark, SF_DIR))
        for bad in ("CartesianProduct", "NestedLoop", "Python", "MapInPandas", "ArrowEval"):
            assert bad not in plan, (name, bad)


def test_skewed_left_join_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "32",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 60_000, 1, 6).select(
            F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 500).alias("k"),
            F.xxhash64("id").alias("x"),
        )
        dims = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
        turned = joins.dimension_left_join(dims, facts, ["k"])
        assert turned.count() == 40_000
        turned.collect()
        assert "skew=true" in plan_of(turned)
        for na_matches in (True, False):
            joined = joins.left_join(facts, dims, ["k"], na_matches=na_matches)
            assert joined.agg(F.count("y"), F.count(F.lit(1))).first()[:] == (40_000, 60_000)
            joined.collect()
            assert "skew=true" in plan_of(joined)
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_small_coordinates_are_broadcast_by_size(spark):
    form = bindings.load(spark, SF_DIR, "lineitem").selectExpr(
        "l_shipdate survey_time", "'A' study_area", "cast(l_suppkey as string) plot_id",
        "'C' plot_type", "'Depth' sample_type", "'N' cardinal_direction", "1D dist_from_centre",
        "'no' multi_core", "l_quantity depth", "l_tax core", "l_discount plug", "l_extendedprice mass",
    )
    sites = spark.createDataFrame([("1", 1.0, 2.0, 3.0, 4.0, 5.0)], COORD)
    plan = plan_of(run_trip([form], sites, stage=False).observations)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sort_cuts_a_key_that_fills_the_table(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.lit(1).alias("flight"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = (
            rows.sort_rows(df, ["flight"], ["id"])
            .groupBy(F.spark_partition_id().alias("p"))
            .count()
            .collect()
        )
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 30_000


def test_totals_combine_before_the_shuffle(spark):
    df = spark.range(100).select(F.lit("2021-04-22 00:00:00").alias("t"), "id")
    plan = plan_of(totals.daily_totals(df, F.col("t").cast("timestamp_ntz"), "id", "m"))
    assert "partial_sum" in plan
