"""Tables laid out by key: joins without an exchange, deltas that rewrite only their buckets."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from memlake.sources import buckets, lake
from memlake.streaming.jobs import scratch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    """Small tables are not broadcast, as large ones are not."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def base_of(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(0).alias("version"), F.concat(F.lit("a"), "id").alias("v"))


def test_tables_of_one_layout_join_where_they_lie(spark, shuffled_joins):
    one = buckets.create(base_of(spark), scratch(spark, "b"), ["k"], 8)
    two = buckets.create(base_of(spark, 700).select("k", F.col("v").alias("w")), scratch(spark, "b"), ["k"], 8)
    joined = one.table().join(two.table(), "k")
    assert "Exchange" not in plan_of(joined) and joined.count() == 700 and joined.filter("v <> w").count() == 0
    assert "Exchange" not in plan_of(one.table().groupBy("k").agg(F.max("v")))
    again = buckets.attach(spark, one.path, "k bigint, version int, v string", ["k"], 8)
    assert "Exchange" not in plan_of(again.table().join(two.table(), "k", "left")) and again.table().count() == 1000


def test_a_delta_shuffles_and_rewrites_only_what_it_names(spark, shuffled_joins):
    layout = buckets.create(base_of(spark), scratch(spark, "b"), ["k"], 16)
    delta = spark.createDataFrame([(5, 1, "n"), (5, 2, "m"), (7, -1, "older"), (2001, 1, "z")], "k bigint, version int, v string")
    merged, named = buckets.merged(layout, delta, "version")
    plan = plan_of(merged)
    join = plan[plan.index("SortMergeJoin"):]
    old = join[:join.index("Exchange")]
    assert f"FileScan parquet spark_catalog.default.{layout.name}" in old and "PartitionFilters: [bucket_no" in old
    assert join.split("Exchange")[1].count("FileScan") >= 1 and layout.name not in join.split("Exchange")[1].split("FileScan")[1][:60]
    before = layout.files()
    want = rows(lake.upsert_latest(base_of(spark), delta, ["k"], "version").select("k", "version", "v"))
    assert buckets.upsert(layout, delta, "version", scratch(spark, "staged")) == named and 1 <= len(named) <= 3
    after = layout.files()
    assert rows(layout.table().select("k", "version", "v")) == want
    assert len(before & after) == 16 - len(named) and len(after) == 16
    assert buckets.upsert(layout, delta.limit(0), "version", scratch(spark, "staged")) == [] and layout.files() == after
    assert "Exchange" not in plan_of(layout.table().join(layout.table().select("k", F.col("v").alias("w")), "k"))


def test_a_cut_off_run_is_repeated_from_the_staged_rows(spark):
    layout = buckets.create(base_of(spark, 50), scratch(spark, "b"), ["k"], 4)
    delta = base_of(spark, 60).withColumns({"version": F.lit(1), "v": F.lit("new")}).filter("k % 7 = 0")
    staged = buckets.stage(layout, delta, "version", scratch(spark, "staged"))
    buckets.apply(layout, staged)
    once = rows(layout.table())
    buckets.apply(layout, staged)
    assert rows(layout.table()) == once == rows(lake.upsert_latest(base_of(spark, 50), delta, ["k"], "version").select("k", "version", "v"))


def test_null_keys_ties_and_empty_tables(spark):
    schema = "k bigint, j string, version int, v string"
    base = spark.createDataFrame([(None, "a", 1, "old"), (1, None, 1, "stays"), (1, "a", 1, "x"), (2, "b", 3, "high")], schema)
    layout = buckets.create(base, scratch(spark, "b"), ["k", "j"], 3)
    delta = spark.createDataFrame([(None, "a", 2, "new"), (1, "a", 1, "y"), (2, "b", 2, "low"), (None, None, 1, "added")], schema)
    buckets.upsert(layout, delta, "version", scratch(spark, "staged"))
    tie = rows(lake.winners(base.filter("v = 'x'").unionByName(delta.filter("v = 'y'")), ["k", "j"], "version"))
    got = rows(layout.table().select("k", "j", "version", "v"))
    assert sorted(r[3] for r in got if r[:2] != (1, "a")) == ["added", "high", "new", "stays"]
    assert [r for r in got if r[:2] == (1, "a")] == tie
    empty = buckets.create(base.limit(0), scratch(spark, "b"), ["k", "j"], 3)
    assert empty.table().count() == 0
    buckets.upsert(empty, delta, "version", scratch(spark, "staged"))
    assert empty.table().count() == 4
