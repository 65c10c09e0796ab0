"""Tables replaced as a whole."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from memlake.sources import versions
from memlake.streaming.jobs import scratch


def test_readers_keep_their_version(spark):
    path = scratch(spark, "versions")
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    one = versions.publish(spark.range(5), path)
    before = versions.read(spark, path)
    two = versions.publish(spark.range(3), path)
    assert versions.current(spark, path) == two != one
    assert before.count() == 5 and versions.read(spark, path).count() == 3
    assert versions.prune(spark, path, keep=(one,)) == [] and versions.prune(spark, path) == [one]
    assert versions.read(spark, path).count() == 3


def test_a_failing_write_leaves_the_old_table(spark):
    path = scratch(spark, "versions")
    versions.publish(spark.range(4), path)
    broken = spark.range(8).select(F.when(F.col("id") == 6, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        versions.publish(broken, path)
    assert rows(versions.read(spark, path)) == [(i,) for i in range(4)]
    left = versions.prune(spark, path)
    assert len(left) == 1 and versions.read(spark, path).count() == 4
