"""Texts join rows last: no window, grouping or join by event moves them."""

import re

import pytest
from pyspark.sql import functions as F

from memlake import registry
from memlake.operators import recall


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _carries_text(plan):
    return re.search(r"(^|,)(content_raw|summaries|texts|text)#", plan.output().mkString(",")) is not None


@pytest.mark.parametrize("name", ["block_compress", "event_encode", "vector_reindex"])
def test_only_the_join_with_documents_moves_texts(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan()
    for node in _nodes(plan):
        below = [node.children().apply(i) for i in range(node.children().size())]
        by_document = node.nodeName() == "Join" and "doc_id" in node.condition().toString()
        if node.nodeName() in ("Join", "Window") and not by_document:
            assert not any(_carries_text(b) for b in below)


def test_a_plan_by_lengths_gives_the_rows_of_the_texts(spark):
    rows = [("Q", f"E{i}", i, ["L0", "L1"], ["x" * (900 - 100 * i), "y" * 30]) for i in range(1, 6)]
    rows += [("R", "E1", 1, ["L0"], ["z" * 700]), ("S", "E1", 1, ["L0", "L1"], ["", "z"])]
    block = spark.createDataFrame(rows, "query_id string, event_id string, position int, levels array<string>, texts array<string>")
    sized = block.withColumn("sizes", F.transform("texts", lambda x: F.length(x)))
    plan = recall.block_plan(sized.drop("texts"), 500).filter("kept").join(block.select("query_id", "event_id", "texts"), ["query_id", "event_id"])
    got = plan.select("query_id", "event_id", recall.planned_text(F.col("texts")).alias("text")).collect()
    want = recall.block_compress(block, 500).select("query_id", "event_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 1
