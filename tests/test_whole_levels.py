"""Blocks whose SQL knows no pick budget take long levels whole."""

import dataclasses

from pyspark.sql import functions as F

from memlake.config import DEFAULT
from memlake.mappings import Tables
from memlake.plans import recall_block as rb
from memlake.registry import plans


def test_a_level_over_the_pick_budget_stays_whole(spark):
    scored = spark.createDataFrame([("Q", "E", 1.0)], "query_id string, event_id string, score double")
    levels = F.create_map(*[x for k, n in ((1, 12_000), (2, 11_000), (3, 10_500), (4, 400)) for x in (F.lit(f"L{k}"), F.repeat(F.lit("x"), n))])
    event = spark.range(1).select(F.lit("E").alias("event_id"), levels.alias("summaries"), F.repeat(F.lit("x"), 13_000).alias("content_raw"))
    role = spark.createDataFrame([("E", "R", "S")], "event_id string, role_id string, importance string")
    focus = spark.createDataFrame([("Q", "R")], "query_id string, role_id string")
    pick = lambda **kw: [(r.level, r.text_len) for r in rb.tiered_rows(scored, event, role, focus, **kw).collect()]
    cut, whole = pick(), pick(whole=True)
    assert cut == [("L4", 400)]
    assert whole[0][1] > DEFAULT.pick_budget and whole == pick(cfg=dataclasses.replace(DEFAULT, pick_budget=50_000))


def test_block_queries_take_levels_whole(spark, sf, monkeypatch):
    asked = []
    real = rb.tiered_rows
    monkeypatch.setattr(rb, "tiered_rows", lambda *args: asked.append(args[5]) or real(*args))
    plans.recall_block(Tables(spark, sf))
    plans.recall_flow(Tables(spark, sf))
    assert asked == [True, True]
