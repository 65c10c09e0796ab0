"""Recall cuts its blocks by lengths; texts join the rows that stay."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from memlake import registry
from memlake.operators import recall


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _carries_text(plan):
    return re.search(r"(^|,)(content_raw|summaries|bodies|texts|text)#", plan.output().mkString(",")) is not None


@pytest.mark.parametrize("name", ["recall_block", "recall_flow"])
def test_no_window_moves_texts_and_only_the_last_join_does(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan()
    joins = 0
    for node in _nodes(plan):
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            assert not any(_carries_text(b) for b in below)
        if node.nodeName() == "Join" and any("content_raw#" in b.output().mkString(",") for b in below):
            joins += 1
            assert "text_digest" in node.condition().toString()
    assert joins == 1


def _events(spark):
    level = lambda *v: {f"L{i}": "x" * n for i, n in enumerate(v, 1)}
    data = [("a", level(40, 20, 10), "x" * 90), ("b", {}, "raw"), ("c", level(5000, 4000), "x" * 9000), ("d", {"L1": None, "L3": "yy"}, None),
            ("e", level(30), "one"), ("e", level(31), "two"), ("e", level(31), "two"), ("f", None, None)]
    return spark.createDataFrame(data, "event_id string, summaries map<string,string>, content_raw string")


def test_a_pick_by_lengths_is_the_pick_of_texts(spark):
    events = _events(spark).crossJoin(spark.createDataFrame([(b, o) for b in (0, 2, 25, 100, 4500) for o in (-1, 0, 1)], "budget int, off int"))
    lv = recall.level_array(F.col("summaries"))
    sized = events.withColumns(recall.text_lengths(F.col("summaries"), F.col("content_raw"))).select(
        "*", recall.summary_pick(lv, F.col("content_raw"), F.col("budget"), F.col("off")).alias("t"),
        recall.level_pick(F.col("names"), F.col("sizes"), F.col("raw_size"), F.col("budget"), F.col("off")).alias("p"))
    bad = sized.filter(~F.col("t.level").eqNullSafe(F.col("p.level")) | ~F.length("t.text").eqNullSafe(F.col("p.size")))
    assert sized.count() == 8 * 15 and bad.isEmpty()


def test_events_that_repeat_keep_a_text_each(spark):
    events = _events(spark)
    lean, texts = recall.without_texts(events)
    assert "content_raw" not in lean.columns and texts.filter("text_id = 'e'").count() == 2
    back = recall.with_texts(lean.select("event_id", *recall.TEXT_KEY), texts)
    assert rows(back, "event_id", "content_raw") == rows(events, "event_id", "content_raw")


def test_sized_events_are_the_events_with_texts(spark, tmp_path):
    from memlake.mappings import Tables
    docs = spark.createDataFrame([(0, "a" * 300), (1, None), (1, "b"), (1, "b"), (2, "c" * 90)], "doc_id long, text string")
    events = spark.createDataFrame([(i, i % 3, "click", 1.0, '{"k": 1}') for i in (0, 1, 1, 2, 3, 6)], "event_id long, user_id long, event_type string, value double, props string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    events.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    back = recall.with_texts(t.event_sized.select("event_id", "sizes", "raw_size", *recall.TEXT_KEY), t.texts)
    want = t.event_text.withColumns(recall.text_lengths(F.col("summaries"), F.col("content_raw")))
    assert rows(back, "event_id", "content_raw", "raw_size", "sizes") == rows(want, "event_id", "content_raw", "raw_size", "sizes")


def test_search_keeps_the_best_rows_and_breaks_ties_by_id(spark, monkeypatch):
    """Blocks of events in single precision, many equal vectors, passes and both sides small: always the rows of brute force."""
    import numpy as np
    from memlake.operators import search
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(12, 5))
    events = [(f"e{i:03d}", unit[i % 12].tolist(), None if i % 9 == 0 else unit[(i * 5) % 12][:3].tolist()) for i in rng.permutation(300).tolist()]
    asks = [(f"q{i}", rng.normal(size=5).tolist(), rng.normal(size=3).tolist() if i % 4 else [0.0] * 3) for i in range(20)]
    e = spark.createDataFrame(events, "event_id string, act array<double>, emo array<double>").repartition(5)
    q = spark.createDataFrame(asks, "query_id string, act array<double>, emo array<double>")
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12)
    want = {}
    for name, *vecs in asks:
        for b, v in enumerate(vecs):
            if any(v):
                near = sorted((-cos(v, x[b + 1]), x[0]) for x in events if x[b + 1] is not None)[:7]
                want.update({(("act", "emo")[b], name, r): i for r, (_, i) in enumerate(near, 1)})
    got = lambda: {(r.band, r.query_id, r["rank"]): r.event_id for r in search.bands_topk(q, e, 7, ["act", "emo"]).collect()}
    assert got() == want
    monkeypatch.setattr(search, "EVENT_ROWS", 20)
    monkeypatch.setattr(search, "EVENT_BLOCK", 11)
    monkeypatch.setattr(search, "ASKED_BLOCK", 6)
    assert got() == want
    fused = lambda: rows(search.fused_topk(q, e, 7, ["act", "emo"]).withColumn("score", F.round("score", 9)))
    scanned = fused()
    assert search._by_queries(q, e, 7, ["act", "emo"], search.DEFAULT) is None
    monkeypatch.setattr(search, "PASS_ROWS", 30)
    passed = search.fused_topk(q, e, 7, ["act", "emo"])
    assert "MapInArrow" in passed._jdf.queryExecution().executedPlan().toString()
    assert fused() == scanned and len(scanned) == 140


def test_passes_store_no_copy_of_the_events(spark, monkeypatch):
    from memlake.operators import search
    e = spark.range(40).selectExpr("concat('e', id) as event_id", "array(double(id), 1.0) as act")
    monkeypatch.setattr(search, "PASS_ROWS", 20)
    plan = search.bands_topk(e.withColumnRenamed("event_id", "query_id"), e, 5, ["act"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") > 1 and "parquet" not in plan
