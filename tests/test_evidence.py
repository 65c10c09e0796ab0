"""Evidence moves as lengths, in one walk; texts join the rows that an abstract event begins with."""

import re

import pytest
from pyspark.sql import functions as F

from memlake.mappings import Tables
from memlake.operators import graph
from memlake.registry import graph as queries

NODE = "event_id string, is_abstract boolean, level int, create_time timestamp, content_raw string, is_tombstoned boolean"


@pytest.fixture(scope="module")
def tables(spark):
    import datetime as dt
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    nodes = [("A", True, 1, at(0), "", False), ("B", True, 1, at(0), "", False), ("T", True, 1, at(0), "", True), ("C", True, 2, at(0), "", False)]
    nodes += [(f"e{i}", False, 0, at(9 - i % 4), "x" * i if i else None, i == 5) for i in range(8)]
    edges = [("A", "e1"), ("A", "e2"), ("A", "e1"), ("A", "B"), ("B", "A"), ("B", "e3"), ("B", "e5"), ("C", "T"), ("C", "B"), ("C", "e0"), ("T", "e6"), ("C", "gone")]
    members = [("S", "A"), ("S", "e7"), ("U", "C"), ("U", "e3"), ("V", "T"), ("W", "e7")]
    return (spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "parent string, child string"),
            spark.createDataFrame(members, "subset_id string, member string"))


def test_walk_by_subset(tables):
    nodes, edges, members = tables
    texts, sizes = (graph.evidence_collect(nodes, edges, members, texts=x) for x in (True, False))
    want = {"S": {"e1", "e2", "e3", "e7"}, "U": {"e0", "e1", "e2", "e3"}, "W": {"e7"}}
    assert sorted((r.subset_id, r.event_id) for r in texts.collect()) == sorted((s, e) for s, es in want.items() for e in es)
    assert sizes.columns == ["event_id", "subset_id", "create_time", "chars"]
    assert {(r.subset_id, r.event_id, r.chars) for r in sizes.collect()} == {
        (s, e, int(e[1:]) or None) for s, es in want.items() for e in es}


@pytest.mark.parametrize("rows", [0, 1000])
def test_texts_from_lengths_alone(tables, monkeypatch, rows):
    monkeypatch.setattr(graph, "LEAD_ROWS", rows)
    nodes, edges, members = tables
    built = [sorted(map(str, graph.abstract_build(members, nodes, graph.evidence_collect(nodes, edges, members, texts=x)).collect())) for x in (True, False)]
    assert built[0] == built[1] and len(built[0]) == 3
    assert any("content_raw='xxx" in r for r in built[0])


def test_evidence_queries_move_no_texts_and_walk_once(spark, sf):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    stats = plan(queries.leaf_evidence_stats(Tables(spark, sf)))
    assert "content_raw" not in stats and "Join" not in stats
    build = plan(queries.abstract_build(Tables(spark, sf)))
    assert "lineitem" not in build and not re.search(r"l_partkey", build)
