"""Run reports over the memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions import scoring, text as tx
from memlake.operators import monitor, output, recall, search, timeline as tl


def chunk_snapshot(event: DataFrame, role: DataFrame, nodes: DataFrame, log: DataFrame, turns: DataFrame,
                   cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """One row of table sizes after a run; every count is one aggregate over one scan."""
    ev = event.agg(F.count("*").alias("events"), F.count_if(~F.col("is_abstracted")).alias("events_new"),
                   F.least(F.count_if(~F.col("is_tombstoned") & (F.col("status") != "silent")), F.lit(cfg.pool_base)).alias("pool_size"))
    one = lambda df, agg: df.agg(agg.alias("v")).scalar()
    return ev.select(
        "events", "events_new", one(role, F.count("*")).alias("roles"), one(nodes, F.count_if("is_abstract")).alias("abstracts"), "pool_size",
        one(log, F.count("*")).alias("log_rows"), one(turns, F.count_distinct("conv_id")).alias("unclosed"),
        one(turns, F.sum(F.length("text") + 1) - F.count_distinct("conv_id")).alias("shadow_chars"))


def invariant_probes(t) -> DataFrame:
    """Every rule as one row; each is a single aggregate over its table."""
    cfg = t.cfg
    p = monitor.probe
    s = F.col("summaries")
    docs, entries = t.raw("documents"), t.timeline
    block = recall.budget_prefix(recall.rrf_single(t.hits, cfg), cfg.redline).groupBy("query_id").agg(F.max("used").alias("total"))
    edge = t.graph_edge.join(t.graph_node.select(F.col("event_id").alias("parent"), F.col("level").alias("up")), "parent").join(
        t.graph_node.select(F.col("event_id").alias("child"), F.col("level").alias("down")), "child")
    energy = tl.activation_energy(t.event_role.withColumn("energy", F.col("arousal")), cfg)
    modes = output.mode_output(t.turn.select(
        F.when(F.col("role") == "system", "passive_log").otherwise("assistant").alias("mode"), F.col("text").alias("context"), F.array(F.lit("idle")).alias("npc_directives")))
    kept = search.hit_hydrate(recall.rrf_single(t.hits, cfg).select("query_id", "event_id"), t.event).select("event_id")
    strong = entries.agg(F.avg(F.when(F.col("memory_weight") >= 0.5, F.col("memory_weight"))).alias("hi"),
                         F.avg(F.when(F.col("memory_weight") < 0.5, F.col("memory_weight"))).alias("lo"))
    return monitor.union_all([
        p(docs, "event_length", F.length("text") > cfg.len_msg),
        p(t.event_text, "summary_fuse", (F.length(s["L3"]) <= cfg.fuse_min_chars) & s["L4"].isNotNull() & (F.length(s["L3"]) < F.length("content_raw"))),
        p(docs, "keyword_coverage", tx.term_hits(F.col("text"), ("the", "der", "le", "que")) < 2),
        p(entries, "timeline_tier", F.col("importance").isin("S", "A") & (F.col("n") % 2 == 0) & ~F.contains(F.col("role_summary"), F.lit("decided"))),
        p(block, "block_budget", F.col("total") > cfg.redline),
        p(kept.join(t.event.select("event_id", "is_tombstoned", "status"), "event_id"), "tombstone_exclusion",
          F.col("is_tombstoned") | (F.col("status") == "silent")),
        p(edge, "level_chain", F.col("up") != F.col("down") + 1),
        p(energy, "activation_range", (F.col("activation_energy") < 0) | (F.col("activation_energy") > 1)),
        p(modes, "passive_silence", (F.col("mode") == "passive_log") == F.col("context").isNotNull()),
        p(strong, "retention_order", ~(F.col("hi") > F.col("lo"))),
    ])
