"""Batch recall: many queries against the event table, ending in one block per query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from memlake.config import DEFAULT, MemoryConfig
from memlake.operators import recall, search, timeline as tl
from memlake.operators.output import ITEM_SEPARATOR, context_text
from memlake.sources import lake

_ANY_LENGTH = 2 ** 31 - 1  # no text is longer


@dataclass(frozen=True)
class RecallInput:
    """Tables one recall run reads; every one may be arbitrarily large but `weights`."""

    hits: DataFrame          # query_id, route, event_id, distance, query_valence
    event: DataFrame         # event rows with coverage, flags, and summaries and text or, with `texts`, their lengths
    event_role: DataFrame
    timeline: DataFrame
    focus: DataFrame         # query_id, role_id
    leaves: DataFrame | None = None  # root, event_id: what abstract events rest on
    texts: DataFrame | None = None   # the texts of events that have only lengths (`recall.without_texts`)


def score_candidates(src: RecallInput, as_of: Column, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Union of routes, visibility, silence, weight, rank score, coverage."""
    near = search.union_hits(src.hits)
    query = src.hits.groupBy("query_id").agg(F.max("query_valence").alias("query_valence"))
    wanted = near.select("event_id").distinct()
    roles = src.event_role.join(wanted, "event_id", "left_semi")
    standing = tl.event_standing(roles, src.timeline, as_of, cfg)
    if src.leaves is not None:
        below = src.leaves.join(wanted, F.col("root") == wanted["event_id"], "left_semi")
        basic = tl.event_weight(src.event_role.join(below.select("event_id").distinct(), "event_id", "left_semi"), src.timeline, as_of, cfg)
        raised = tl.abstract_weight(basic, below)
        standing = standing.join(raised.select("event_id"), "event_id", "left_anti").unionByName(
            raised.select("event_id", "w_i", F.lit(False).alias("is_silent"), F.lit(0.0).alias("event_valence")))
    live = (
        lake.visible_events(src.event).select("event_id", "abstract_coverage").join(standing, "event_id", "left")
        .filter(~F.coalesce("is_silent", F.lit(False))))
    rows = near.join(live, "event_id").join(query, "query_id").select(
        "query_id", "event_id", "distance", "abstract_coverage", "query_valence",
        F.coalesce("w_i", F.lit(0.0)).alias("weight"), F.coalesce("event_valence", F.lit(0.0)).alias("event_valence"))
    return recall.with_coverage(recall.rrf_single(rows, cfg), cfg)


def newly_silent(src: RecallInput, as_of: Column, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Status changes recall brings about, as a change table instead of a side effect; only events that were hit are looked at."""
    hit = src.event_role.join(src.hits.select("event_id").distinct(), "event_id", "left_semi")
    return tl.silence_check(hit, src.timeline, as_of, cfg).filter("is_silent").select(
        "event_id", F.lit("silent").alias("status"))


def tiered_rows(scored: DataFrame, event: DataFrame, event_role: DataFrame, focus: DataFrame, cfg: MemoryConfig = DEFAULT,
                whole: bool = False) -> DataFrame:
    """Scored rows with the level that their focus roles call for, its place among the levels (`at`) and length, and the lengths of all levels.

    `whole` takes the level that is called for at any length; else the pick budget may put another in its place.
    `event` may have lengths in the place of texts; rows have the key of their text, and no text.
    """
    lengths = event if "sizes" in event.columns else recall.without_texts(event)[0]
    tiered = recall.tier_offsets(scored, event_role, focus, cfg)
    sized = tiered.join(lengths.select("event_id", "names", "sizes", "raw_size", *recall.TEXT_KEY), "event_id")
    budget = F.lit(_ANY_LENGTH if whole else cfg.pick_budget)
    picked = sized.withColumn("p", recall.level_pick(F.col("names"), F.col("sizes"), F.col("raw_size"), budget, F.col("offset"), cfg))
    return picked.select("query_id", "event_id", "score", "p.level", "p.at", F.col("p.size").alias("text_len"), "names", "sizes", *recall.TEXT_KEY)


def recall_block(src: RecallInput, as_of: Column, cfg: MemoryConfig = DEFAULT, whole: bool = False) -> DataFrame:
    """Scored rows with tiered texts, cut at 1.2 redlines and then at the redline; `whole` as in `tiered_rows`.

    Rows are cut by the lengths of their texts, and texts join those that stay.
    """
    event, texts = (src.event, src.texts) if src.texts is not None else recall.without_texts(src.event)
    scored = score_candidates(src, as_of, cfg).select("query_id", "event_id", "score")
    rows = tiered_rows(scored, event, src.event_role, src.focus, cfg, whole).drop("names", "sizes")
    first = recall.budget_prefix(rows, int(cfg.redline * cfg.intermediate_factor)).drop("position", "used")
    kept = recall.with_texts(recall.budget_prefix(first, cfg.redline), texts)
    text = F.when(F.col("at") > 0, F.get("bodies", F.col("at") - 1)).otherwise(F.col("content_raw"))
    return kept.withColumn("text", text).drop("at", "bodies", "content_raw")


def reinforced_timeline(block: DataFrame, timeline: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    return tl.reinforce(timeline, block.select("event_id"), as_of, cfg)


def context_package(block: DataFrame, queries: DataFrame) -> DataFrame:
    """Number of items and one context text per query (`query_id`, `shadow`, `text`); blocks are under the redline."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    joined = block.groupBy("query_id").agg(F.count("*").alias("items"), F.array_join(F.transform(ordered, lambda s: s["text"]), ITEM_SEPARATOR).alias("recall"))
    return queries.join(joined, "query_id", "left").select(
        "query_id", F.coalesce("items", F.lit(0)).alias("items"), context_text(F.col("recall"), F.col("shadow"), F.col("text")).alias("context"))
