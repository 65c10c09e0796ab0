"""Sealing closed fragments into event rows with everything derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions import scoring
from memlake.operators import timeline as tl
from memlake.operators.segment import summary_ladder


def seal_events(fragment: DataFrame, event_role: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Event rows from fragments (`event_id`, `create_time`, `content`): capped text, budget, ladder, affect, immunity."""
    capped = fragment.withColumn("content_raw", F.substring("content", 1, cfg.len_msg)).drop("content")
    sizes = scoring.budget(F.length("content_raw"), cfg)
    laddered = summary_ladder(capped, cfg).withColumns({
        "event_length": F.length("content_raw"), "budget_total": sizes["total"]})
    affect = event_role.groupBy("event_id").agg(
        F.least(F.max("arousal"), F.lit(1.0)).alias("affective_energy"), F.avg("valence").alias("event_valence"),
        (F.max("arousal") > cfg.immune_arousal).alias("ptsd_immune"),
        F.sum(F.length(F.coalesce(F.nullif("l2_interaction", F.lit("")), "l1_mention", F.lit("")))).alias("snapshot_chars"))
    out = laddered.join(affect, "event_id", "left").na.fill(
        {"affective_energy": 0.0, "event_valence": 0.0, "ptsd_immune": False, "snapshot_chars": 0})
    return with_compression(out)


def with_compression(event: DataFrame, decoration_chars=None) -> DataFrame:
    """Share of derived text: L5 or the deepest summary, snapshots, decoration over the raw length."""
    keys = F.map_keys("summaries")
    deepest = F.array_max(F.transform(keys, lambda k: F.substr(k, F.lit(2)).cast("int")))
    audit = F.coalesce(F.length(F.col("summaries")["L5"]),
                       F.length(F.element_at("summaries", F.concat(F.lit("L"), deepest.cast("string")))), F.lit(0))
    total = audit + F.col("snapshot_chars") + (decoration_chars if decoration_chars is not None else F.lit(0))
    return event.withColumn("audit_chars", audit).withColumn(
        "compression_ratio", F.when(F.length("content_raw") > 0, total / F.length("content_raw")).otherwise(F.lit(0.0)))


def seal_and_track(fragment: DataFrame, event_role: DataFrame, cfg: MemoryConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Sealed events and the timeline rows of their roles."""
    return seal_events(fragment, event_role, cfg), tl.timeline_update(event_role, cfg)
