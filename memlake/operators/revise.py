"""Belief revision: tombstones and their undoing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions.text import strip


def tombstone(event: DataFrame, corrections: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Events with the corrections (`event_id`, `reason`, `replacement_id`) applied; repeats change nothing."""
    one = corrections.groupBy("event_id").agg(F.min(F.struct("reason", "replacement_id")).alias("_c"))
    fresh = F.col("_c").isNotNull() & ~F.col("is_tombstoned")
    note = F.concat(F.lit(cfg.tombstone_prefix + " "), F.col("_c.reason"), F.coalesce(
        F.concat(F.lit(" → replaced by "), F.nullif("_c.replacement_id", F.lit(""))), F.lit("")))
    # all values read the row as it was, so the flag is set in the same step
    return event.join(one, "event_id", "left").withColumns({
        "insight": F.when(fresh, strip(F.concat(F.coalesce("insight", F.lit("")), F.lit("\n"), note))).otherwise(F.col("insight")),
        "status": F.when(fresh, "silent").otherwise(F.col("status")),
        "is_tombstoned": F.col("is_tombstoned") | F.col("_c").isNotNull(),
    }).drop("_c")


def unknown_corrections(event: DataFrame, corrections: DataFrame) -> DataFrame:
    return corrections.join(event.select("event_id"), "event_id", "left_anti")


def revive(event: DataFrame, ids: DataFrame) -> DataFrame:
    """Back to active; the note stays."""
    hit = ids.select("event_id").distinct().withColumn("_hit", F.lit(True))
    on = F.col("_hit").isNotNull()
    return event.join(hit, "event_id", "left").withColumns({
        "status": F.when(on, "active").otherwise(F.col("status")),
        "is_tombstoned": F.col("is_tombstoned") & ~on}).drop("_hit")
