"""Streaming jobs: sources, sinks, and the ingest pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions import ids
from memlake.plans.seal import seal_events
from memlake.sources import lake
from memlake.session import shared_folder
from memlake.streaming import processors

WATERMARK = "1 hour"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its rows back.

    Every micro-batch writes its own folder, so a batch that is retried after a
    failure overwrites itself and no row appears twice. In update mode `batch`
    tells which version of a row is the newest.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    with processors.rocksdb(stream.sparkSession):
        q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state")
             .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(
        T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{out}/rows").parquet(f"{out}/rows")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key of an update-mode table."""
    return lake.winners(rows, keys, "batch")


def window_counts(events: DataFrame, ts: str, key: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts per event-time window and key, tumbling or sliding."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, WATERMARK).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    return events.withWatermark(ts, WATERMARK).groupBy(F.session_window(ts, gap).alias("w"), key).agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def dedupe(turns: DataFrame, key: str, ts: str) -> DataFrame:
    """Drop re-delivered rows that arrive within the watermark."""
    return turns.withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark([key])


def late_rows(given: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows the watermark turned away, for the late sink."""
    return given.join(accepted.select(*keys).distinct(), keys, "left_anti")


ROWS_PER_FILE = 100_000


def in_batches(rows: DataFrame, order: Column, out: str, batches: int = 3) -> DataFrame:
    """A table as a stream of several micro-batches: equal spans of a whole number, lowest first; rows without one come in the first.

    Each span is written by as many tasks as its share of the rows asks for, and a
    trigger takes the files of one span.
    """
    low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    files = max(1, n // (batches * ROWS_PER_FILE))
    span = F.coalesce(F.floor((order - F.lit(low or 0)) * batches / ((high or 0) - (low or 0) + 1)), F.lit(0))
    for i in range(batches):
        rows.filter(span == i).repartition(files).write.parquet(f"{out}/part={i}")
    return (rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
            .option("recursiveFileLookup", "true").parquet(out))


def fragment_id(conv: Column, session: Column, part: Column) -> Column:
    return ids.content_id("EVT-", conv.cast("string"), session.cast("string"), part.cast("string"))


def sealed_events(fragments: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Event rows of sealed fragments; the id is made of conversation, session and part, so a retry gives the same row."""
    c, s = F.col("conv_id"), F.col("session_no")
    before = F.when(F.col("part") > 0, F.transform(F.sequence(F.lit(0), F.col("part") - 1), lambda p: fragment_id(c, s, p))).otherwise(
        F.array().cast("array<string>"))
    rows = fragments.select(
        fragment_id(c, s, F.col("part")).alias("event_id"), "conv_id", "session_no", "part", "turns", "closed_by", "oversized",
        before.alias("split_prefix_event_ids"), F.timestamp_micros("start_us").alias("create_time"), "content")
    none = rows.select("event_id", F.lit(0.0).alias("arousal"), F.lit(0.0).alias("valence"),
                       F.lit("").alias("l1_mention"), F.lit("").alias("l2_interaction")).limit(0)
    return seal_events(rows, none, cfg)


def newest_in_state(accepted: DataFrame) -> DataFrame:
    """A plain recall block (`query_id`, `event_id`, `position`) from what the state told: the newest sealed events of the conversation that asks."""
    at = F.posexplode(F.transform("newest", lambda n: F.split(n, r"\.")))
    return accepted.select("query_id", "conv_id", at.alias("i", "n")).select(
        "query_id", fragment_id(F.col("conv_id"), F.col("n")[0], F.col("n")[1]).alias("event_id"), (F.col("i") + 1).alias("position"))


Recall = Callable[[DataFrame, DataFrame, MemoryConfig], DataFrame]


def ingest(turns: DataFrame, out: str, gap_minutes: int = 30, cfg: MemoryConfig = DEFAULT, recall: Recall | None = None):
    """Turn stream to tables `event`, `stale`, `accepted` and `recall_log`; returns the running query.

    Each micro-batch overwrites its own partition of all tables, so a retried batch adds nothing. Stale text
    is kept apart and becomes no event. Every conversation that a batch brings turns for asks once and gets its newest
    sealed events, which its state names, so that a batch reads nothing back but its own rows. `recall` may
    give another block from all events sealed so far; it then reads them all in each batch. Turns that are in no
    `accepted` row came too late (`late_rows`).
    """
    spark = turns.sparkSession
    fragments = processors.unclosed_fragments(turns.withWatermark("ts", WATERMARK), gap_minutes, cfg)

    def write(rows: DataFrame, batch: int) -> None:
        raw = f"{out}/fragment/batch={batch}"
        rows.write.mode("overwrite").parquet(raw)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(raw)
        new = lambda name, df: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        new("event", sealed_events(rows.filter(F.col("closed_by").isin("gap", "force")), cfg))
        new("stale", rows.filter(F.col("closed_by") == "stale").drop("accepted", "newest"))
        accepted = rows.filter(F.col("closed_by") == processors.ACCEPTED)
        new("accepted", accepted.select("conv_id", F.explode("accepted").alias("turn")))
        asked = accepted.select("conv_id", F.concat_ws("-", F.lit("RCL"), "conv_id", F.lit(batch)).alias("query_id"), F.timestamp_micros("end_us").alias("created_at"), "newest")
        if recall is None:
            block = newest_in_state(asked)
        else:
            block = recall(asked, rows.sparkSession.read.parquet(f"{out}/event").filter(F.col("batch") <= batch), cfg)
        log = lake.recall_log_rows(block).join(asked.select("query_id", "created_at"), "query_id")
        new("recall_log", log.select(F.col("query_id").alias("recall_id"), "created_at", "event_ids"))

    with processors.rocksdb(spark):
        return (fragments.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state")
                .trigger(availableNow=True).foreachBatch(write).start())
