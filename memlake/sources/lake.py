"""Reading and rewriting the memory tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def event_scan(event: DataFrame, *, is_abstract: bool | None = None, is_abstracted: bool | None = None,
               status: str | None = None, tombstones: bool = False) -> DataFrame:
    """Events by flags; the filters reach the scan."""
    out = event
    for name, want in (("is_abstract", is_abstract), ("is_abstracted", is_abstracted), ("status", status)):
        if want is not None:
            out = out.filter(F.col(name) == F.lit(want))
    return out if tombstones else out.filter(~F.col("is_tombstoned"))


def event_lookup(event: DataFrame, ids: DataFrame) -> DataFrame:
    return event.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def visible_events(event: DataFrame) -> DataFrame:
    """Events recall may return."""
    return event.filter(~F.col("is_tombstoned") & (F.col("status") != "silent"))


def event_count(event: DataFrame) -> DataFrame:
    return event.groupBy("is_abstract", "is_tombstoned").agg(F.count("*").alias("n"))


def winners(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version of each key; of equal versions the one whose content hashes highest.

    `max_by` combines before the shuffle, so a key rewritten very often costs
    one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(version), F.xxhash64(*[F.col(c) for c in rest]))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def upsert_latest(base: DataFrame, delta: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Insert-or-replace: the row with the highest version per key wins.

    The base holds each key once. Only its rows whose keys the delta names are
    compared; all others pass by untouched, so a small delta moves a small part
    of the table (Spark sends the delta's keys to all tasks where they are few).
    """
    delta = winners(delta, keys, version)
    named = delta.select(*keys)
    touched = base.join(named, list(keys), "left_semi").unionByName(delta)
    return base.join(named, list(keys), "left_anti").unionByName(winners(touched, keys, version))


def schema_backfill(new: DataFrame, old: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Union of rows of two schema ages; missing columns take their default."""
    both = new.unionByName(old, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def update_by_key(base: DataFrame, change: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New values where the change table has them; unknown keys change nothing."""
    cols = [c for c in change.columns if c not in keys]
    staged = change.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return base.join(staged, list(keys), "left").withColumns(
        {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in cols}
    ).drop(*[f"_new_{c}" for c in cols])


def delete_keys(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def recall_log_rows(block: DataFrame) -> DataFrame:
    """One transaction per recall with its ids in block order, each id once.

    A block holds at most a few dozen items, so the list per recall is small.
    """
    first = block.groupBy("query_id", "event_id").agg(F.min("position").alias("position"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "event_id")))
    return first.groupBy("query_id").agg(F.transform(ordered, lambda s: s["event_id"]).alias("event_ids"))


def append_recall_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def event_out(event: DataFrame) -> DataFrame:
    """What the event API returns."""
    return event.select(
        "event_id", "create_time", "content_raw", "summaries", "is_abstract", "is_abstracted", "status",
        "abstraction_level", F.round("activation_energy", 4).alias("activation_energy"),
        F.round("affective_energy", 4).alias("affective_energy"))


def event_preview(event: DataFrame, event_role: DataFrame, width: int = 60, roles: int = 6) -> DataFrame:
    """Short preview rows: head of L1, length, first role ids."""
    who = (
        event_role.filter(F.col("pos") <= roles).groupBy("event_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "role_id"))).alias("r"))
        .select("event_id", F.transform("r", lambda s: s["role_id"]).alias("roles")))
    return event.select(
        "event_id", F.substring(F.coalesce(F.col("summaries")["L1"], F.lit("")), 1, width).alias("summary_l1"),
        F.length("content_raw").alias("chars"), "is_abstract").join(who, "event_id", "left")


def role_nested(role: DataFrame, timeline: DataFrame, block: int = 1000) -> DataFrame:
    """Role rows with their time-ordered timeline nested in blocks of bounded size.

    A role with a huge timeline becomes several rows (`block_no` 0, 1, …), so no
    single row or task holds an unbounded list.
    """
    from memlake.operators.ordered import row_position
    placed = row_position(timeline, ["role_id"],
                          [F.col("create_time"), F.col("event_id")], "rn")
    blocks = (
        placed.withColumn("block_no", F.floor((F.col("rn") - 1) / block).cast("int"))
        .groupBy("role_id", "block_no")
        .agg(F.array_sort(F.collect_list(F.struct("create_time", "event_id", "importance", "role_summary")))
             .alias("timeline")))
    return role.join(blocks, "role_id", "left").withColumn("block_no", F.coalesce("block_no", F.lit(0)))


def role_flatten(nested: DataFrame) -> DataFrame:
    return nested.select("role_id", "name", F.explode_outer("timeline").alias("t")).select("role_id", "name", "t.*")


def newest(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The n most recent rows (a bounded top-n)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
