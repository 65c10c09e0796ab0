"""Contiguous shards of nearly equal bytes, cut where global prefix sums of sizes reach equal targets.

Rows are range-partitioned by (digest of the text, doc_id), so equal texts stand
together and a hot text still spreads over partitions. Row numbers inside the
sorted partitions come with the write; per-partition totals give every partition
its offset. Only partitions in which a cut falls need running sums of their own
rows, and a row's shard is then the number of cuts at or before it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.llm.base import all_columns, free_name, stored

SHARDS = 8
LAW = "bytes"
_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row's number below


@dataclass(frozen=True)
class Laid:
    """Rows in their global order (`row`, `size`, `text_crc32`, `digest`, `place`) and each partition's offset in rows and bytes."""
    rows: DataFrame
    parts: list[int]
    first_row: list[int]
    first_byte: list[int]
    total: int
    largest: int


def _partition(place: int) -> int:
    return place >> _ROW_BITS


def lay_out(docs: DataFrame, keep: Sequence[str]) -> Laid:
    """Sort by (digest, doc_id) across partitions of like size, store, and sum up each partition.

    What reaches the driver is one row for each partition.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.struct(*all_columns(keep)).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(raw).cast("bigint") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("digest"), F.monotonically_increasing_id().alias("place"))
    order = ["digest", "doc_id", "place"]  # the place parts rows that are alike in both
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    laid = stored(laid.drop("doc_id"), "laid")
    totals = sorted(laid.groupBy(F.shiftright("place", _ROW_BITS).alias("part")).agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("largest")).collect())
    first_row = list(accumulate((t.rows for t in totals), initial=0))
    first_byte = list(accumulate((t.bytes for t in totals), initial=0))
    return Laid(laid, [t.part for t in totals], first_row[:-1], first_byte[:-1], first_byte[-1], max((t.largest for t in totals), default=0))


def _running(laid: Laid, parts: list[int]) -> DataFrame:
    """Rows of a few partitions with the bytes before them inside their partition."""
    ranges = [F.col("place").between(p << _ROW_BITS, (p + 1 << _ROW_BITS) - 1) for p in parts]
    mine = laid.rows.filter(reduce(or_, ranges))
    w = Window.partitionBy(F.shiftright("place", _ROW_BITS)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return mine.select("place", "size", "digest", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("before"))


def cuts(laid: Laid, shards: int = SHARDS) -> list[int]:
    """The places at which shards 1, 2, ... begin.

    Shard k begins at the first row whose middle byte lies at or beyond k equal
    shares. Where that parts equal texts that together are no larger than the
    largest document, the whole group goes to the side of its own middle, so a
    shard is never further from its share than the largest document is long.
    """
    if not laid.parts:
        return []
    # the first row whose middle reaches the target stands in the partition that holds the target, or begins the next one
    targets = {k: bisect_right(laid.first_byte, laid.total * k // shards) - 1 for k in range(1, shards)}
    running = stored(_running(laid, [laid.parts[i] for i in sorted(set(targets.values()))]), "running") if targets else None
    out = {}
    if targets:
        wanted = [F.min(F.when((F.shiftright("place", _ROW_BITS) == laid.parts[i])
                               & ((2 * (F.col("before") + laid.first_byte[i]) + F.col("size")) * shards >= 2 * k * laid.total), F.col("place"))).alias(f"c{k}")
                  for k, i in targets.items()]
        found = running.agg(*wanted).first()
        for k, i in targets.items():
            out[k] = found[f"c{k}"] if found[f"c{k}"] is not None else laid.parts[i] + 1 << _ROW_BITS
    return [_whole(laid, running, place, k, shards) for k, place in sorted(out.items())]


def _whole(laid: Laid, running: DataFrame, place: int, k: int, shards: int) -> int:
    """The cut k, moved to an end of the group of equal texts that it parts, if that group is small."""
    at = laid.rows.filter(F.col("place") >= place).orderBy("place").limit(1).select("digest").first()
    if at is None:
        return place
    group = laid.rows.filter(F.col("digest") == at.digest).agg(F.min("place").alias("low"), F.max("place").alias("high"), F.sum("size").alias("bytes")).first()
    if group.low >= place or group.bytes > laid.largest:
        return place
    i = laid.parts.index(_partition(group.low))
    before = _running(laid, [laid.parts[i]]).filter(F.col("place") == group.low).first().before + laid.first_byte[i]
    return group.low if (2 * before + group.bytes) * shards >= 2 * k * laid.total else group.high + 1


def _shard(place: Column, begin: list[int]) -> Column:
    out = F.lit(0)
    for c in begin:
        out = out + (place >= c).cast("int")
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(row struct of the columns `keep`, size, text_crc32, law, shard, slot, grown_shard) of every row.

    `size` is the text's bytes plus one, a null text being an empty one; `slot`
    numbers the rows of a shard from 0 in the global order. Under this law a row's
    shard depends on all other rows, so `grown_shard` is null. Null ids come before
    others of the same text; repeated rows stand together and are dealt one by one,
    like any group of equal texts that is larger than the largest document. More
    shards than bytes: some stay empty. No rows: an empty result.
    """
    laid = lay_out(docs, keep)
    begin = cuts(laid, shards)
    spark, place = docs.sparkSession, F.col("place")
    part = F.shiftright("place", _ROW_BITS)
    offsets = spark.createDataFrame(list(zip(laid.parts, laid.first_row)), "part bigint, first_row bigint")
    numbered = (laid.rows.withColumn("part", part).join(F.broadcast(offsets), "part")  # one row for each partition
                .withColumn("number", F.col("first_row") + place.bitwiseAND((1 << _ROW_BITS) - 1)).withColumn("shard", _shard(place, begin)))
    firsts = {r.shard: r.first for r in numbered.groupBy("shard").agg(F.min("number").alias("first")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for pair in firsts.items() for x in pair]), F.col("shard")) if firsts else F.lit(0)
    return numbered.select("row", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("number") - first).alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> str:
    """All columns of all rows as Parquet, a folder for each shard; returns the name of the shard column.

    The rows already lie in the order of the shards, so nothing is shuffled again.
    """
    name = free_name(docs, "shard")
    rows = sharded(docs, shards, docs.columns).select("row.*", F.col("shard").alias(name))
    rows.write.partitionBy(name).parquet(path)
    return name
