"""Ordered computations that stay parallel when one key holds a third of all rows.

A plain window over a hot key sorts that key in one task. These helpers cut the
rows into slots of bounded size along (key, order), work inside a slot, and
carry only small per-slot summaries from one slot to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.session import checkpointed, written

SLOT = "_slot"
ROWS_PER_SLOT = 200_000
CELLS = 4096
BLOCK_CHARS = 1_000_000


def by_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Rows with a slot number that follows (keys, order), about `rows_per_slot` rows each.

    Slots are the parts of a range partitioning, so equal keys and equal times
    are cut as well, wherever `order` ends with something unique. A table that
    fits one slot is left as it is. The parts are stored, since their numbers must
    not change between the uses of a slot.
    """
    slots = -(-df.count() // rows_per_slot)
    if slots <= 1:
        return df.withColumn(SLOT, F.lit(0))
    cut = df.repartitionByRange(slots, *[F.col(k) for k in keys], *order)
    return checkpointed(cut.withColumn(SLOT, F.spark_partition_id()))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str,
                  rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Inclusive running total of an integer value per key in `order`."""
    keys = list(keys)
    staged = by_rows(df.withColumn("_v", value), keys, order, rows_per_slot)
    before = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*keys, SLOT).agg(F.sum("_v").alias("_t"))
        .select(*keys, SLOT, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before")))
    inside = (Window.partitionBy(*keys, SLOT).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (staged.join(offsets, [*keys, SLOT]).withColumn(out, F.sum("_v").over(inside) + F.col("_before"))
            .drop("_v", "_before", SLOT))


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str,
                 rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """1-based position of every row in its key's order."""
    return running_total(df, keys, order, F.lit(1), out, rows_per_slot)


def text_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str, block_chars: int = BLOCK_CHARS,
                sep: str = " ", rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """The texts of each key joined in `order`, as rows of bounded size: keys, `block_no` from 0, `text`.

    A text stands in the block where the characters before it, separators included, place it, so
    a block is less than `block_chars` and one text; numbers rise and pass over blocks that one long text
    fills. Blocks joined by `sep` give the whole. Null texts and null keys have no block; `order` is unique in a key.
    """
    keys = list(keys)
    size = (F.length(text) + len(sep)).cast("long")
    placed = running_total(df.filter(F.col(text).isNotNull()), keys, order, size, "_upto", rows_per_slot)
    lines = F.array_sort(F.collect_list(F.struct("_upto", F.col(text).alias("t"))))
    return placed.groupBy(*keys, F.floor((F.col("_upto") - size) / block_chars).cast("int").alias("block_no")).agg(
        F.array_join(F.transform(lines, lambda s: s["t"]), sep).alias("text"))


def global_position(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position of every row in the order of the whole table, which ends with something unique.

    Rows are sorted across partitions and stored with their number inside the
    partition; each partition's offset comes from the partitions' row counts, one row each.
    """
    laid = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return laid.join(F.broadcast(offsets), "_part").withColumn(out, number).select(*df.columns, out)


def with_preceding(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
                   rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Prepend to every slot the last n rows of its key before it, flagged `_carried`.

    A window frame of n preceding rows over (key, slot) then sees what it
    would over the key. Every slot keeps at most its last n rows, and n
    non-empty slots hold at least n rows, so looking back n slots is exact.
    """
    keys = list(keys)
    df = by_rows(df, keys, [F.col(c) for c in order], rows_per_slot)
    newest = Window.partitionBy(*keys, SLOT).orderBy(*[F.col(c).desc() for c in order])
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys and c != SLOT])
    tails = (
        df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
        .groupBy(*keys, SLOT)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_rn"), row.alias("r"))), asc=False).alias("_tail"))
    )
    back = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(-n, -1)
    carried = (
        tails.withColumn("_prev", F.flatten(F.collect_list("_tail").over(back)))
        .withColumn("_prev", F.slice("_prev", F.greatest(F.size("_prev") - n, F.lit(0)) + 1, F.lit(n)))
        .select(*keys, SLOT, F.explode("_prev").alias("_p"))
        .select(*keys, SLOT, "_p.r.*", F.lit(True).alias("_carried"))
    )
    return df.withColumn("_carried", F.lit(False)).unionByName(carried)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float],
                      rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Linear-interpolated percentiles per key, all from one pass, without gathering a key's values.

    Equal values are counted together first, so neither ties nor outliers make a
    large slot. Keys without a value have none of the percentiles.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_m"))
    placed = running_total(counts, keys, [F.col("_x")], F.col("_m"), "_end", rows_per_slot)
    total = counts.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    rows = placed.join(total, keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_m") <= rank), F.col("_x")))

    def percentile(p: float) -> Column:
        pos = (F.col("_n") - 1) * F.lit(min(max(p, 0.0), 1.0))
        share = F.max(pos - F.floor(pos))
        return at(F.floor(pos)) * (1 - share) + at(F.ceil(pos)) * share
    return rows.groupBy(*keys).agg(*[percentile(p).alias(out) for out, p in wanted.items()])


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str,
                     rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    return exact_percentiles(df, keys, value, {out: p}, rows_per_slot)


def value_at_rank(df: DataFrame, value: str, rank: Callable[[int], int]) -> int | None:
    """The value at a 0-based ascending rank of a whole long column; `rank` gets the number of values.

    Each scan counts at most CELLS cells of the range that is left, and only those
    counts reach the driver; a range of microseconds over a century takes five scans.
    """
    src = df.select(F.col(value).cast("bigint").alias("_x")).filter("_x is not null")
    low, high, n = src.agg(F.min("_x"), F.max("_x"), F.count("*")).first()
    left = rank(n)
    if not 0 <= left < n:
        return None
    while low < high:
        width = max(1, -(-(high - low + 1) // CELLS))
        cell = F.floor((F.col("_x") - low) / width)
        counts = src.filter(F.col("_x").between(low, high)).groupBy(cell.alias("c")).count().collect()
        for c, m in sorted((r.c, r["count"]) for r in counts):
            if left < m:
                low, high = low + c * width, min(high, low + (c + 1) * width - 1)
                break
            left -= m
    return low


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  out: str = "rn") -> DataFrame:
    """First n rows per key; Spark cuts each map task to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
