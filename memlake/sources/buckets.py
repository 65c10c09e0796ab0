"""Tables laid out by key, so that joins need no exchange and a delta rewrites only what it names.

A layout is a Spark table bucketed by its keys and partitioned by the bucket's
number. The buckets tell Spark how rows are spread: two tables with the same keys
and number of buckets join where they lie. The partition gives each bucket its own
folder, which a dynamic overwrite replaces while all others stay untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.session import written
from memlake.sources.lake import winners

BUCKET = "bucket_no"
BUCKETS = 64


@dataclass(frozen=True)
class Layout:
    """A bucketed table of the session's catalog over files at `path`."""
    spark: SparkSession
    name: str
    path: str
    keys: tuple[str, ...]
    buckets: int

    def bucket_of(self) -> Column:
        """The number Spark gives the bucket of a row: its hash of the keys, modulo the number of buckets."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def table(self) -> DataFrame:
        """The rows, spread by key: Spark neither shuffles them for a join or aggregation on the keys nor opens buckets that a filter rules out."""
        return self.spark.table(self.name).drop(BUCKET)

    def files(self) -> set[str]:
        return set(self.spark.table(self.name).inputFiles())


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS, name: str | None = None, spread: bool = True) -> Layout:
    """Write rows as a new layout. Rows with null keys are kept, but meet nothing in a join.

    Choose `buckets` so that a bucket fits a task or two: a key that holds very many
    rows stays in one bucket, so the keys should be those of a table that has each
    of them once or a few times. `spread=False` is for rows that lie by bucket already.
    """
    name = name or f"layout_{uuid.uuid4().hex}"
    number = F.pmod(F.hash(*keys), F.lit(buckets))
    dealt = rows.repartition(buckets, *keys) if spread else rows  # one task a bucket: partitioning and bucketing use the same hash
    (dealt.withColumn(BUCKET, number).write.format("parquet").option("path", path).option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return Layout(rows.sparkSession, name, path, tuple(keys), buckets)


def attach(spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS, name: str | None = None) -> Layout:
    """A layout that another session wrote, by its folder and what it was created with."""
    name = name or f"layout_{uuid.uuid4().hex}"
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"create table `{name}` ({schema}, `{BUCKET}` int) using parquet options (partitionOverwriteMode 'dynamic') "
              f"partitioned by (`{BUCKET}`) clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    spark.catalog.recoverPartitions(name)
    return Layout(spark, name, path, tuple(keys), buckets)


def merged(layout: Layout, delta: DataFrame, version: str) -> tuple[DataFrame, list[int]]:
    """The rows of the buckets that a delta names, after insert-or-replace, and the numbers of these buckets.

    Per key the highest version wins, of equal ones the row whose content hashes
    highest, as in `lake.upsert_latest`. Only the delta is shuffled; the base is
    read bucket by bucket where it lies. Rows with a null key, which no join
    brings together, are compared apart.
    """
    keys = list(layout.keys)
    rest = [c for c in layout.table().columns if c not in keys]
    delta = written(winners(delta.select(*keys, *rest), keys, version), "delta")
    named = sorted(r[0] for r in delta.select(layout.bucket_of().alias("b")).distinct().collect())
    order = F.struct(F.col(version), F.xxhash64(*[F.col(c) for c in rest]))
    touched = layout.spark.table(layout.name).filter(F.col(BUCKET).isin(named)).drop(BUCKET)
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])

    def packed(rows: DataFrame, side: str) -> DataFrame:
        return rows.filter(whole).select(*keys, F.struct(*rest).alias(f"row_{side}"), order.alias(f"order_{side}"))
    both = packed(touched, "old").join(packed(delta.repartition(layout.buckets, *keys), "new"), keys, "full_outer")
    newer = F.col("order_new").isNotNull() & (F.col("order_old").isNull() | (F.col("order_new") > F.col("order_old")))
    row = F.when(newer, F.col("row_new")).otherwise(F.col("row_old"))
    out = both.select(*keys, row.alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in rest])
    if not delta.filter(~whole).isEmpty():
        out = out.unionByName(winners(touched.filter(~whole).unionByName(delta.filter(~whole)), keys, version).select(*out.columns))
    elif named:
        out = out.unionByName(touched.filter(~whole).select(*out.columns))
    return out, named


def stage(layout: Layout, delta: DataFrame, version: str, path: str) -> Layout | None:
    """The new content of the buckets that a delta names, as a layout of its own at `path`; None where it names none."""
    rows, named = merged(layout, delta, version)
    return create(rows, path, layout.keys, layout.buckets, spread=False) if named else None


def apply(layout: Layout, staged: Layout) -> list[int]:
    """Replace the buckets of a layout by the staged ones, and return their numbers.

    Nothing else of the table is written. Folders are replaced one after the other, so
    a run that is cut off is repeated from the staged rows, as often as need be.
    """
    spark = layout.spark
    columns = spark.table(layout.name).columns
    rows = spark.table(staged.name)
    rows.select(*columns).write.mode("overwrite").insertInto(layout.name)
    spark.catalog.refreshTable(layout.name)
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def upsert(layout: Layout, delta: DataFrame, version: str, path: str) -> list[int]:
    """Insert-or-replace rows of a layout by way of `path`; rewrites the buckets that the delta names and returns their numbers."""
    staged = stage(layout, delta, version, path)
    return [] if staged is None else apply(layout, staged)
