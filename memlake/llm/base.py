"""What the operators share: stored intermediate tables, labelled samples, row-wise Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.session import shared_folder, short_batches

SLICE_ROWS = 256


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only, so that other columns, whatever their names, stay out; a null text is an empty one."""
    short_batches(df.sparkSession)
    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def by_row(fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: pa.Schema, rows: int = 512):
    """For mapInArrow: `fn` takes the rows of a partition as tuples and gives tuples, which leave `rows` at a time."""
    def run(batches):
        def each():
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):  # a slice at a time: whole batches of long texts are large
                    yield from zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns])
        held: list[tuple] = []

        def out():
            cols = zip(*held) if held else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema)], schema=schema)
        for row in fn(each()):
            held.append(row)
            if len(held) >= rows:
                yield out()
                held.clear()
        if held:
            yield out()
    return run


def text_column(spark: SparkSession, start: Callable[[], Callable[[list], list]], ddl: str, kind: pa.DataType):
    """A column function of one text column, for stages that keep every other column as it is.

    `start` is called once a task and gives what turns a list of texts (nulls
    included) into as many values. Only the texts go to Python and only the values
    come back, so the names and types of other columns never matter.
    """
    short_batches(spark)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        values = start()
        for part in parts:
            out = [pa.array(values(part.slice(at, SLICE_ROWS).to_pylist()), kind) for at in range(0, len(part), SLICE_ROWS)]
            yield pa.concat_arrays(out) if out else pa.array([], kind)
    return F.arrow_udf(run, ddl)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 1 on division by three."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, even: bool = False) -> DataFrame:
    """At most `bound` labelled documents in an order by hash: (doc_id, y, weight, text), none of them held out.

    Repeated labels of one document are averaged, ties count as 1; null labels
    are left out. Of several texts of one doc_id the one with the least hash counts, so
    there are never more rows than ids. With `even`, each of the two labels has at most half of the
    bound, and `weight` is how many labelled rows each sampled one stands for.
    The ids are bounded, so broadcasting them is safe at any size of the corpus.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
             .filter(~held_out(F.col("doc_id"))))

    def first(rows: DataFrame, most: int, share: float) -> DataFrame:
        return rows.withColumn("weight", F.lit(share)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    if even:
        half = bound // 2
        sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
        ids = (first(known.filter("y = 0"), half, max(1.0, sizes.get(0, 0) / half))
               .unionByName(first(known.filter("y = 1"), half, max(1.0, sizes.get(1, 0) / half))))
    else:
        ids = first(known, bound, 1.0)
    rows = text_rows(docs).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y", "weight").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
