"""Approximate nearest neighbours along shifted Hilbert curves.

Every vector is projected a number of times onto a few random directions, shifted
at random and put on a grid; its place along the Hilbert curve of that grid is its
key. Spark range-partitions (curve, key), so that ranks along each curve are known,
and each query is measured exactly against the vectors in a window of ranks
around its own. The windows of all curves merge, nearest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from memlake.llm.base import stored

CURVES = 16
DIRECTIONS = 8
BITS = 7
SHARE = 0.04
LEAST_WINDOW = 64
BLOCK_ROWS = 2048
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (one row each) along the Hilbert curve; rows x columns of non-negative integers below 2**bits."""
    x = [np.ascontiguousarray(c).astype(np.uint64) for c in cells.T]
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):  # undo the turns of every coarser cube
        q, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - one), turn)
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(level)) & one)
    return key


def curves(size: int, count: int = CURVES, directions: int = DIRECTIONS, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions (orthonormal where there are enough) and a shift in grid widths for each curve."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        d = rng.standard_normal((size, directions))
        d = np.linalg.qr(d)[0] if size >= directions else d / np.linalg.norm(d, axis=0)
        out.append((d, rng.uniform(0, 0.5, directions)))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of the vectors that take part.

    Left out: null ids and vectors, vectors without components, of zero length
    or with a null or non-finite component, and vectors of another size than most have (of
    equally many, the larger size). Repeated ids count with each of their vectors.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    fine = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
                       & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists("vec", lambda x: x != 0))
    size = fine.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine.filter(F.size("vec") == (size.n if size else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _on_curves(lines, low: np.ndarray, high: np.ndarray, bits: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = _matrix(batch.column(1))
            for c, (d, shift) in enumerate(lines):
                unit = (vec @ d - low[c]) / np.maximum(high[c] - low[c], 1e-300)
                cells = np.clip((unit * 0.5 + shift) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(hilbert_keys(cells, bits).view(np.int64)), *batch.columns],
                    names=["curve", "key", "class_id", "vec"])
    return run


def _nearest(k: int, window: int):
    """The k nearest classes of each query of a block, among the rows within the window of its rank."""
    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        asked, rows = table.filter(table.column("asks")), table.filter(pc.invert(table.column("asks")))
        if asked.num_rows and rows.num_rows:
            q, x = _matrix(asked.column("vec")), _matrix(rows.column("vec"))
            rank, ids = rows.column("rank").to_numpy(), rows.column("class_id").to_numpy()
            for row, at, own in zip(q, asked.column("rank").to_pylist(), asked.column("class_id").to_pylist()):
                near = np.flatnonzero(np.abs(rank - at) <= window)
                near = near[np.unique(ids[near], return_index=True)[1]]  # a window may reach into the next curve
                d = np.sqrt(((x[near] - row) ** 2).sum(axis=1))
                if len(d) > k + 1:
                    short = d <= np.partition(d, k)[k]
                    near, d = near[short], d[short]
                first = np.lexsort((ids[near], d))[:k + 1]
                out += [(own, int(i), float(s)) for i, s in zip(ids[near[first]], d[first])]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"asked": pa.array(cols[0], pa.int64()), "class_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})
    return run


def neighbours(vectors: DataFrame, is_query, k: int = 10, count: int = CURVES, share: float = SHARE, block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the curves find for every row for which `is_query` holds.

    Score is the Euclidean distance in double precision on the vectors as given,
    nearest first, ties to the smaller vec_id, the query's own row left out; fewer
    than k rows where there are fewer candidates. Equal vectors are one class with
    its k + 1 least ids (no other member can be among k nearest with ties to the
    smaller id), so thousands of copies fill no window. The window is `share` of
    all classes to each side: vectors that lie alike in all directions, such as
    random ones, need a share, and data of few dimensions much less. Blocks of
    ranks have at most `block` rows, whatever the keys.
    """
    rows = usable(vectors)
    classes = stored(rows.groupBy("vec").agg(F.min("vec_id").alias("class_id"), F.max(is_query(F.col("vec_id"))).alias("asks")), "classes")
    spark = vectors.sparkSession
    total = classes.count()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not total:
        return empty
    size = len(classes.select("vec").first().vec)
    lines = curves(size, count)
    directions = np.concatenate([d for d, _ in lines], axis=1)

    def edges(batches):
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0)) @ directions
                yield pa.RecordBatch.from_arrays([pa.array([y.min(axis=0).tolist()]), pa.array([y.max(axis=0).tolist()])], names=["low", "high"])
    ends = classes.select("vec").mapInArrow(edges, "low array<double>, high array<double>")
    place = ends.select(F.posexplode(F.arrays_zip("low", "high"))).groupBy("pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    span = sorted(place.collect())  # one row for each direction
    low = np.array([r.low for r in span]).reshape(count, -1)
    high = np.array([r.high for r in span]).reshape(count, -1)

    keyed = classes.select("class_id", "vec").mapInArrow(_on_curves(lines, low, high, BITS), "curve int, key bigint, class_id bigint, vec array<double>")
    ranged = keyed.repartitionByRange("curve", "key", "class_id").sortWithinPartitions("curve", "key", "class_id")
    line = stored(ranged.withColumn("place", F.monotonically_increasing_id()), "curves")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = line.groupBy(part.alias("part")).count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = line.withColumn("part", part).join(F.broadcast(before.select("part", "before")), "part").select(
        (F.col("before") + at).alias("rank"), "class_id", "vec")

    window = max(LEAST_WINDOW, int(share * total))
    asked = ranked.join(classes.filter("asks").select("class_id"), "class_id", "left_semi")
    of_block = F.floor(F.col("rank") / block)
    visits = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block), F.floor(F.least(F.col("rank") + window, F.lit(count * total - 1)) / block))
    asked = asked.select(F.explode(visits).alias("block"), "rank", "class_id", "vec", F.lit(True).alias("asks"))
    blocks = asked.unionByName(ranked.select(of_block.alias("block"), "rank", "class_id", "vec", F.lit(False).alias("asks")))
    found = blocks.groupBy("block").applyInArrow(_nearest(k, window), "asked bigint, class_id bigint, score double")
    best = Window.partitionBy("asked").orderBy("score", "class_id")
    found = found.distinct().withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")

    ids = rows.join(classes.select("class_id", F.col("vec").alias("of")), F.col("vec") == F.col("of")).select("class_id", "vec_id").distinct()
    least = Window.partitionBy("class_id").orderBy("vec_id")
    few = ids.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1).select("class_id", "vec_id")
    queries = ids.filter(is_query(F.col("vec_id"))).select(F.col("class_id").alias("asked"), F.col("vec_id").alias("query_id"))
    hits = found.join(queries, "asked").join(few, "class_id").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
