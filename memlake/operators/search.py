"""Exact vector search for many queries over many events, and candidate handling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions import scoring
from memlake.operators import cells
from memlake.operators.cells import HITS, PASS_BYTES, CellIndex, pointing, unit_rows, unit_rows_of
from memlake.operators.ordered import first_per_key, value_at_rank

#: Rows that a task holds for the queries of a pass, and queries whose rows it gives at once.
PASS_ROWS = 4_000_000
BLOCK_QUERIES = 4096
#: Events that are compared at once, and how many queries and events meet in one product.
EVENT_ROWS = 32_768
ASKED_BLOCK = 128
EVENT_BLOCK = 8192
#: Products of queries and events that are held at once where queries pass by the events.
CELL_ROWS = 2_000_000


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of a list column that are there and not NaN, and their directions, one a row."""
    held = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(held):
        return held, np.empty((0, 0))
    lists = column.drop_null()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if size.min() != size.max():
        raise ValueError("vectors of one band differ in length")
    unit = unit_rows_of(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(held), size[0]))
    fine = np.isfinite(unit).all(axis=1)
    return held[fine], unit[fine]


def _places(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values, looked for eight at a time."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    word, bit = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + bit, whole + np.flatnonzero(flat[whole:])])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row and to 12 places, so that equal vectors tie wherever they stand."""
    return np.round(np.einsum("ij,ij->i", a, b), 12)


def _bytes(ids: np.ndarray) -> np.ndarray:
    """Ids as UTF-8, which orders as Spark does; of fixed width unless an id ends with what the width would drop."""
    out = pc.cast(pa.array(ids, pa.string()), pa.binary()).to_numpy(zero_copy_only=False)
    return out if any(x.endswith(b"\x00") for x in out) else out.astype("S")


class _Nearest:
    """The k best rows of each query so far, of all queries of a band in one table.

    Products are made in single precision for a block of queries and events; only what reaches the worst row of a
    query within the error of such a product is made again in double precision. Scores count to 12
    places, so that equal vectors tie wherever they stand in a batch, and of ties the smaller id stays.
    """

    def __init__(self, names: np.ndarray, matrix: np.ndarray, k: int):
        self.names, self.matrix, self.small, self.k = names, matrix, matrix.astype(np.float32), k
        # of a sum of d products of components of unit vectors, each rounded
        self.error = np.float32((matrix.shape[1] + 16) * 1.2e-7 + 1e-9)
        self.score = np.full((len(matrix), k), -np.inf)
        self.ids = np.zeros((len(matrix), k), dtype="S1")
        self.last = np.zeros(len(matrix), dtype="S1")
        self.floor = np.full(len(matrix), -np.inf)

    def see(self, ids: np.ndarray, unit: np.ndarray) -> None:
        if not len(ids):
            return
        small = unit.astype(np.float32)
        if ids.dtype == object or ids.dtype.itemsize > self.ids.dtype.itemsize:
            wide = np.result_type(self.ids.dtype, ids.dtype)
            self.ids, self.last = self.ids.astype(wide), self.last.astype(wide)
        for at in range(0, len(self.matrix), ASKED_BLOCK):
            low = self.floor[at:at + ASKED_BLOCK].astype(np.float32) - self.error
            q, e = [], []
            for first in range(0, len(small), EVENT_BLOCK):
                near = self.small[at:at + ASKED_BLOCK] @ small[first:first + EVENT_BLOCK].T
                new = np.flatnonzero(np.isneginf(low))
                if len(new) and near.shape[1] >= self.k:
                    low[new] = np.partition(near[new], near.shape[1] - self.k, axis=1)[:, -self.k] - 2 * self.error
                row, col = np.divmod(_places(near >= low[:, None]), near.shape[1])
                q.append(row + at)
                e.append(col + first)
            q, e = np.concatenate(q), np.concatenate(e)
            if len(q):
                self._meet(q, _cosines(self.matrix[q], unit[e]), ids[e])

    def _meet(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = score > self.floor[q]
        tie = np.flatnonzero(score == self.floor[q])
        better[tie[ids[tie] < self.last[q[tie]]]] = True
        if not better.any():
            return
        touched, row = np.unique(q[better], return_inverse=True)
        held_row, held_at = np.nonzero(np.isfinite(self.score[touched]))
        row = np.concatenate([held_row, row])
        score = np.concatenate([self.score[touched[held_row], held_at], score[better]])
        ids = np.concatenate([self.ids[touched[held_row], held_at], ids[better]])
        order = np.lexsort((-score, row))
        row, score, ids = row[order], score[order], ids[order]
        begin = np.searchsorted(row, np.arange(len(touched)))
        count = np.diff(np.append(begin, len(row)))
        full = count >= self.k
        worst = np.where(full, score[np.minimum(begin + self.k - 1, len(row) - 1)], -np.inf)
        keep = score > worst[row]
        tied = np.flatnonzero(score == worst[row])
        tied = tied[np.lexsort((ids[tied], row[tied]))]
        of = row[tied]
        place = np.arange(len(tied)) - np.searchsorted(of, of)
        room = self.k - np.bincount(row[keep], minlength=len(touched))
        stays = tied[place < room[of]]
        keep[stays] = True
        self.last[touched[row[stays]]] = ids[stays]  # in the order of ids, so the largest one is left
        row, score, ids = row[keep], score[keep], ids[keep]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.score[touched] = -np.inf
        self.score[touched[row], place] = score
        self.ids[touched[row], place] = ids
        self.floor[touched] = worst

    def rows(self, band: str) -> Iterator[pd.DataFrame]:
        """The rows of a block of queries at a time as lists; `far` is the score turned round, so lists sort from the best on."""
        for at in range(0, len(self.names), BLOCK_QUERIES):
            names, score = self.names[at:at + BLOCK_QUERIES], self.score[at:at + BLOCK_QUERIES]
            held = np.isfinite(score)
            ends = np.cumsum(held.sum(axis=1))[:-1]
            ids = np.array([x.decode() for x in self.ids[at:at + BLOCK_QUERIES][held].tolist()], dtype=object)
            yield pd.DataFrame({"band": band, "query_id": names, "far": np.split(0.0 - score[held], ends), "ids": np.split(ids, ends)})


def _of_bands(queries: DataFrame, bands: Sequence[str]) -> DataFrame:
    vec = lambda b: F.col(b).cast("array<double>")
    return queries.select(*[c for c in queries.columns if c not in bands], *[F.when(pointing(vec(b)), vec(b)).alias(b) for b in bands])


def _row_bytes(size, bands: Sequence[str]) -> int:
    return max(1, sum(8 * max(size[b] or 0, 0) for b in bands))


def bands_topk(queries: DataFrame, events: DataFrame, k: int, bands: Sequence[str]) -> DataFrame:
    """Exact cosine top-k (`band`, `query_id`, `event_id`, `score`, `rank`) of every query over every event, all bands in one scan.

    Queries are the small side: they go to the tasks in blocks of at most about
    PASS_BYTES that find at most about PASS_ROWS rows, one pass over the events each; each pass
    reads the events anew, in a task for every core, and stores none of them: a task gives
    k rows per query, so more tasks would only give more rows to throw away. They leave a task as one list a
    query and band and meet once, by query.
    A null or zero vector has no direction and takes no part in its band.
    """
    spark = events.sparkSession
    q = _of_bands(queries.select("query_id", *bands), bands)
    size = q.agg(F.count("*").alias("n"), *[F.max(F.size(b)).alias(b) for b in bands]).first()
    passes = max(1, -(-size.n * _row_bytes(size, bands) // PASS_BYTES), -(-size.n * k * len(bands) // PASS_ROWS))
    held = _of_bands(events.select("event_id", *bands), bands).coalesce(max(1, spark.sparkContext.defaultParallelism))
    local = None
    for i in range(passes):
        part = q if passes == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        rows = part.toArrow()
        names, blocks = rows.column("query_id").to_numpy(), {}
        for b in bands:
            at, unit = _vectors(rows.column(b).combine_chunks())
            if len(at):
                blocks[b] = names[at], unit
        if blocks:
            found = _pass(held, spark.sparkContext.broadcast(blocks), k)
            local = found if local is None else local.unionByName(found)
    if local is None:
        return spark.createDataFrame([], HITS + ", rank int")
    lists = lambda b: F.flatten(F.collect_list(F.when(F.col("band") == b, F.col("near"))))
    best = local.groupBy("query_id").agg(*[F.slice(F.array_sort(lists(b)), 1, k).alias(f"near_{b}") for b in bands])
    each = best.select("query_id", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"near_{b}").alias("near")) for b in bands])).alias("b"))
    rows = each.select("query_id", "b.band", F.posexplode("b.near").alias("pos", "hit"))
    return rows.select("band", "query_id", "hit.event_id", (0.0 - F.col("hit.far")).alias("score"), (F.col("pos") + 1).alias("rank"))


def _pass(events: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {b: _Nearest(names, matrix, k) for b, (names, matrix) in shared.value.items()}

        def see(batch: pd.DataFrame) -> None:
            ids = _bytes(batch.event_id.to_numpy(dtype=object))
            for b, near in best.items():
                held = np.flatnonzero(batch[b].notna().to_numpy())
                if len(held):
                    unit = unit_rows(batch[b].to_numpy()[held])
                    fine = np.isfinite(unit).all(axis=1)
                    near.see(ids[held[fine]], unit[fine])

        held, n = [], 0
        for batch in batches:
            held, n = held + [batch], n + len(batch)
            if n >= EVENT_ROWS:
                see(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            see(pd.concat(held, ignore_index=True))
        for b, near in best.items():
            yield from near.rows(b)
    found = events.mapInPandas(run, "band string, query_id string, far array<double>, ids array<string>")
    return found.select("band", "query_id", F.arrays_zip("far", F.col("ids").alias("event_id")).alias("near"))


def fused_topk(queries: DataFrame, source: DataFrame | CellIndex, n: int, bands: Sequence[str], cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """(query_id, event_id, score): rank fusion of the n nearest events of each band, and of these the n best of each query.

    A band without a vector takes no part. The smaller side goes to the tasks: where queries would need several passes and
    the events fit one, queries pass by the events, each is finished in its task and nothing is shuffled but their vectors.
    """
    best = None
    if not isinstance(source, CellIndex):
        best = _by_queries(queries, source, n, bands, cfg)
    if best is None:
        hits = nearest(queries, source, n, bands)
        fused = hits.groupBy("query_id", "event_id").agg(F.sum(1 / (cfg.rrf_k + F.col("rank"))).alias("score"))
        best = first_per_key(fused, ["query_id"], [F.round("score", 12).desc(), F.col("event_id")], n)
    return best.select("query_id", "event_id", "score")


def _by_queries(queries: DataFrame, events: DataFrame, n: int, bands: Sequence[str], cfg: MemoryConfig) -> DataFrame | None:
    """`fused_topk` by one scan of the queries; None where they fit a pass themselves or the events do not."""
    spark = events.sparkSession
    q = _of_bands(queries.select("query_id", *bands), bands)
    size = q.agg(F.count("*").alias("n"), *[F.max(F.size(b)).alias(b) for b in bands]).first()
    wide = _row_bytes(size, bands)
    if size.n * wide <= PASS_BYTES and size.n * n * len(bands) <= PASS_ROWS:
        return None
    most = PASS_BYTES // wide
    held = events.select("event_id", *bands).limit(most + 1)
    if held.count() > most:
        return None
    rows = _of_bands(events.select("event_id", *bands), bands).toArrow()
    ids = rows.column("event_id").to_numpy()
    _, first, code = np.unique(_bytes(ids), return_index=True, return_inverse=True)
    names, blocks = ids[first], {}
    for b in bands:
        at, unit = _vectors(rows.column(b).combine_chunks())
        order = np.argsort(code[at], kind="stable")
        if len(at):
            blocks[b] = code[at][order], unit[order]
    shared = spark.sparkContext.broadcast((names, blocks))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-size.n * wide // PASS_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, blocks = shared.value
        step = max(1, CELL_ROWS // max([1, *[len(c) for c, _ in blocks.values()]]))
        for batch in batches:
            asked = batch.column("query_id")
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            for b, (code, matrix) in blocks.items():
                at, unit = _vectors(batch.column(b))
                for first in range(0, len(at), step):
                    row, col, place = _first_columns(unit[first:first + step] @ matrix.T, n)
                    found.append((at[first:first + step][row], code[col], 1.0 / (cfg.rrf_k + place + 1)))
            row, event, share = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((event, row))
            row, event, share = row[order], event[order], share[order]
            new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(event) != 0))[:len(row)])
            row, event, score = row[new], event[new], np.add.reduceat(share, new) if len(new) else share
            order = np.lexsort((event, -np.round(score, 12), row))
            row, event, score = row[order], event[order], score[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < n
            yield pa.RecordBatch.from_arrays(
                [asked.take(pa.array(row[kept])), pa.array(names[event[kept]], pa.string()), pa.array(score[kept])], ["query_id", "event_id", "score"])
    return q.repartition(tasks, "query_id").mapInArrow(run, "query_id string, event_id string, score double")


def _first_columns(cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and place from 0 of the k largest cosines of each row, to 12 places; of ties the first columns."""
    cosines = np.round(cosines, 12)
    many = cosines.shape[1]
    least = np.partition(cosines, many - k, axis=1)[:, many - k, None] if many > k else -np.inf
    row, col = np.divmod(np.flatnonzero(cosines >= least), many)
    order = np.lexsort((col, -cosines[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], place[place < k]


def nearest(queries: DataFrame, source: DataFrame | CellIndex, k: int, bands: Sequence[str]) -> DataFrame:
    """The same rows from a table, by one scan of all events, or from an index, by the cells that the bounds leave."""
    return cells.topk(queries, source, k, bands) if isinstance(source, CellIndex) else bands_topk(queries, source, k, bands)


def vector_topk(queries: DataFrame, events: DataFrame | CellIndex, k: int, band: str = "embedding") -> DataFrame:
    """Exact cosine top-k of every query (`query_id`) over every event (`event_id`) in one band."""
    return nearest(queries, events, k, [band]).drop("band")


def band_fusion(queries: DataFrame, events: DataFrame | CellIndex, weights: dict[str, float], n: int,
                cfg: MemoryConfig = DEFAULT, weighting: str = "presence") -> DataFrame:
    """Reciprocal-rank fusion of one search per band; a weight of 0 turns a band off."""
    on = {b: (w if weighting == "scaled" else 1.0) for b, w in weights.items() if w > 0}
    share = F.coalesce(*[F.when(F.col("band") == b, F.lit(w)) for b, w in on.items()])
    hits = nearest(queries, events, n, list(on))
    fused = hits.groupBy("query_id", "event_id").agg(F.sum(share / (cfg.rrf_k + F.col("rank"))).alias("score"))
    return first_per_key(fused, ["query_id"], [F.col("score").desc(), F.col("event_id")], n, "rank").withColumn(
        "distance", F.greatest(F.lit(0.0), 1 - F.col("score")))


def union_hits(hits: DataFrame) -> DataFrame:
    """One row per query and event: the nearest; on equal distance the first route."""
    return hits.groupBy("query_id", "event_id").agg(
        F.min(F.struct("distance", "route")).alias("m")).select("query_id", "event_id", "m.distance", "m.route")


def route_texts(queries: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Search texts of each query (`text`, `shadow`, `hint`): sentence, context, entity anchor."""
    ctx = F.regexp_replace(F.concat(F.right("shadow", F.lit(cfg.shadow_cap)), F.lit("\n"), F.col("text")), r"^\s+|\s+$", "")
    none = F.lit(None).cast("string")
    routes = F.array(
        F.struct(F.lit(0).alias("route"), F.col("text").alias("search_text"), F.col("text").alias("entity_text")),
        F.struct(F.lit(1).alias("route"), F.when((F.length("shadow") > 0) & (ctx != F.col("text")), ctx).otherwise(none).alias("search_text"),
                 ctx.alias("entity_text")),
        F.struct(F.lit(2).alias("route"), F.when(F.length("hint") > 0, F.col("text")).otherwise(none).alias("search_text"),
                 F.col("hint").alias("entity_text")))
    return queries.withColumn("r", F.explode(routes)).select("query_id", "r.*").filter(F.col("search_text").isNotNull())


def hit_hydrate(hits: DataFrame, event: DataFrame) -> DataFrame:
    """Hits with their event rows; invisible events drop out."""
    from memlake.sources.lake import visible_events
    return hits.join(visible_events(event), "event_id")


def active_pool_semi(events: DataFrame, pool: DataFrame, bypass: bool = False) -> DataFrame:
    """Events of the active pool; an empty pool or a bypass restricts nothing."""
    if bypass or pool.isEmpty():
        return events
    return events.join(pool.select("event_id"), "event_id", "left_semi")


def time_boundary(event: DataFrame, capacity: int, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """create_time at position int(n*(1-ratio)) of the living basic events; no row when they fit."""
    live = event.filter(~F.col("is_abstract") & ~F.col("is_tombstoned")).select(
        scoring.micros(F.col("create_time")).alias("us"))
    at = value_at_rank(live, "us", lambda n: int(n * (1 - cfg.global_ratio)) if n > capacity > 0 else -1)
    found = event.sparkSession.createDataFrame([] if at is None else [(at,)], "us bigint")
    return found.select(F.timestamp_micros("us").cast("timestamp_ntz").alias("boundary"))


def capacity_tiers(hits: DataFrame, boundary: Column, event_role: DataFrame, focus: DataFrame,
                   cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Newer events compete freely, older ones need a focus role; nearest 60 of both remain."""
    order = [F.col("distance"), F.col("event_id")]
    newer = first_per_key(hits.filter(boundary.isNull() | (F.col("create_time") >= boundary)), ["query_id"], order, cfg.n_results)
    older = hits.filter(F.col("create_time") < boundary)
    # from the hits to their roles: a focus role of many queries and events would give their product
    tied = (older.select("query_id", "event_id").distinct().join(event_role.select("event_id", "role_id"), "event_id")
            .join(focus.select("query_id", "role_id"), ["query_id", "role_id"], "left_semi").select("query_id", "event_id"))
    older = older.join(tied, ["query_id", "event_id"], "left_semi")
    older = first_per_key(older, ["query_id"], order, cfg.older_results)
    return first_per_key(newer.drop("rn").unionByName(older.drop("rn")), ["query_id"], order, cfg.n_results)


def bypass_grants(best: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Queries whose best score is low, at most the rate per minute (`asked_at` order)."""
    low = best.filter(F.col("best_score") < cfg.bypass_threshold).withColumn("minute", F.date_trunc("minute", "asked_at"))
    return first_per_key(low, ["minute"], [F.col("asked_at"), F.col("query_id")], cfg.bypass_per_minute).drop("rn")
