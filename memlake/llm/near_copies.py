"""Near-copies by SimHash fingerprints and vantage-point trees.

Fingerprints are 64 bits over word shingles. Two texts are linked when their
fingerprints differ in few bits. A tree of vantage points, drawn from a bounded
sample, deals distinct fingerprints to shards by Hamming distance; a fingerprint
whose ball reaches across a boundary also visits the shard beyond it, so no pair
within the radius is lost. Inside a shard two more vantage distances narrow the
rows that a fingerprint is compared with. The corpus pipeline verifies such links by exact
similarity and adds the pairs beyond the radius (`similar_texts`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from memlake.llm import similar_texts
from memlake.llm.base import all_columns, by_row, free_name, stored, text_column, text_rows
from memlake.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
LEAF_ROWS = 65_536
TREE_SAMPLE = 65_536
_CHUNK = 1 << 16
_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text; 0 for a text without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate([[0], ends + 1])
    ends = np.concatenate([ends, [len(line)]])
    if len(parts) > words:
        starts, ends = starts[:len(parts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; texts are hashed whole, one row at a time."""
    def each(rows):
        for doc_id, text in rows:
            yield doc_id, fingerprint(text)
    return text_rows(docs).mapInArrow(by_row(each, _PRINTS, 8192), "doc_id bigint, fp bigint")


@dataclass
class Tree:
    """Flat vantage-point tree: a node is a leaf (shard number) or a vantage point with a radius and two children."""
    point: list[int]
    radius: list[int]
    inner: list[int]
    outer: list[int]
    leaf: list[int]


def _far(a, b):
    return np.bitwise_count(np.bitwise_xor(a, b))


def plant(sample: np.ndarray, total: int, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over a sample of `total` fingerprints.

    Of a few sampled points the one with the widest spread of distances becomes
    the vantage point, the median distance its radius. A node is not split once
    its share of all rows fits a shard, or when a split would send nearly every
    row both ways (a dense clump has no boundary worth drawing).
    """
    tree = Tree([], [], [], [], [])
    share = total / max(1, len(sample))
    shards = 0
    todo = [(sample, None, None)]
    while todo:
        rows, parent, side = todo.pop()
        me = len(tree.leaf)
        if parent is not None:
            getattr(tree, side)[parent] = me
        split = None
        if len(rows) * share > leaf_rows and len(rows) >= 16:
            picks = rows[:: max(1, len(rows) // 8)][:8]
            far = _far(picks[:, None], rows[None, :]).astype(np.int32)
            best = int(far.var(axis=1).argmax())
            d, mid = far[best], int(np.median(far[best]))
            reach = (d <= mid + radius) & (d > mid - radius)
            if 0 < (d <= mid).sum() < len(rows) and reach.mean() < 0.95:
                split = picks[best], mid, d <= mid
        tree.point.append(int(split[0]) if split else 0)
        tree.radius.append(split[1] if split else 0)
        tree.inner.append(-1)
        tree.outer.append(-1)
        tree.leaf.append(-1 if split else shards)
        if split is None:
            shards += 1
        else:
            todo += [(rows[split[2]], me, "inner"), (rows[~split[2]], me, "outer")]
    return tree


def route(prints: np.ndarray, tree: Tree, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, positions, at home): each row has one home; it visits other shards where the triangle bound allows a partner.

    A pair across a boundary meets in the inner shard, so only outer rows cross at first;
    a row that visits follows every branch its ball reaches.
    """
    none = np.empty(0, np.int64)
    todo = [(0, np.arange(len(prints)), none)]
    while todo:
        node, home, guest = todo.pop()
        if tree.leaf[node] >= 0:
            if len(home):
                yield tree.leaf[node], home, True
            if len(guest):
                yield tree.leaf[node], guest, False
            continue
        point, mid = np.uint64(tree.point[node]), tree.radius[node]
        d, g = _far(prints[home], point).astype(np.int32), _far(prints[guest], point).astype(np.int32)
        inside = d <= mid
        todo.append((tree.inner[node], home[inside], np.concatenate([guest[g <= mid + radius], home[~inside & (d <= mid + radius)]])))
        todo.append((tree.outer[node], home[~inside], guest[g > mid - radius]))


class _Shard:
    """Rows ordered by their distances to two vantage points; a ball touches a few runs of them."""

    def __init__(self, rows: np.ndarray, first: np.uint64, second: np.uint64):
        self.first, self.second = first, second
        key = _far(rows, first).astype(np.int64) * 65 + _far(rows, second)
        order = np.argsort(key, kind="stable")
        self.rows, self.key = rows[order], key[order]
        self.start = np.searchsorted(self.key, np.arange(65 * 65 + 1))

    def near(self, row: np.uint64, radius: int) -> np.ndarray:
        a, b = int(_far(row, self.first)), int(_far(row, self.second))
        lo, hi = max(0, b - radius), min(64, b + radius)
        runs = [(self.start[x * 65 + lo], self.start[x * 65 + hi + 1]) for x in range(max(0, a - radius), min(64, a + radius) + 1)]
        runs = [r for r in runs if r[0] < r[1]]
        if not runs:
            return np.empty(0, np.int64)
        rows = np.concatenate([self.rows[x:y] for x, y in runs])
        hit = np.flatnonzero(_far(rows, row) <= radius)
        if not len(hit):
            return hit
        ends = np.cumsum([y - x for x, y in runs])
        run = np.searchsorted(ends, hit, side="right")
        return hit + np.array([x for x, _ in runs])[run] - np.concatenate([[0], ends[:-1]])[run]


def shard_links(home: np.ndarray, guest: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the same rows as all links of the shard do, one for each row reached.

    Rows are visited outwards from one row at a time, and a row once reached is
    not reached again, so a clump of n rows gives n - 1 links. Reached rows are
    squeezed out once they are half of the shard.
    """
    rows = np.concatenate([home, guest])
    own = np.concatenate([np.ones(len(home), bool), np.zeros(len(guest), bool)])
    if not len(home) or len(rows) < 2:
        return []
    first = rows[0]
    second = rows[int(np.abs(_far(rows, first).astype(np.int32) - 32).argmin())]
    order = np.argsort(_far(rows, first).astype(np.int64) * 65 + _far(rows, second), kind="stable")
    rows, own = rows[order], own[order]
    shard, free = _Shard(rows, first, second), np.ones(len(rows), bool)
    links: list[tuple[int, int]] = []
    at, reached = 0, 0
    while at < len(shard.rows):
        if not (own[at] and free[at]):
            at += 1
            continue
        free[at] = False
        reached += 1
        queue = [shard.rows[at]]
        while queue:
            row = queue.pop()
            hits = shard.near(row, radius)
            hits = hits[free[hits]]
            free[hits] = False
            reached += len(hits)
            found = shard.rows[hits]
            links += [(int(row), int(x)) for x in found]
            queue += list(found)
            if reached > 4096 and 2 * reached > len(shard.rows):
                before = own[:at] & free[:at]
                at = int(free[:at].sum()) if at else 0
                assert not before.any()
                left, own = shard.rows[free], own[free]
                shard, free, reached = _Shard(left, first, second), np.ones(len(left), bool), 0
    return links


def _deal(tree: Tree, radius: int):
    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at, home in route(prints, tree, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard, np.int32)), pa.array(prints[at].view(np.int64)), pa.array(np.full(len(at), home))],
                    names=["shard", "fp", "home"])
    return run


def _link(radius: int):
    def run(table: pa.Table) -> pa.Table:
        prints = np.sort(table.column("fp").to_numpy().view(np.uint64))
        home = np.sort(table.filter(table.column("home")).column("fp").to_numpy().view(np.uint64))
        pairs = np.array(shard_links(home, np.setdiff1d(prints, home, assume_unique=True), radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})
    return run


def links(prints: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, sample: int = TREE_SAMPLE) -> DataFrame:
    """(u, v): links between distinct fingerprints, enough to join all that lie within the radius of each other.

    `prints` holds distinct fingerprints in `fp`. The tree is grown from at
    most `sample` of them, 16 for each shard, in an order by hash.
    """
    total = prints.count()
    want = min(sample, max(1024, 16 * total // leaf_rows))
    drawn = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(want).toArrow().column("fp").to_numpy().view(np.uint64)
    tree = plant(drawn, total, radius, leaf_rows)
    dealt = prints.select("fp").mapInArrow(_deal(tree, radius), "shard int, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInArrow(_link(radius), "u bigint, v bigint")


def near_copies(docs: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): every row with its fingerprint and the least doc_id that links lead to.

    Equal fingerprints meet before anything else (partial counts in the map
    tasks), so thousands of copies cost one row. Repeated rows come out as often
    as they went in. A null text is an empty one; texts without words have
    fingerprint 0 and link like any other. A null doc_id keeps its row and never
    names a component (which is null if it has no other id). Only doc_id and text
    are read. No rows: an empty result.
    """
    rows = stored(fingerprints(docs), "prints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, radius, leaf_rows))
    joined = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least")
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = joined.join(named, "root").select("fp", "component_id")
    alone = distinct.join(of_linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return rows.join(of_linked.unionByName(alone), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, words: int = similar_texts.WORDS, similarity: float = similar_texts.SIMILARITY) -> DataFrame:
    """One row of `docs` of each group of near-copies, the one with the least doc_id; all columns.

    Near-copies are texts whose shingles of `words` words have an exact weighted
    similarity of `similarity` or more: those that the tree over their fingerprints links, and
    those beyond its radius that bands find. The choice is by row: of rows with equal
    doc_id in one group the least hash of the whole row stays, and rows with equal
    doc_id whose texts are no near-copies all stay. Rows without a doc_id take part
    like any other and come after all that have one.
    """
    node, row = free_name(docs, "node"), free_name(docs, "row")

    def start():
        return lambda texts: [similar_texts.node_of(similar_texts.split(t or "")) for t in texts]
    marked = docs.withColumns({node: text_column(docs.sparkSession, start, "bigint", pa.int64())(F.col("text")), row: F.xxhash64(*all_columns(docs.columns))})
    rows = stored(marked.select(F.col(node).alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(row).alias("row")), "rows")
    rooted = rows.join(similar_texts.groups(docs, links, words, similarity), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "node")
    chosen = rooted.groupBy("root").agg(F.min(first).alias("least")).select(F.col("least.node").alias(node), F.col("least.row").alias(row))
    return marked.join(chosen, [node, row], "left_semi").dropDuplicates([node, row]).select(*all_columns(docs.columns))
