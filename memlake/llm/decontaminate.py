"""Benchmark decontamination: fingerprints of item-sized windows, exact similarity after.

Every window of a document that is as long as a benchmark item gets a 64-bit
SimHash over its five-word shingles. Fingerprints of items are indexed by blocks of
bits: two fingerprints within the radius must agree in one of the blocks up to
a few bits, and the index holds every such variant of every item's block. What
the index finds is verified by the exact weighted similarity of the shingles.
A window without one shingle of an item cannot be similar to it, so only the
neighbourhoods of shared shingles are fingerprinted. A document that is shorter
than an item is one window as a whole.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from memlake.llm.base import by_row, text_column, text_rows

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 17
BLOCKS = 6
ITEMS_AT_ONCE = 5000
_WORD = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())])


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD(text.lower())


def word_id(word: str) -> int:
    """An odd 64-bit number for a word; 0 is no word's."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1) | 1


def shingle_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for every `size` words in a row."""
    n = len(ids) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ ids[i:i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _signs(keys: np.ndarray) -> np.ndarray:
    """One row of 64 steps up or down for each key."""
    return np.unpackbits(keys.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def simhash(keys: np.ndarray) -> int:
    """Every shingle votes as often as it occurs."""
    return int(_pack(_signs(keys).sum(axis=0, keepdims=True))[0])


def window_prints(keys: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of `size` shingles, from running sums."""
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(keys), axis=0, dtype=np.int32)])
    return _pack(sums[size:] - sums[:-size])


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all shingles, each weighing as often as it occurs."""
    if not len(a) and not len(b):
        return 0.0
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[ia], nb[ib]).sum())
    return both / (len(a) + len(b) - both)


class HammingIndex:
    """Finds every indexed fingerprint within `radius` of a given one.

    Of `blocks` blocks of bits, one differs in at most radius // blocks bits
    (else more than the radius would differ in all); every variant of each block
    within that many bits is entered beforehand, so a look-up is one probe a block.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints.astype(np.uint64), radius
        cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
        self.blocks, self.tables = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            flips = np.array([sum(1 << b for b in c) for k in range(radius // blocks + 1) for c in combinations(range(hi - lo), k)], np.uint64)
            part = (self.prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            values = (part[:, None] ^ flips[None, :]).ravel()
            who = np.repeat(np.arange(len(part)), len(flips))
            order = np.argsort(values, kind="stable")
            self.blocks.append((np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)))
            self.tables.append((values[order], who[order]))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query position, item position) of all pairs within the radius, each once."""
        pairs = []
        for (shift, mask), (values, who) in zip(self.blocks, self.tables):
            part = (queries >> shift) & mask
            lo, hi = np.searchsorted(values, part, "left"), np.searchsorted(values, part, "right")
            n = hi - lo
            q = np.repeat(np.arange(len(queries)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            i = who[at]
            ok = np.bitwise_count(queries[q] ^ self.prints[i]) <= self.radius
            pairs.append(q[ok] * len(self.prints) + i[ok])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


class Items:
    """Benchmark items as shingle keys and fingerprints, grouped by window length.

    An item of fewer than five words is one shingle of all its words; an item
    without words matches nothing.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            for w in words:
                self.words.setdefault(w, word_id(w))
            size = min(SHINGLE, len(words))
            keys = shingle_keys(np.array([self.words[w] for w in words], np.uint64), size)
            self.groups.setdefault((size, len(keys)), []).append((item_id, keys))
        self.sizes = {}
        for size in sorted({s for s, _ in self.groups}):
            mine = [np.unique(k) for (s, _), group in self.groups.items() if s == size for _, k in group]
            self.sizes[size] = np.unique(np.concatenate(mine))
        self.lengths = {size: [n for s, n in sorted(self.groups) if s == size] for size in self.sizes}
        self.index = {g: HammingIndex(np.array([simhash(k) for _, k in group], np.uint64)) for g, group in self.groups.items()}
        self.keys = {g: np.unique(np.concatenate([k for _, k in group])) for g, group in self.groups.items()}

    def found(self, text: str) -> list[tuple[int, float, int]]:
        """(item_id, best similarity, first word of that window) of all items that the text holds, by item."""
        get, words = self.words.get, words_of(text)
        ids = np.array([get(w, 0) for w in words], np.uint64)
        best: dict[int, tuple[float, int]] = {}
        every = None
        for size, known in self.sizes.items():
            if len(ids) < size:
                continue
            keys = shingle_keys(ids, size)
            may = np.lib.stride_tricks.sliding_window_view(ids != 0, size).all(axis=1)
            at = np.flatnonzero(may)
            at = at[known[np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)] == keys[at]]
            if not len(at):
                continue
            if every is None:  # the items' words find the places; the words around them vote with their own bits
                every = np.array([i or word_id(w) for i, w in zip(ids.tolist(), words)], np.uint64)
            keys = shingle_keys(every, size)
            for n in self.lengths[size]:
                mine = at[np.isin(keys[at], self.keys[size, n])] if len(self.lengths[size]) > 1 else at
                if len(mine) and len(keys) / n >= SIMILARITY:
                    self._windows(keys, n, mine, size, best)
        return sorted(((i, s, p) for i, (s, p) in best.items()), key=lambda h: (h[0] is not None, h[0]))

    def _windows(self, keys: np.ndarray, n: int, at: np.ndarray, size: int, best: dict) -> None:
        """Fingerprint the windows of n shingles that hold one of the positions `at`, a stretch at a time; a shorter text is one window."""
        group, index = self.groups[size, n], self.index[size, n]
        n = min(n, len(keys))
        lo, hi = np.maximum(at - n + 1, 0), np.minimum(at, len(keys) - n)
        ok = lo <= hi
        lo, hi = lo[ok], hi[ok]
        if not len(lo):
            return
        fresh = np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1] + 1])
        starts = lo[fresh]
        ends = np.maximum.reduceat(hi, np.flatnonzero(fresh))
        for a, b in zip(starts.tolist(), ends.tolist()):
            for c in range(a, b + 1, 1 << 15):
                d = min(b, c + (1 << 15) - 1)
                q, i = index.near(window_prints(keys[c:d + n], n))
                for w, k in zip((q + c).tolist(), i.tolist()):
                    item_id, item = group[k]
                    s = weighted_similarity(keys[w:w + n], item)
                    if s >= SIMILARITY and s > best.get(item_id, (0.0, 0))[0]:
                        best[item_id] = (s, w)


def _parts(benchmark: DataFrame, items: int):
    """Lists of about `items` items, by item_id and text, that keep the texts of one item together; only one list is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    part: list[tuple[int, str]] = []
    for r in rows.distinct().sort("item_id", "text").toLocalIterator():
        if len(part) >= items and r.item_id != part[-1][0]:
            yield part
            part = []
        part.append((r.item_id, r.text))
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): the items that a document holds, with the best window's place.

    The benchmark is the query set: it meets all documents in passes of at most
    `items` items, each broadcast (so what is broadcast does not grow with either
    table). A hit is a window of the item's length in words (the whole text where that
    is shorter) whose fingerprint is
    within RADIUS bits of the item's and whose weighted shingle similarity is
    SIMILARITY or more; of equal windows the first counts. Null texts are empty and
    hold nothing; an item with several texts counts once, by the best; rows of
    equal doc_id are separate rows. Either table empty: an empty result.
    """
    spark = docs.sparkSession
    rows = text_rows(docs)
    out = None
    for part in _parts(benchmark, items):
        shared = spark.sparkContext.broadcast(part)

        def each(batch, shared=shared):
            known = Items(shared.value)
            for doc_id, text in batch:
                for hit in known.found(text):
                    yield doc_id, *hit
        found = rows.mapInArrow(by_row(each, _FOUND, 4096), "doc_id bigint, item_id bigint, similarity double, first_word bigint")
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], "doc_id bigint, item_id bigint, similarity double, first_word bigint") if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of `docs` that hold no benchmark item; a row is judged as it streams by, so nothing is joined or moved."""
    for part in _parts(benchmark, items):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def start(shared=shared):
            known = Items(shared.value)
            return lambda texts: [bool(known.found(t or "")) for t in texts]
        docs = docs.filter(~text_column(docs.sparkSession, start, "boolean", pa.bool_())(F.col("text")))
    return docs
