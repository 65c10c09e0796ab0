"""How text filters interact: what each of them removes in every order they could run in.

One pass over the UTF-8 bytes of a block of texts takes every measure. A finite-state
transducer reads a byte's class from one table and its action from another: a word
begins, a word ends, a capital, a symbol, a code point. The word spans go into a
hash table with open addressing, where a span counts as seen only after all its
bytes are compared. Spark then needs only one small row a text: which filters it
fails, and a digest that finds equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.base import SLICE_ROWS, short_batches, stored

# The filters and their bounds.
FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SYMBOLS = "#$%&*|"

BLOCK_BYTES = 1 << 20
LONG_WORD = 64
_GAP, _PLAIN, _CAPITAL, _SYMBOL, _LEAD, _TAIL = range(6)
_OUTSIDE, _INSIDE = 0, 1
_BEGIN, _END, _IS_CAPITAL, _IS_SYMBOL, _IS_POINT = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    """The class of every byte: gap, plain, capital, symbol, first byte of a longer code point, further byte of one."""
    of = np.full(256, _PLAIN, np.uint8)
    of[[0x20, *range(0x09, 0x0E)]] = _GAP
    of[ord("A"):ord("Z") + 1] = _CAPITAL
    of[[ord(c) for c in SYMBOLS]] = _SYMBOL
    of[0x80:0xC0] = _TAIL
    of[0xC0:] = _LEAD
    return of


def _actions() -> np.ndarray:
    """The action of every (state, class); the state after a byte is inside a word unless the byte is a gap."""
    act = np.zeros((2, 6), np.uint8)
    act[:, _CAPITAL] |= _IS_CAPITAL
    act[:, _SYMBOL] |= _IS_SYMBOL
    act[:, [c for c in range(6) if c != _TAIL]] |= _IS_POINT
    act[_OUTSIDE, [c for c in range(6) if c != _GAP]] |= _BEGIN
    act[_INSIDE, _GAP] |= _END
    return act


CLASS_OF = _classes()
ACTION = _actions()
NEXT = np.array([_OUTSIDE] + [_INSIDE] * 5, np.uint8)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2 ** 64 - 1], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Spans:
    """Word spans of a block in a hash table: open addressing, every match verified byte by byte."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray):
        """`data` ends with eight bytes to spare, so that eight bytes can be read from any place."""
        self.data, self.start, self.size, self.owner = data, start, size, owner
        self.eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))

    def _piece(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+8 of the spans `at`, zero beyond their ends."""
        return self.eight[self.start[at] + 8 * k] & _KEEP[np.minimum(self.size[at] - 8 * k, 8)]

    def hashes(self) -> np.ndarray:
        out = self.size.astype(np.uint64) * _MIX ^ self.owner.astype(np.uint64)
        at = np.arange(len(self.start))
        long = self.size > LONG_WORD
        for i in np.flatnonzero(long).tolist():
            out[i] ^= np.uint64(xxhash.xxh64_intdigest(self.data[self.start[i]:self.start[i] + self.size[i]], 1))
        at = at[~long]
        for k in range(LONG_WORD // 8):
            at = at[self.size[at] > 8 * k]
            if not len(at):
                break
            h = (out[at] ^ self._piece(at, k)) * _MIX
            out[at] = h ^ (h >> np.uint64(29))
        return out ^ (out >> np.uint64(32))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans are equal, owner, length and all bytes."""
        ok = (self.size[a] == self.size[b]) & (self.owner[a] == self.owner[b])
        live = np.flatnonzero(ok & (a != b))
        long = self.size[a[live]] > LONG_WORD
        for i in live[long].tolist():
            x, y, n = self.start[a[i]], self.start[b[i]], self.size[a[i]]
            ok[i] = np.array_equal(self.data[x:x + n], self.data[y:y + n])
        live, k = live[~long], 0
        while len(live):
            equal = self._piece(a[live], k) == self._piece(b[live], k)
            ok[live[~equal]] = False
            k += 1
            live = live[equal & (self.size[a[live]] > 8 * k)]
        return ok

    def distinct(self, owners: int) -> np.ndarray:
        """How many different spans each owner has."""
        n = len(self.start)
        if not n:
            return np.zeros(owners, np.int64)
        room = 1 << int(2 * n - 1).bit_length()
        table = np.full(room, -1, np.int64)
        slot = (self.hashes() & np.uint64(room - 1)).astype(np.int64)
        todo, first = np.arange(n), []
        while len(todo):
            free = table[slot[todo]] < 0
            table[slot[todo[free]]] = todo[free]  # of several that want a free place one gets it
            holder = table[slot[todo]]
            first.append(todo[holder == todo])
            todo = todo[~self.same(todo, holder)]
            slot[todo] = (slot[todo] + 1) & (room - 1)
        return np.bincount(self.owner[np.concatenate(first)], minlength=owners)


def measures(texts: list[bytes]) -> np.ndarray:
    """(words, distinct words, capitals, code points, symbols) of every text, as one pass over a block of UTF-8 bytes."""
    n = len(texts)
    if not n:
        return np.zeros((0, 5), np.int64)
    data = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])  # a gap after every text ends its last word
    kind = CLASS_OF[data[:ends[-1]]]
    state = np.empty(len(kind), np.uint8)
    state[0] = _OUTSIDE
    state[1:] = NEXT[kind[:-1]]
    action = ACTION[state, kind]

    def count(bit: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(action & bit), ends), prepend=0)
    start, end = np.flatnonzero(action & _BEGIN), np.flatnonzero(action & _END)
    words = np.diff(np.searchsorted(start, ends), prepend=0)
    spans = Spans(data, start, end - start, np.repeat(np.arange(n), words))
    return np.stack([words, spans.distinct(n), count(_IS_CAPITAL), count(_IS_POINT) - 1, count(_IS_SYMBOL)], axis=1)


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


MEASURES = ("words", "distinct", "capitals", "points", "symbols")
_KIND = pa.struct([(m, pa.int64()) for m in MEASURES] + [("digest", pa.binary())])


def _measure(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        out = []
        for at in range(0, len(part), SLICE_ROWS):
            texts = part.slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist()
            rows = np.concatenate([measures(b) for b in _blocks(texts)])
            columns = [pa.array(c) for c in np.ascontiguousarray(rows.T)]
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            out.append(pa.StructArray.from_arrays([*columns, digest], fields=list(_KIND)))
        yield pa.concat_arrays(out) if out else pa.array([], _KIND)


def measured(text: Column) -> Column:
    """words, distinct, capitals, points, symbols and a SHA-256 digest of a text; a null text is an empty one."""
    ddl = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ",digest:binary>"
    return F.arrow_udf(_measure, ddl)(F.coalesce(text, F.lit("")))


def failed(m: Column) -> Column:
    """Bits of the filters A to D that a text with these measures fails."""
    fails = [m["words"] < LEAST_WORDS,
             100 * m["distinct"] < DISTINCT_PERCENT * m["words"],
             100 * m["capitals"] > CAPITAL_PERCENT * m["points"],
             m["symbols"] > 0]
    mask = F.lit(0)
    for i, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << i).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each source by the set of filters they fail, and how many of them are labelled good or toxic.

    Rows alike in text, source and id are counted together before anything joins.
    A text that a lesser doc_id has too fails E: of the rows of a digest only those
    with the least id pass, which takes one row for each digest, source and pair
    of labels. The least ids meet these counts again, not the rows themselves.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       measured(F.col("text")).alias("m"))
    rows = (rows.select("doc_id", "part", failed(F.col("m")).alias("mask"), F.col("m.digest").alias("digest"))
            .groupBy("digest", "mask", "part", "doc_id").agg(F.count("*").alias("n")))
    # a null id finds no label; a second key spreads such rows
    known = (labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .filter("doc_id is not null").withColumn("salt", F.lit(0)))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.hash("digest", "part")).otherwise(0))
    joined = rows.join(known, ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"])
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("n").alias("rows"))
    kinds = stored(joined.groupBy("digest", "mask", "part", "good", "toxic").agg(F.min(first).alias("least"), F.sum("n").alias("n")), "kinds")
    key = F.struct("least.last", "least.id")
    best = kinds.groupBy("digest").agg(F.min(key).alias("key"), F.count("*").alias("kinds"))
    passing = F.when(key.eqNullSafe(F.col("key")), F.col("least.rows")).otherwise(0)
    split = kinds.join(best, "digest").withColumn("passing", passing)
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")),
                             F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    return (split.select("part", "good", "toxic", both.alias("c")).select("part", "c.mask", "c.n", "good", "toxic")
            .groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


def _settings() -> list[tuple[int, int, int]]:
    """(filter bit, bits of the filters before it, in how many orders that is so) for all 80 such pairs."""
    ways = {0: 24, 1: 6, 2: 4, 3: 6, 4: 24}
    return [(1 << f, before, ways[before.bit_count()]) for f in range(5) for before in range(32) if not before >> f & 1]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each source, each of the 120 orders of the five filters and each
    step. What a filter removes depends only on which others ran before it, so 80
    sums for each source are taken and dealt out to the 600 steps. Null sources
    are the empty string; null and empty texts fail A alone (and E where they
    repeat); repeated labels count where any says so; rows of a null doc_id come
    after all with one and have no labels; rows with the same least id all pass E.
    Other columns are not read. No rows: an empty result.
    """
    at = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(b).alias("before"), F.lit(w).alias("ways")) for f, b, w in _settings()]))
    each = cells(docs, labels).withColumn("at", at).select("*", "at.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("f")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0

    def total(of: Column, when: Column) -> Column:
        return F.sum(F.when(when, of).otherwise(0))
    n = F.col("n")
    sums = each.groupBy("part", "f", "before", "ways").agg(
        total(n, ~fails & ~gone).alias("kept"), total(n, fails & ~gone).alias("removed"), total(n, fails & gone).alias("redundant"),
        total(n, F.col("mask") == F.col("f")).alias("unique_fails"), total(F.col("good"), fails & ~gone).alias("good_lost"),
        total(F.col("toxic"), fails & ~gone).alias("toxic_lost"))
    orders = [("".join(FILTERS[i] for i in p), s + 1, 1 << p[s], sum(1 << i for i in p[:s])) for p in permutations(range(5)) for s in range(5)]
    fixed = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, f int, before int")
    shapley = sums.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("ways")).alias("shapley"))
    return (sums.join(shapley, ["part", "f"]).join(F.broadcast(fixed), ["f", "before"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
