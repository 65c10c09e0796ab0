"""Byte-level BPE: encode and decode whole texts by replaying merges over a block of words.

The words of a task's texts are cut out, and each distinct one is written once
into a flat row of symbols. An inverted index keeps the positions of every pair
that has a rank. Merges are replayed in rank order: all positions of the pair
merge at once, and only pairs at touched neighbours enter the index again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from memlake.llm.base import by_row, text_rows

BLOCK_CHARS = 1_000_000
KEPT_WORDS = 120_000
LONG_WORD = 256


class Merges:
    """Ranks of byte strings, and every way in which two ranked strings make a third."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.full(256, -1, np.int64)
        for b in range(256):
            self.byte[b] = ranks[bytes([b])]
        self.base = len(self.tokens)
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left * self.base + right] = rank
        self.pairs = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[p] for p in self.pairs.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1) if len(self.pairs) else np.full(len(key), -1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class _Index:
    """Positions of the left symbol of each pair, by the rank of the merge, with the ranks in a heap."""

    def __init__(self):
        self.at: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, at: np.ndarray) -> None:
        known = ranks >= 0
        ranks, at = ranks[known], at[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if rank not in self.at:
                self.at[rank] = []
                heapq.heappush(self.heap, rank)
            self.at[rank].append(part)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.heap)
        parts = self.at.pop(rank)
        return rank, np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])


def _every_other(at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of positions whose pairs overlap in a run, the first, third and so on: the leftmost merges first."""
    linked = np.concatenate([[False], right[:-1] == at[1:]])
    if not linked.any():
        return np.ones(len(at), bool)
    begin = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
    return (np.arange(len(at)) - begin) % 2 == 0


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers.

    The row of symbols has a stop between words, so no pair crosses them. A
    position whose symbols have changed since it was indexed is passed over.
    Were a new pair of lower rank to appear, the heap would bring it up next.
    """
    if not words:
        return []
    flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    stops = np.cumsum(sizes + 1) - 1
    symbol = merges.byte[flat].copy()
    symbol[stops] = -1
    after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
    index = _Index()

    def add(left: np.ndarray) -> None:
        right = after[left]
        both = (symbol[left] >= 0) & (symbol[right] >= 0)
        left, right = left[both], right[both]
        index.add(merges.rank_of(symbol[left], symbol[right]), left)

    add(np.arange(len(flat) - 1))
    while index.heap:
        rank, at = index.pop()
        at = at[symbol[at] >= 0]
        right = after[at]
        ok = symbol[right] >= 0
        at, right = at[ok], right[ok]
        ok = merges.rank_of(symbol[at], symbol[right]) == rank
        at, right = at[ok], right[ok]
        ok = _every_other(at, right)
        at, right = at[ok], right[ok]
        if not len(at):
            continue
        beyond = after[right]
        symbol[at], symbol[right] = rank, -2
        after[at], before[beyond] = beyond, at
        left = before[at]
        left = left[(left >= 0)]
        add(np.unique(np.concatenate([left[symbol[left] >= 0], at])))
    live = symbol >= 0
    ids = symbol[live].astype("<u4").tobytes()
    ends = (np.cumsum(live)[stops] * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Codec:
    """Encodes texts a block at a time; the ids of words seen before are kept, within a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_WORDS):
        self.merges, self.find, self.kept = Merges(ranks), regex.compile(pattern).findall, kept
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes. Long words are merged with the others but not kept."""
        cut = [self.find(t) for t in texts]
        new = set().union(*cut).difference(self.known) if cut else set()
        if len(self.known) + len(new) > self.kept:
            self.known.clear()
            new = set().union(*cut)
        order = sorted(new)
        self.known.update(zip(order, replay([w.encode("utf-8", "surrogatepass") for w in order], self.merges)))
        out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for word in order:
            if len(word) > LONG_WORD:
                del self.known[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def blocks(rows, chars: int = BLOCK_CHARS):
    """Lists of rows with up to `chars` characters together; one longer text is a block of its own."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > chars:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


def _spread(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text.

    The vocabulary file is read on the driver and broadcast; its size is that of
    the vocabulary, whatever the corpus. A null text is an empty one and has no
    ids; repeated rows are encoded again; other columns are not read.
    """
    ranks = _spread(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(rows):
        codec = Codec(ranks.value, pattern)
        for block in blocks(rows):
            for (doc_id, _), ids in zip(block, codec.encode([t for _, t in block])):
                yield doc_id, np.frombuffer(ids, "<i4")
    return text_rows(docs).mapInArrow(by_row(run, schema), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes binary): the bytes that the ids of each row stand for; null ids are none."""
    ranks = _spread(encoded.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(rows):
        tokens = Merges(ranks.value).tokens
        for doc_id, ids in rows:
            yield doc_id, b"".join(tokens[i] for i in ids or ())
    return encoded.select("doc_id", "ids").mapInArrow(by_row(run, schema), "doc_id bigint, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded from the ids, and digested in one pass."""
    ranks = _spread(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(rows):
        codec = Codec(ranks.value, pattern)
        sha = hashlib.sha256
        for block in blocks(rows):
            for (doc_id, _), ids in zip(block, codec.encode([t for _, t in block])):
                yield doc_id, len(ids) // 4, sha(ids).hexdigest(), sha(codec.decode(ids)).hexdigest()
    return text_rows(docs).mapInArrow(by_row(run, schema, 4096), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
