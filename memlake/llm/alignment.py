"""Token alignment of two tokenizers over whole texts, from byte offsets at which tokens of both end.

Everything between the tokenizers and the result is Arrow: token ids lie in one
flat list with the text they belong to beside them (words are encoded once and looked
up again, as no token of either side crosses the place before a space); lengths of tokens add up to
byte ends, counted within each text; a hash join of the two tables on (text, end)
gives the links; Table.group_by counts them by pair in every batch, and Spark adds
the counts up. Tokens that end together are one's bytes a suffix of the other's,
so all pairs that can ever link follow from the two vocabularies: they number at
most the bytes of all tokens, whatever the corpus, and a link is a number into that list.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from memlake.llm.base import SLICE_ROWS, stored, text_rows

BLOCK_CHARS = 500_000
KEPT_CHARS = 4_000_000
PARENTS = 1 << 40  # a document-end key is the text's number in its block, times this, plus the byte offset
SPACE = "▁"  # fixed: how the piece vocabulary writes a space


def _byte_of() -> dict[str, int]:
    """The characters in which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    of = _byte_of()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def piece_tokens(pieces: list[str]) -> list[bytes]:
    """Bytes of pieces: <0xHH> is one byte, other pieces are UTF-8 with the mark for a space as a space."""
    return [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace(SPACE, " ").encode() for p in pieces]


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted numbers i * len(b) + j of all pairs of which one token ends with the other: none else can end together."""
    found = set()
    for flip, (x, y) in enumerate(((a, b), (b, a))):
        at: dict[bytes, list[int]] = {}
        for j, token in enumerate(y):
            if token:
                at.setdefault(token, []).append(j)
        for i, token in enumerate(x):
            for cut in range(len(token)):
                for j in at.get(token[cut:], ()):
                    found.add(j * len(b) + i if flip else i * len(b) + j)
    return np.array(sorted(found), np.int64)


class Lists:
    """Lists of ids one behind the other, by number."""

    def __init__(self):
        self.flat, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, ids: list[list[int]]) -> None:
        more = pa.array(ids, pa.list_(pa.int32()))
        self.flat = np.concatenate([self.flat, pc.list_flatten(more).to_numpy()])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(pc.list_value_length(more).to_numpy())])

    def rows(self, numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers, flattened, and the owner of each id: the parent indices of the lists, by owner."""
        size = self.begin[numbers + 1] - self.begin[numbers]
        shift = np.repeat(self.begin[numbers] - (np.cumsum(size) - size), size)
        return self.flat[np.arange(len(shift)) + shift], np.repeat(owner, size)


class Known:
    """Parts of texts that were encoded before, with the ids of both tokenizers."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.a, self.b, self.chars = Lists(), Lists(), 0

    def add(self, parts: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> None:
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts))))
        self.chars += sum(map(len, parts))
        self.a.add(a_ids)
        self.b.add(b_ids)


@dataclass
class Pair:
    """Both tokenizers with the bytes of their tokens, and all pairs that can link."""
    a: object
    b: object
    a_bytes: pa.Array
    b_bytes: pa.Array
    pairs: np.ndarray
    a_names: pa.Array
    b_names: pa.Array

    @classmethod
    def load(cls, byte_level: str, pieces: str) -> Pair:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        a, b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        a.encode_special_tokens = True
        of_a = byte_level_tokens(a.get_vocab(with_added_tokens=True))
        of_b = piece_tokens([b.id_to_piece(i) for i in range(b.get_piece_size())])
        return cls(a, b, pa.array(of_a, pa.binary()), pa.array(of_b, pa.binary()), possible_pairs(of_a, of_b), _names(len(of_a)), _names(len(of_b)))

    def __post_init__(self):
        self.apart = not any(p and SPACE in p.lstrip(SPACE) for p in (self.b.id_to_piece(i) for i in range(self.b.get_piece_size())))
        self.known = Known()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and their texts, of both tokenizers, of a space and each text; empty texts have none.

        Texts are cut where a space follows something else than white space. The
        byte-level pattern ends a match there, and no piece goes on after a space
        that is not at its start (`apart`, looked up in the vocabulary), so the parts encode alike
        on their own. The piece side puts a space before what it encodes, so it gets each part without its
        own; a text with a part that is nothing but that space, or with the mark for a space, is encoded whole.
        """
        cut = [_PARTS(" " + t) if t and self.apart and SPACE not in t else [" " + t] if t else [] for t in texts]
        cut = [[" " + t] if len(c) > 1 and " " in c else c for t, c in zip(texts, cut)]
        new = sorted(set().union(*cut).difference(self.known.number))
        if self.known.chars + sum(map(len, new)) > KEPT_CHARS:
            self.known = Known()
            new = sorted(set().union(*cut))
        if new:
            self.known.add(new, [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], self.b.encode([w[1:] for w in new], num_threads=1))
        number = self.known.number
        codes = np.array([number[w] for c in cut for w in c], np.int64)
        text = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        return (*self.known.a.rows(codes, text), *self.known.b.rows(codes, text))

    def b_of(self) -> np.ndarray:
        """The piece of each possible pair."""
        return self.pairs % len(self.b_bytes)


#: Parts of a text, each up to a space that follows something else than white space.
_PARTS = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+").findall
_MARKS = ("", ",", "|", ";")


def _names(n: int) -> pa.Array:
    """Every id in decimals with each mark that can follow it."""
    return pa.array([f"{i}{m}" for i in range(n) for m in _MARKS], pa.string())


def _ends(tokens: pa.Array, parent: np.ndarray, texts: int) -> np.ndarray:
    """Where each token ends, in bytes from the start of its text: a running sum over all, less what came before the text."""
    size = pc.binary_length(tokens)
    total = pc.cumulative_sum(pc.cast(size, pa.int64())).to_numpy()
    last = np.searchsorted(parent, np.arange(texts), side="left") - 1  # the last token before the text
    before = np.where(last >= 0, total[last], 0) if len(total) else np.zeros(texts, np.int64)
    return total - before[parent]


def _whole(tokens: pa.Array, parent: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Which texts are, byte for byte, what their tokens join to."""
    ends = np.concatenate([[0], np.frombuffer(tokens.buffers()[1], np.int32)[1:len(tokens) + 1]]) if len(tokens) else np.zeros(1, np.int64)
    data = memoryview(tokens.buffers()[2] or b"").cast("B")
    cut = ends[np.searchsorted(parent, np.arange(len(wanted) + 1))]
    return np.array([data[x:y] == w for x, y, w in zip(cut[:-1].tolist(), cut[1:].tolist(), wanted)], bool)


@dataclass
class Aligned:
    """What a block of texts gives: counts, digests, and each text's links as numbers of possible pairs."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    links: pa.ListArray


def align(pair: Pair, texts: list[str]) -> Aligned:
    """Encode a block of texts with both tokenizers and link the tokens that end together."""
    n = len(texts)
    wanted = [(" " + t).encode() for t in texts]
    a_ids, a_at, b_ids, b_at = pair.encode(texts)
    a_tokens, b_tokens = pair.a_bytes.take(pa.array(a_ids)), pair.b_bytes.take(pa.array(b_ids))
    ok = _whole(a_tokens, a_at, wanted) & _whole(b_tokens, b_at, wanted) & np.array([bool(t) for t in texts], bool)
    a_end, b_end = _ends(a_tokens, a_at, n), _ends(b_tokens, b_at, n)
    a_keep, b_keep = ok[a_at], ok[b_at]
    a_ids, a_at, a_end, b_ids, b_at, b_end = a_ids[a_keep], a_at[a_keep], a_end[a_keep], b_ids[b_keep], b_at[b_keep], b_end[b_keep]
    left = pa.table({"end": a_at * PARENTS + a_end, "a": np.arange(len(a_ids))})
    right = pa.table({"end": b_at * PARENTS + b_end, "b": np.arange(len(b_ids))})
    linked = left.join(right, "end", join_type="inner", use_threads=False).sort_by([("a", "ascending"), ("b", "ascending")])
    la, lb = linked.column("a").to_numpy(), linked.column("b").to_numpy()
    code = np.searchsorted(pair.pairs, a_ids[la].astype(np.int64) * len(pair.b_bytes) + b_ids[lb])
    per = np.bincount(a_at[la], minlength=n)
    bounds = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
    links = pa.ListArray.from_arrays(pa.array(bounds), pa.array(code.astype(np.int32)))
    return Aligned(np.bincount(a_at, minlength=n), np.bincount(b_at, minlength=n), per, _digests(pair, a_ids, b_ids, la, lb, a_at, per, ok), links)


def _digests(pair: Pair, a_ids, b_ids, la, lb, a_at, per, ok) -> list[str]:
    """SHA-256 of each text's groups, written as in `groups_of`; empty where a text has no tokens.

    Every token goes to its place in the written order: after the tokens of both
    sides in earlier groups, and on the B side after the A tokens of its group.
    """
    group_a, group_b = np.searchsorted(la, np.arange(len(a_ids))), np.searchsorted(lb, np.arange(len(b_ids)))
    at_a = np.arange(len(a_ids)) + np.concatenate([[0], lb + 1])[group_a]
    at_b = np.arange(len(b_ids)) + (la + 1)[group_b]
    last = np.concatenate([np.diff(a_at[la]) != 0, [True]])[:len(la)] if len(la) else np.zeros(0, bool)  # the last group of its text
    mark_a = np.ones(len(a_ids), np.int64)
    mark_a[la] = 2
    mark_b = np.ones(len(b_ids), np.int64)
    mark_b[lb] = np.where(last, 0, 3)
    names = pa.chunked_array([pair.a_names, pair.b_names])
    which = np.empty(len(a_ids) + len(b_ids), np.int64)
    which[at_a] = a_ids.astype(np.int64) * 4 + mark_a
    which[at_b] = len(pair.a_names) + b_ids.astype(np.int64) * 4 + mark_b
    written = pc.take(names, pa.array(which)).combine_chunks()
    owner = np.empty(len(which), np.int64)
    owner[at_a] = a_at
    owner[at_b] = a_at[la][group_b] if len(la) else 0
    size = np.bincount(owner, minlength=len(per))
    texts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), written)
    whole = pc.binary_join(texts, "")
    return [hashlib.sha256(s.as_buffer()).hexdigest() if good and m else "" for s, good, m in zip(whole, ok.tolist(), size.tolist())]


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > BLOCK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
                     ("links", pa.list_(pa.int32()))])


def linked(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of every row; a link is the number of a possible pair."""
    def run(batches):
        pair = Pair.load(byte_level, pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(1).to_pylist()
                for x, y in _blocks(texts):
                    got = align(pair, texts[x:y])
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(x, y - x), pa.array(got.n_a), pa.array(got.n_b), pa.array(got.n_groups),
                                                      pa.array(got.digests, pa.string()), got.links], schema=_SCHEMA)
    return text_rows(docs).mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(link, n): how often each pair is linked in the whole corpus; counted in each batch, then added up."""
    def count(batches):
        for batch in batches:
            flat = pa.table({"link": pc.list_flatten(batch.column(0))})
            got = flat.group_by("link", use_threads=False).aggregate([("link", "count")])
            yield from got.select(["link", "link_count"]).rename_columns(["link", "n"]).to_batches()
    return links.select("links").mapInArrow(count, "link int, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    The texts are encoded once; their links are stored as numbers, counted, and
    looked up again. Counts are at most one for each possible pair, a number that
    the two vocabularies fix, so they may go to the driver and to every task. Null
    and empty texts, and texts that either tokenizer does not give back byte for
    byte, have no tokens. Repeated rows count again. Only doc_id and text are
    read. No rows: an empty result.
    """
    rows = stored(linked(docs, byte_level, pieces), "links")
    pair = Pair.load(byte_level, pieces)
    got = pair_counts(rows).toArrow()
    count = np.zeros(len(pair.pairs), np.int64)
    count[got.column("link").to_numpy()] = got.column("n").to_numpy()
    highest = np.zeros(len(pair.b_bytes), np.int64)
    np.maximum.at(highest, pair.b_of(), count)
    best = (count == highest[pair.b_of()]) & (count > 0)
    shared = docs.sparkSession.sparkContext.broadcast((count, best))
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def look_up(batches):
        count, best = shared.value
        for batch in batches:
            links = batch.column(5)
            flat, size = pc.list_flatten(links).to_numpy(), pc.list_value_length(links).to_numpy()
            ends = np.cumsum(size)

            def sums(values):
                total = np.concatenate([[0], np.cumsum(values)])
                return pa.array(total[ends] - total[ends - size])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(size.astype(np.int64)), sums(best[flat].astype(np.int64)), sums(count[flat])],
                                             names=[*names, "n_links", "n_best", "count_sum"])
    out = rows.select(*names, "links").mapInArrow(
        look_up, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
