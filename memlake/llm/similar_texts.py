"""Near-copies by similarity: candidates from SimHash fingerprints and MinHash bands, each verified by its exact similarity.

A text is the set of its word shingles, the k-th occurrence of a shingle being a
member of its own, so that shingles weigh as often as they occur. Texts whose
fingerprints a vantage-point tree links are candidates first. The tree's radius ends
far above a similarity of 0.8, so texts that it leaves apart are candidates too if they
share one of BANDS groups of ROWS least hash values: a pair at
similarity s does with probability 1 - (1 - s^ROWS)^BANDS, at 0.8 all but
0.005 %. Only pairs whose exact similarity is high enough are linked.

Candidates that the first links leave apart meet only if their sketches agree: of each
least hash value four bits are kept, and at similarity 0.8 fewer than SKETCH_LEAST of
the 125 agree by chance once in some 60,000 pairs. They also meet only if their parity
maps allow the similarity, which loses no pair: where two maps differ in d
places, the sets differ in d members or more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.base import by_row, stored, text_rows
from memlake.llm.components import components
from memlake.llm.decontaminate import shingle_keys

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
SEED = 42
SKETCH_LEAST = 82
PARITY_WORDS = 32
_CHUNK = 1024
_VOTES = 65_536
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 2 ** 64, (BANDS * ROWS, 1), np.uint64)
_STRETCH = _RNG.integers(0, 2 ** 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_KINDS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
_WORDS = -(-BANDS * ROWS // 16)
_NIBBLES = 0x1111111111111111
_TEXTS = pa.schema([("node", pa.int64()), ("text", pa.string())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_PARITY = pa.schema([("node", pa.int64())] + [(f"p{i}", pa.int64()) for i in range(PARITY_WORDS)])


def split(text: str) -> list[bytes]:
    """Words between ASCII white space, ASCII letters in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def node_of(words: list[bytes]) -> int:
    """A signed 64-bit number for texts of the same words."""
    n = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return n - (1 << 64) if n >> 63 else n


def members(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct keys of a text's shingles, with one for each occurrence; a shorter text is one shingle."""
    digest = xxhash.xxh64_intdigest
    keys = np.sort(shingle_keys(np.array([digest(w, 1) for w in words], np.uint64), min(size, len(words)))) if words else np.empty(0, np.uint64)
    if len(keys) < 2:
        return keys
    place = np.arange(len(keys))
    again = place - np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), place, 0))
    if not again.any():
        return keys
    more = (keys ^ again.astype(np.uint64)) * _MIX
    return np.unique(np.where(again > 0, more ^ (more >> np.uint64(29)), keys))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def least_hashes(keys: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), _CHUNK):
        np.minimum(least, ((keys[None, at:at + _CHUNK] ^ _FLIP) * _STRETCH).min(axis=1), out=least)
    return least


def bands(keys: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band of least hash values; none for a text without words."""
    return _banded(least_hashes(keys)) if len(keys) else np.empty(0, np.int64)


def _banded(least: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each least hash value, sixteen to a signed 64-bit number; the last places stay zero."""
    four = np.zeros(_WORDS * 16, np.uint64)
    four[:len(least)] = ((least * _MIX) >> np.uint64(60))
    return np.bitwise_or.reduce(four.reshape(_WORDS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)


def agreeing(a: Column, b: Column) -> Column:
    """In how many of the least hash values two sketches agree."""
    differ = F.lit(0)
    for i in range(_WORDS):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_NIBBLES))
        differ = differ + F.bit_count(x)
    return F.lit(BANDS * ROWS) - differ


def fingerprint(keys: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set: every member votes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(keys), _VOTES):
        part = keys[at:at + _VOTES].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(keys), bitorder="little").view("<i8")[0])


def parity(keys: np.ndarray) -> np.ndarray:
    """Whether an odd number of members falls in each of 64 * PARITY_WORDS places, as signed 64-bit numbers."""
    odd = np.bincount(((keys * _MIX) >> np.uint64(32)) % np.uint64(64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def kinds(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(node, n, fp, bands, sketch) of every distinct text; a text without words has no bands."""
    def each(rows):
        for _, text in rows:
            words = split(text)
            keys = members(words, size)
            least = least_hashes(keys)
            yield node_of(words), len(keys), fingerprint(keys), _banded(least) if len(keys) else [], sketch(least)
    return text_rows(docs).mapInArrow(by_row(each, _KINDS, 4096), "node bigint, n int, fp bigint, bands array<bigint>, sketch array<bigint>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """(u, v): the pairs (a, b) whose exact similarity is `least` or more; rows come by a, whose keys are kept meanwhile."""
    def each(rows):
        last, mine = None, None
        for a, b, one, other in rows:
            if a != last:
                last, mine = a, members(split(one), size)
            if similarity(mine, members(split(other), size)) >= least:
                yield a, b
    sides = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
             .join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").select("a", "b", "one", "other"))
    return sides.mapInArrow(by_row(each, _LINKS, 8192), "u bigint, v bigint")


def _by_prints(every: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): texts that fingerprints lead to. `links` joins distinct ones in `fp` as (u, v); texts of one fingerprint meet the least of them."""
    worded = every.filter("n > 0").select("node", "fp")
    first = stored(worded.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    across = (links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u")
              .join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select("a", "b"))
    same = worded.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return stored(across.unionByName(same), "by_prints")


def _apart(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of the bands that the links do not join as a whole, with `root`."""
    placed = stored(rows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    split_bands = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    return placed.join(split_bands, "band", "left_semi")


def _near(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def _pairs_apart(apart: DataFrame, every: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): texts of one band and two roots whose lengths, parity maps and sketches allow the similarity, each in the least band they share."""
    def maps(rows):
        for node, text in rows:
            yield node, *parity(members(split(text), size)).tolist()
    wanted = texts.join(apart.select("node").distinct(), "node", "left_semi").select("node", "text")
    odd = wanted.mapInArrow(by_row(maps, _PARITY, 4096), "node bigint, " + ", ".join(f"p{i} bigint" for i in range(PARITY_WORDS)))
    rows = stored(apart.join(every.select("node", "sketch", "bands"), "node").join(odd, "node"), "apart")

    def side(x: str) -> DataFrame:
        names = {"root": "root", "node": "node", "n": "n", "sketch": "s", "bands": "bands", "a": "a"} | {f"p{i}": f"p{i}" for i in range(PARITY_WORDS)}
        return rows.select(F.col("band").alias(f"band_{x}"), *[F.col(c).alias(f"{to}_{x}") for c, to in names.items()])
    differ = F.lit(0)
    for i in range(PARITY_WORDS):
        differ = differ + F.bit_count(F.col(f"p{i}_x").bitwiseXOR(F.col(f"p{i}_y")))
    met = side("x").join(side("y"), (F.col("band_x") == F.col("band_y")) & (F.col("root_x") < F.col("root_y"))
                         & (F.col("node_x") != F.col("a_y")) & (F.col("node_y") != F.col("a_x")) & _near("n_x", "n_y", least)
                         & (differ * (1 + least) <= (F.col("n_x") + F.col("n_y")) * (1 - least) + 1e-6)
                         & (agreeing(F.col("s_x"), F.col("s_y")) >= SKETCH_LEAST)
                         & (F.array_min(F.array_intersect("bands_x", "bands_y")) == F.col("band_x")))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def groups(docs: DataFrame, links: Callable[[DataFrame], DataFrame], size: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """(node, root) of all texts that are linked to another; root is the least node that links lead to.

    First the pairs that `links` finds between distinct fingerprints are verified. In bands that
    they do not join as a whole, every candidate meets one of its band, the text that shares its
    bands with the most others, which joins a dense family by one link a text. Then the
    candidates of a band that are not joined yet meet, where their parity maps and
    sketches allow the similarity. Pairs whose lengths alone rule it out are left aside.
    """
    every = stored(kinds(docs, size), "kinds")
    alike = _by_prints(every, links)
    banded = every.select("node", "n", F.explode("bands").alias("band"))
    counts = banded.groupBy("band").agg(F.count("*").alias("rows")).filter("rows > 1")
    shared = stored(banded.join(counts, "band"), "shared")
    wanted = shared.select("node").union(alike.select("a")).union(alike.select("b")).distinct()

    def texts_of(rows):
        for _, text in rows:
            yield node_of(split(text)), text
    texts = text_rows(docs).mapInArrow(by_row(texts_of, _TEXTS, 4096), "node bigint, text string")
    texts = stored(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "candidates")
    first = stored(_verified(alike, texts, size, least), "links")
    apart = stored(_apart(shared, first), "apart")
    central = apart.groupBy("node").agg(F.sum("rows").alias("met"))
    first_of = F.struct((-F.col("met")).alias("met"), "node", "n", "root")
    heads = stored(apart.join(central, "node").groupBy("band").agg(F.min(first_of).alias("head"))
                   .select("band", F.col("head.node").alias("a"), F.col("head.n").alias("na"), F.col("head.root").alias("root_a")), "heads")
    apart = stored(apart.drop("rows").join(heads, "band"), "apart")
    stars = apart.filter("root <> root_a").filter(_near("n", "na", least)).select("a", F.col("node").alias("b")).distinct()
    second = stored(first.unionByName(_verified(stars, texts, size, least)), "links")
    apart = stored(_apart(apart.select("band", "node", "n", "a"), second), "apart")
    rest = _pairs_apart(apart, every, texts, size, least)
    return stored(components(stored(second.unionByName(_verified(rest, texts, size, least)), "links")), "groups")
