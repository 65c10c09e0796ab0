"""Quality by neighbour votes among labelled latent-semantic vectors.

A text becomes shares of its words, of the shapes of its words ("Ab,", "AB!!",
"|"), of pairs of neighbouring shapes, and a few measures of length and
repetition. A truncated decomposition of the labelled sample turns such shares
into short vectors. Every document is compared with every labelled vector, block
by block, and the nearest ones vote, weighted by their cosine.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm.base import all_columns, by_row, free_name, held_out, labelled_sample, text_column

FIT_ROWS = 4000
RANK = 48
NEIGHBOURS = 31
POWER = 4
KNOWN_WORDS = 300_000
_WORDS, _SHAPES, _PAIRS, _STEPS = 1536, 512, 1024, 24
_MEASURES = 5
_CUTS = np.cumsum([0, _WORDS, _SHAPES, _PAIRS] + [_STEPS] * _MEASURES)
WIDTH = int(_CUTS[-1])
#: How much each group of features weighs in the cosine: words, shapes, pairs, each measure.
_WEIGHTS = np.sqrt(np.array([0.3, 1.0, 1.0] + [0.3] * _MEASURES))


def shape(word: str) -> str:
    """Letters as A or a, digits as 9, other characters as they are; a run of one kind is written once with a plus."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if out and out[-1][0] == k:
            out[-1] = k + "+"
        else:
            out.append(k)
    return "".join(out)


def _place(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def _step(x: float) -> int:
    """The step of a share between 0 and 1."""
    return min(_STEPS - 1, int(x * _STEPS))


class Features:
    """Rows of feature shares; places of words seen before are kept, within a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = _place(w.lower(), _WORDS) * _SHAPES + _place(shape(w), _SHAPES)
        codes = np.array([known[w] for w in words], np.int64)
        if len(known) > KNOWN_WORDS:
            known.clear()
        return codes

    def row(self, text: str) -> np.ndarray:
        words = text.split()
        out = np.zeros(WIDTH, np.float32)
        n = len(words)
        codes = self._codes(words)
        shapes = codes % _SHAPES
        if n:
            out[:_CUTS[1]] = np.bincount(codes // _SHAPES, minlength=_WORDS) / n
            out[_CUTS[1]:_CUTS[2]] = np.bincount(shapes, minlength=_SHAPES) / n
        if n > 1:
            pairs = (shapes[:-1] * 31 + shapes[1:]) % _PAIRS
            out[_CUTS[2]:_CUTS[3]] = np.bincount(pairs, minlength=_PAIRS) / (n - 1)
        again = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
        kinds = len(np.unique(codes)) / n if n else 0.0
        size = min(1.0, np.log2(1 + n) / 20)
        mean = min(1.0, len(text) / n / 24) if n else 0.0
        lines = min(1.0, text.count("\n") / n * 4) if n else 0.0
        for i, x in enumerate((np.sqrt(again), kinds, size, mean, lines)):
            out[_CUTS[3 + i] + _step(float(x))] = 1.0
        return np.sqrt(out)

    def rows(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.row(t) for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)


@dataclass
class Voters:
    """Labelled vectors and what brings a text into their space."""
    scale: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; a row without any known feature stays zero."""
        flat = (rows * self.scale) @ self.basis
        size = np.linalg.norm(flat, axis=1, keepdims=True)
        return np.divide(flat, size, out=np.zeros_like(flat), where=size > 0)

    def vote(self, rows: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by cosine; without neighbours their mean.

        Cosines count to six places; of equal ones the lower doc_id votes.
        """
        base = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels) or not len(rows):
            return np.full(len(rows), base)
        near = np.round(self.place(rows) @ self.vectors.T, 6)
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(near, at, axis=1).min(axis=1, keepdims=True)
        for i in np.flatnonzero((near >= least).sum(axis=1) > k):
            tied = np.flatnonzero(near[i] >= least[i])
            at[i] = tied[np.lexsort((tied, -near[i, tied]))][:k]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        return np.divide((weight * self.labels[at]).sum(axis=1), total, out=np.full(len(rows), base), where=total > 0)


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Voters:
    """Scale features by rarity and weight, decompose, and keep the labelled rows as vectors.

    The decomposition is a randomised one with a fixed start: a few products of
    the sample with narrow matrices.
    """
    n = len(rows)
    seen = (rows > 0).sum(axis=0)
    rare = np.log((1 + n) / (1 + seen)) + 0.1
    scale = rare * np.repeat(_WEIGHTS, np.diff(_CUTS))
    scale[_CUTS[3]:] = np.repeat(_WEIGHTS[3:], _STEPS)
    scale = scale.astype(np.float32)
    if not n:
        return Voters(scale, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    a = rows * scale
    side = np.random.default_rng(5).standard_normal((WIDTH, min(rank + 16, n))).astype(np.float32)
    for _ in range(4):
        side = np.linalg.qr(a.T @ (a @ side))[0]
    _, _, right = np.linalg.svd(a @ side, full_matrices=False)
    basis = (side @ right.T[:, :rank]).astype(np.float32)
    model = Voters(scale, basis, np.zeros((0, 1), np.float32), labels)
    model.vectors = model.place(rows)
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Voters:
    """Fit on at most `bound` labelled rows that are not held out; only their features reach the driver, in order of doc_id."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])

    def each(rows):
        features = Features()
        for doc_id, y, text in rows:
            row = features.row(text)
            at = np.flatnonzero(row)
            yield doc_id, y, at.astype(np.int32), row[at]
    sample = labelled_sample(docs, labels, "quality", bound).select("doc_id", "y", "text")
    got = sample.mapInArrow(by_row(each, schema), "doc_id bigint, y int, at array<int>, share array<float>").toPandas()
    got = got.sort_values("doc_id", kind="stable").head(bound)
    dense = np.zeros((len(got), WIDTH), np.float32)
    for i, (at, share) in enumerate(zip(got["at"], got["share"])):
        dense[i, at] = share
    return fit(dense, got["y"].to_numpy(np.float64))


def scores(docs: DataFrame, model: Voters):
    """A column function that scores texts; each task streams them past the broadcast vectors.

    The labelled vectors are at most FIT_ROWS x RANK numbers, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def start():
        features, model = Features(), Voters(**shared.value)
        return lambda texts: model.vote(features.rows([t or "" for t in texts]))
    return text_column(docs.sparkSession, start, "double", pa.float64())


def quality(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text is an empty one and gets a score like any other, as do rows with
    a null doc_id (not held out). Repeated rows score alike. Without labels to
    learn from, every score is 0.5. Only doc_id and text are read of `docs`, and
    nothing but the text goes into a score. No rows: an empty result.
    """
    score = scores(docs, train(docs, labels, bound))(F.col("text")).alias("score")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, as they are."""
    score = free_name(docs, "score")
    judged = docs.withColumn(score, scores(docs, train(docs, labels, bound))(F.col("text")))
    return judged.filter(F.col(score) >= 0.5).select(*all_columns(docs.columns))
