"""Toxicity as an ordered grade: a cumulative-link regression over sparse word counts.

Features are words and the first letters of words, which word families share.
One weight per feature is shared by all thresholds: P(grade >= k) is the logistic
function of (score - threshold k). Labels say only toxic or not, so grades above
zero come from the training rows themselves: words that labelled toxic rows hold
far more often than others are counted, and thirds of those counts give grades 1
to 3. Weights that tell nothing are driven to zero by an L1 penalty.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm.base import by_row, held_out, labelled_sample, stored, text_rows

FIT_ROWS = 8000
VOCABULARY = 60_000
LEAST_ROWS = 4
BEGINNINGS = (4, 5)
KNOWN_WORDS = 300_000
GRADES = 3
PENALTY = 5e-5
ROUNDS = 800
_WORD = re.compile(r"\w+").findall


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(word: str) -> tuple[str, ...]:
    """The word itself and, of longer words, their beginnings."""
    return (word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) >= n))


def counts(text: str) -> Counter:
    """How often each feature occurs in the whole text."""
    out: Counter = Counter()
    for word, n in Counter(_WORD(text.lower())).items():
        for f in features(word):
            out[f] += n
    return out


@dataclass
class Grader:
    """Weights of features and rising thresholds."""
    weights: dict[str, float]
    thresholds: np.ndarray

    def __post_init__(self):
        self.names = sorted(self.weights)
        self.place = {f: i for i, f in enumerate(self.names)}
        self.weight = np.array([self.weights[f] for f in self.names])
        self._forget()

    def _forget(self) -> None:
        """Codes of words: 0 for those without a weighted feature; `held` has the features of the others, three places a word."""
        self.of: dict[str, int] = {}
        self.held: list[list[int]] = [[-1] * (1 + len(BEGINNINGS))]
        self.table = np.array(self.held)

    def _code(self, words: list[str]) -> np.ndarray:
        for w in set(words).difference(self.of):
            found = [self.place[f] for f in features(w) if f in self.place]
            self.of[w] = len(self.held) if found else 0
            if found:
                self.held.append(found + [-1] * (1 + len(BEGINNINGS) - len(found)))
        if len(self.table) < len(self.held):
            self.table = np.concatenate([self.table, self.held[len(self.table):]])
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))

    def score(self, text: str) -> float:
        """The sum of weight times log(1 + count) over the weighted features of the whole text; each distinct word is looked up once."""
        codes = self._code(_WORD(text.lower()))
        word, n = np.unique(codes[codes > 0], return_counts=True)
        at = self.table[word]
        on = at >= 0
        feature, which = np.unique(at[on], return_inverse=True)
        total = np.bincount(which, weights=np.repeat(n, on.sum(axis=1)), minlength=len(feature))
        out = float((self.weight[feature] * np.log1p(total)).sum())
        if len(self.of) > KNOWN_WORDS:
            self._forget()
        return out

    def above(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; falling in k because the thresholds rise."""
        return _sigmoid(score - self.thresholds)


def grades(row: np.ndarray, col: np.ndarray, count: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Grades of the training rows: 0 where not toxic, else by thirds of how many telling words the row holds."""
    bad = y > 0
    n1, n0 = max(1, bad.sum()), max(1, (~bad).sum())
    with_word = np.bincount(col[bad[row]], minlength=width)
    without = np.bincount(col[~bad[row]], minlength=width)
    p = (with_word + without + 1) / (n1 + n0 + 2)
    z = (with_word / n1 - without / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    telling = z > 5
    held = np.bincount(row, weights=count * telling[col], minlength=len(y))
    out = np.zeros(len(y), np.int64)
    if bad.any():
        cuts = np.quantile(held[bad], np.arange(1, GRADES) / GRADES)
        out[bad] = 1 + np.searchsorted(np.unique(cuts), held[bad], side="left")
    return out


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, width: int,
        penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that make the grades likely, by accelerated proximal steps with a fixed step length."""
    n, top = len(grade), int(grade.max(initial=0))
    if not n or not top:
        return np.zeros(width), np.full(max(1, top), np.inf if n else 0.0)
    weight = weight / weight.mean()
    share = np.array([weight[grade >= k].sum() / n for k in range(1, top + 1)])
    theta = np.log((1 - share + 1e-6) / (share + 1e-6))
    scale = (np.bincount(col, weights=weight[row] * value ** 2, minlength=width) / n + 1e-9) ** -0.25
    value = (value * scale[col]).astype(value.dtype)
    probe = np.ones(width)
    for _ in range(20):
        probe = np.bincount(col, weights=value * np.bincount(row, weights=value * probe[col], minlength=n)[row] * weight[row], minlength=width) / n
        largest = float(np.linalg.norm(probe))
        probe /= max(largest, 1e-12)
    step = 2.0 / max(largest, 1e-6)
    w, at, t = np.zeros(width), np.zeros(width), 1.0
    index = np.arange(n)
    for _ in range(rounds):
        s = np.bincount(row, weights=value * at[col], minlength=n)
        above = np.concatenate([np.ones((n, 1)), _sigmoid(s[:, None] - theta[None, :]), np.zeros((n, 1))], axis=1)
        hi, lo = above[index, grade], above[index, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        pull = weight * (dhi - dlo) / p
        slope = np.bincount(col, weights=value * pull[row], minlength=width) / n
        moved = at + step * slope
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        down = np.bincount(np.maximum(grade - 1, 0), weights=np.where(grade > 0, weight * dhi / p, 0), minlength=top)[:top]
        up = np.bincount(np.minimum(grade, top - 1), weights=np.where(grade < top, weight * dlo / p, 0), minlength=top)[:top]
        theta = np.maximum.accumulate(theta + 2.0 * (up - down) / n)
    return w * scale, theta


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Grader:
    """Fit on at most `bound` labelled rows that are not held out.

    Spark counts in how many rows of either label each feature occurs; those of
    LEAST_ROWS rows or more reach the driver, of more than VOCABULARY those whose
    shares differ by the most standard errors. There they lie in 32-bit arrays.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("weight", pa.float64()), ("word", pa.string()), ("n", pa.int32())])

    def each(rows):
        for doc_id, y, weight, text in rows:
            for word, n in (counts(text) or {"": 0}).items():
                yield doc_id, y, weight, word, n
    sample = labelled_sample(docs, labels, "toxic", bound, even=True).select("doc_id", "y", "weight", "text")
    words = stored(sample.mapInArrow(by_row(each, schema, 20_000), "doc_id bigint, y int, weight double, word string, n int"), "words")
    ys = words.groupBy("doc_id").agg(F.first("y").alias("y"), F.first("weight").alias("weight")).toPandas().sort_values("doc_id")
    n1 = max(1, int((ys["y"] > 0).sum()))
    n0 = max(1, len(ys) - n1)
    share = (F.col("docs") + 1) / (n1 + n0 + 2)
    z = (F.col("bad") / n1 - (F.col("docs") - F.col("bad")) / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    known = (words.groupBy("word").agg(F.count("*").alias("docs"), F.sum("y").alias("bad")).withColumn("z", F.abs(z))
             .filter(F.col("docs") >= LEAST_ROWS)
             .orderBy(F.desc("z"), "word").limit(VOCABULARY).select("word").toPandas()["word"].tolist())
    place = docs.sparkSession.createDataFrame([(w, i) for i, w in enumerate(sorted(known))], "word string, col int")
    got = words.join(F.broadcast(place), "word").groupBy("doc_id", "col").agg(F.sum("n").cast("int").alias("n")).select("doc_id", F.col("col").cast("int").alias("col"), "n").toArrow()
    row = np.searchsorted(ys["doc_id"].to_numpy(np.int64), got.column("doc_id").to_numpy()).astype(np.int32)
    col, count = got.column("col").to_numpy().astype(np.int32), got.column("n").to_numpy().astype(np.float32)
    del got
    order = np.lexsort((col, row)).astype(np.int32)
    row, col, count = row[order], col[order], count[order]
    del order
    y, width = ys["y"].to_numpy(np.int64), len(known)
    grade = grades(row, col, count, y, width)
    w, theta = fit(row, col, np.log1p(count), grade, ys["weight"].to_numpy(np.float64), width)
    names = sorted(known)
    return Grader({names[i]: float(w[i]) for i in np.flatnonzero(w)}, theta)


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, severity, grade, toxic) of every row.

    `severity` is the expected grade, the sum of P(grade >= k); `grade` is the
    most probable one, the lower of equals; `toxic` is 1 where grade 1 or above
    is at least as likely as not. A null or empty text scores 0 like a text of
    unknown words. Without toxic labels every severity is 0. Repeated rows score
    alike. Only doc_id and text are read. No rows: an empty result.
    """
    model = train(docs, labels, bound)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.int32())])

    def each(rows):
        grader = Grader(*shared.value)
        for doc_id, text in rows:
            above = grader.above(grader.score(text))
            each_grade = -np.diff(np.concatenate([[1.0], above, [0.0]]))
            yield doc_id, float(above.sum()), int(each_grade.argmax()), int(above[0] >= 0.5)
    scores = text_rows(docs).mapInArrow(by_row(each, schema, 4096), "doc_id bigint, severity double, grade int, toxic int")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "toxic")
