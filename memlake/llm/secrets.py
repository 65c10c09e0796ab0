"""Secret scans: fixed patterns, and formats learnt from the credentials that the patterns find.

The learnt formats are stochastic automata. A prefix tree of labelled credentials
is folded by merging states whose continuations agree within Hoeffding bounds, red
states against blue ones, shortest prefixes first. A candidate word that no fixed
pattern covers is a finding when an automaton explains it far better than a chain
over ordinary words does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.base import all_columns, by_row, free_name, stored, text_column, text_rows

# The patterns and least sizes of the base findings, in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = r"[A-Za-z0-9+/_.=-]+"
CANDIDATE_LEAST = 16
NODE_SHARE = 1000
NODE_DEPTH = 128
ALPHA = 0.05
LEAST_GAIN = 0.5
BLOCK_WORDS = 65_536

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")  # a shorter match ends where its run ends, so none is hidden in it
_HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")
_CANDIDATE = re.compile(CANDIDATE[:-1] + f"{{{CANDIDATE_LEAST},}}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])").match


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points by start, then kind; each kind leftmost and without overlap."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def credential(text: str, span: tuple[int, int, int]) -> str:
    """The secret itself: of an assignment only the assigned value."""
    return _ASSIGN.match(text, span[0]).group(2) if span[2] == 0 else text[span[0]:span[1]]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long words with a letter and a digit that touch no base finding."""
    out, at, reach = [], 0, -1
    for m in _CANDIDATE.finditer(text):
        if not _MIXED(m.group()):
            continue
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            out.append((m.start(), m.end()))
    return out


def symbols(word: str) -> str:
    """Digits as 0, a-f as h, other small letters as z, A-F as H, other capitals as Z; the rest stays."""
    return "".join("0" if c in "0123456789" else "h" if c in "abcdef" else "z" if "a" <= c <= "z" else
                   "H" if c in "ABCDEF" else "Z" if "A" <= c <= "Z" else c for c in word)


@dataclass
class Automaton:
    """States with counts of endings and of steps by symbol; state 0 is the start."""
    ends: list[int] = field(default_factory=lambda: [0])
    steps: list[dict[str, int]] = field(default_factory=lambda: [{}])
    to: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def add(self, word: str) -> None:
        at = 0
        for s in word:
            self.steps[at][s] = self.steps[at].get(s, 0) + 1
            if s not in self.to[at]:
                self.to[at][s] = len(self.ends)
                self.ends.append(0)
                self.steps.append({})
                self.to.append({})
            at = self.to[at][s]
        self.ends[at] += 1

    def total(self, at: int) -> int:
        return self.ends[at] + sum(self.steps[at].values())

    def log_likelihood(self, word: str) -> float:
        """Log probability of the word, each step smoothed over all symbols and the end; a step never seen keeps the state."""
        at, out = 0, 0.0
        for s in word:
            n = self.total(at)
            out += np.log((self.steps[at].get(s, 0) + 0.05) / (n + 0.05 * 72))
            at = self.to[at].get(s, at)
        return out + np.log((self.ends[at] + 0.05) / (self.total(at) + 0.05 * 72))


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (n1 ** -0.5 + n2 ** -0.5)


def _compatible(a: Automaton, red: int, blue: int, bound: float) -> bool:
    """Whether two states, and those that follow them, end and step alike within the bound."""
    todo = [(red, blue)]
    while todo:
        p, q = todo.pop()
        n, m = a.total(p), a.total(q)
        if _differ(a.ends[p], n, a.ends[q], m, bound):
            return False
        for s in a.steps[p].keys() | a.steps[q].keys():
            if _differ(a.steps[p].get(s, 0), n, a.steps[q].get(s, 0), m, bound):
                return False
            if s in a.to[p] and s in a.to[q]:
                todo.append((a.to[p][s], a.to[q][s]))
    return True


def _fold(a: Automaton, red: int, blue: int) -> None:
    """Add the tree below `blue` to the automaton at `red`."""
    todo = [(red, blue)]
    while todo:
        p, q = todo.pop()
        a.ends[p] += a.ends[q]
        for s, n in a.steps[q].items():
            a.steps[p][s] = a.steps[p].get(s, 0) + n
            if s not in a.to[q]:
                continue
            if s in a.to[p]:
                todo.append((a.to[p][s], a.to[q][s]))
            else:
                a.to[p][s] = a.to[q][s]


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of a few words, all in memory."""
    a = Automaton()
    for w in sorted(words):
        a.add(w)
    return merged(a, alpha)


def grown(nodes: list[tuple[str, dict[str, int]]]) -> Automaton:
    """The prefix tree whose nodes are given as (prefix, counts by next symbol, the end being ""); a step to no node of the list leads nowhere."""
    a, at = Automaton([], [], []), {}
    for prefix, counts in sorted(nodes, key=lambda n: (len(n[0]), n[0])):
        at[prefix] = len(a.ends)
        a.ends.append(counts.get("", 0))
        a.steps.append({s: n for s, n in counts.items() if s})
        a.to.append({})
        if prefix:
            a.to[at[prefix[:-1]]][prefix[-1]] = at[prefix]
    return a


def merged(a: Automaton, alpha: float = ALPHA) -> Automaton:
    """Merge the states of a prefix tree, each blue state into the first red one that fits, else it turns red."""
    bound = float(np.sqrt(0.5 * np.log(2 / alpha)))
    red = [0]
    while True:
        known = set(red)
        blue = next(((p, s, q) for p in red for s, q in sorted(a.to[p].items()) if q not in known), None)
        if blue is None:
            return a
        p, s, q = blue
        for r in red:
            if _compatible(a, r, q, bound):
                a.to[p][s] = r
                _fold(a, r, q)
                break
        else:
            red.append(q)


def compact(a: Automaton) -> Automaton:
    """Only the states that the start leads to; a merged tree leaves the others behind."""
    order = [0]
    place = {0: 0}
    for p in order:
        for _, q in sorted(a.to[p].items()):
            if q not in place:
                place[q] = len(order)
                order.append(q)
    return Automaton([a.ends[p] for p in order], [a.steps[p] for p in order], [{s: place[q] for s, q in a.to[p].items()} for p in order])


@dataclass
class Formats:
    """One automaton for each kind of credential, and the chain over ordinary words that they are held against."""
    automata: list[Automaton]
    plain: dict[str, dict[str, float]]

    def gain(self, word: str) -> float:
        """The best automaton's log likelihood over that of the chain, for each symbol of the word."""
        if not self.automata:
            return -np.inf
        word = symbols(word)
        chain, was = 0.0, "^"
        for s in word + "$":
            row = self.plain.get(was, {})
            chain += np.log((row.get(s, 0.0) + 0.5) / (sum(row.values()) + 0.5 * 72))
            was = s
        return (max(a.log_likelihood(word) for a in self.automata) - chain) / (len(word) + 1)


def learn(labelled: dict[int, list[str]], words: list[str]) -> Formats:
    """`labelled` has distinct credentials by kind, `words` ordinary long words; both held in memory."""
    plain: dict[str, Counter] = {}
    for w in words:
        w = symbols(w)
        for a, b in zip("^" + w, w + "$"):
            plain.setdefault(a, Counter())[b] += 1
    return Formats([infer([symbols(w) for w in ws]) for _, ws in sorted(labelled.items()) if ws],
                   {k: dict(v) for k, v in plain.items()})


_SPAN = "array<struct<start:int,end:int,kind:int>>"
_FOUND = pa.schema([
    ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))),
    ("values", pa.list_(pa.string())),
    ("words", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())]))),
])


def _as_spans(spans):
    return [{"start": a, "end": b, "kind": k} for a, b, k in spans]


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, base, values, words) of every row: base spans, their credentials, and candidate words with their places."""
    def each(rows):
        for doc_id, text in rows:
            base = base_spans(text)
            yield (doc_id, _as_spans(base), [credential(text, s) for s in base],
                   [{"start": a, "end": b, "word": text[a:b]} for a, b in candidates(text, base)])
    return text_rows(docs).mapInArrow(
        by_row(each, _FOUND, 2048),
        f"doc_id bigint, base {_SPAN}, values array<string>, words array<struct<start:int,end:int,word:string>>")


def _coded(word: Column) -> Column:
    """`symbols` as a column."""
    digits, small, capital = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(word, digits + small + capital, "0" * 10 + "h" * 6 + "z" * 20 + "H" * 6 + "Z" * 20)


def _nodes(words: DataFrame, share: int) -> dict[int, list[tuple[str, dict[str, int]]]]:
    """By kind the nodes of the prefix tree of all words (kind, word, n) that at least one in `share` of them pass, up to NODE_DEPTH symbols deep."""
    sizes = words.groupBy("kind").agg(F.ceil(F.sum("n") / share).alias("least"))
    at = F.explode(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(NODE_DEPTH)))).alias("at")
    steps = (words.select("kind", "word", "n", at)
             .groupBy("kind", F.expr("substring(word, 1, at)").alias("prefix"), F.expr("substring(word, at + 1, 1)").alias("step")).agg(F.sum("n").alias("n")))
    nodes = (steps.groupBy("kind", "prefix").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("steps"))
             .join(F.broadcast(sizes), "kind").filter("total >= least"))
    out: dict[int, list] = {}
    for r in nodes.select("kind", "prefix", "steps").collect():
        out.setdefault(r.kind, []).append((r.prefix, r.steps))
    return out


def _counts(words: DataFrame, walk: Callable[[int, str], Iterable[tuple[int, str, str]]]) -> list:
    """(kind, at, step, n) summed over all words (kind, word, n); `walk` gives the steps of one word. Tasks give sums only."""
    schema = pa.schema([("kind", pa.int32()), ("at", pa.string()), ("step", pa.string()), ("n", pa.int64())])

    def each(rows):
        sums: Counter = Counter()
        for kind, word, n in rows:
            for key in walk(kind, word):
                sums[key] += n
        for key, n in sums.items():
            yield *key, n
    return (words.select("kind", "word", "n").mapInArrow(by_row(each, schema, 4096), "kind int, at string, step string, n bigint")
            .groupBy("kind", "at", "step").agg(F.sum("n").alias("n")).collect())


def _chain(kind: int, word: str):
    return ((kind, a, b) for a, b in zip("^" + word, word + "$"))


def train(found: DataFrame, share: int = NODE_SHARE) -> Formats:
    """Learn from all distinct credentials of each kind and all distinct candidates.

    Spark counts the nodes of each kind's prefix tree. Those that at least one in
    `share` credentials pass (all, where there are no more than that) and that are at most
    NODE_DEPTH symbols deep become states and are merged in the driver: at most `share` at
    each depth, whatever the corpus. Then every credential, whole, walks the merged states, and
    the counts of the automaton are those of all its steps; where a step leads to no state
    the walk stays, as it does in scoring. Candidates are mostly ordinary (addresses, numbers, names),
    which is what the chain is to describe; its counts have a cell for each pair of symbols.
    """
    values = found.select(F.explode(F.arrays_zip(F.col("base.kind").alias("kind"), F.col("values").alias("value"))).alias("v"))
    values = values.select(F.col("v.kind").alias("kind"), F.col("v.value").alias("value")).distinct()
    words = stored(values.groupBy("kind", _coded(F.col("value")).alias("word")).agg(F.count("*").alias("n")), "credentials")
    automata = {kind: compact(merged(grown(nodes))) for kind, nodes in sorted(_nodes(words, share).items())}
    to = {kind: a.to for kind, a in automata.items()}

    def walk(kind, word):
        at, steps = 0, to[kind]
        for s in word:
            yield kind, str(at), s
            at = steps[at].get(s, at)
        yield kind, str(at), ""
    for a in automata.values():
        a.ends, a.steps = [0] * len(a.to), [{} for _ in a.to]
    for r in _counts(words, walk):
        a, at = automata[r.kind], int(r["at"])
        if r.step:
            a.steps[at][r.step] = r.n
        else:
            a.ends[at] = r.n
    plain: dict[str, dict[str, int]] = {}
    ordinary = found.select(F.explode("words.word").alias("word")).distinct().select(F.lit(0).alias("kind"), _coded(F.col("word")).alias("word"), F.lit(1).alias("n"))
    for r in _counts(ordinary, _chain):
        plain.setdefault(r["at"], {})[r.step] = r.n
    return Formats(list(automata.values()), plain)


class _Scorer:
    """Gains of words; those of words seen before are kept, within a bound."""

    def __init__(self, formats: Formats):
        self.formats, self.known = formats, {}

    def hit(self, word: str) -> bool:
        if word not in self.known:
            if len(self.known) >= BLOCK_WORDS:
                self.known.clear()
            self.known[word] = self.formats.gain(word) >= LEAST_GAIN
        return self.known[word]


def _share(df: DataFrame, formats: Formats):
    plain = [(a.ends, a.steps, a.to) for a in formats.automata]
    return df.sparkSession.sparkContext.broadcast((plain, formats.plain))


def _scorer(shared) -> _Scorer:
    automata, plain = shared.value
    return _Scorer(Formats([Automaton(*a) for a in automata], plain))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start,end,kind>>) of every row, by start and then kind; kinds as in KINDS.

    Base spans are whole matches and always stay; spans of kind "format" are
    candidate words that a learnt automaton explains at least LEAST_GAIN nats a
    symbol better than the chain over ordinary words. Places are code points,
    ends exclusive. A null or empty text has no spans; repeated rows are scanned
    again; without labelled credentials nothing is added. Only doc_id and text
    are read. The texts are read once; what is found is stored for the rest.
    """
    found = stored(findings(docs), "findings")
    shared = _share(docs, train(found))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _FOUND.field("base").type)])

    def each(rows):
        scorer = _scorer(shared)
        for doc_id, base, words in rows:
            added = [{"start": w["start"], "end": w["end"], "kind": 3} for w in words if scorer.hit(w["word"])]
            yield doc_id, sorted(base + added, key=lambda s: (s["start"], s["kind"]))
    return found.select("doc_id", "base", "words").mapInArrow(by_row(each, schema, 4096), f"doc_id bigint, spans {_SPAN}")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows of `docs` with every found span (overlapping ones together) replaced in the text; n_chars follows the text.

    Rows without findings stay exactly as they are. The formats are learnt from one
    pass over the texts and applied in a second one, which moves no text between tasks.
    """
    shared = _share(docs, train(stored(findings(docs), "findings")))
    text, new = F.col("text"), free_name(docs, "new_text")

    def clean(text, scorer):
        base = base_spans(text)
        spans = sorted([(a, b) for a, b, _ in base] + [s for s in candidates(text, base) if scorer.hit(text[s[0]:s[1]])])
        out, done = [], 0
        for a, b in spans:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join(out) + text[done:] if spans else text

    def start():
        scorer = _scorer(shared)
        return lambda texts: [t if t is None else clean(t, scorer) for t in texts]
    changed = docs.withColumn(new, text_column(docs.sparkSession, start, "string", pa.string())(text))
    keep = {c: column for c, column in zip(docs.columns, all_columns(docs.columns))}
    if "n_chars" in keep:
        keep["n_chars"] = F.when(text.eqNullSafe(F.col(new)), F.col("n_chars").cast("bigint")).otherwise(F.length(new)).cast("bigint")
    keep["text"] = F.col(new)
    return changed.select(*[column.alias(c) for c, column in keep.items()])
