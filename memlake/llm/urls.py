"""URL filters by a bit-parallel wildcard automaton.

All glob patterns lie side by side in rows of 64-bit words, one bit for each state.
A step over one byte shifts all states at once, masks them by what the byte may
enter, and keeps those that a star lets stay. Every URL of a batch takes the same
step together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ANY, STAR = -1, -2
SEPARATOR = "#"  # ends hosts and paths, so it can be in neither

#: Allow and block rules, host and start of the path; subdomains count.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs over host#path that decide where no rule fits; what none of them blocks is allowed.
GLOBS = (("block", "*spam*#*"), ("block", "*pills*#*"), ("block", "*casino*#*"))


def glob(pattern: str) -> list[int]:
    """Elements of a glob: bytes, ANY for ?, STAR for *; a backslash takes the next character as it is."""
    out, plain = [], False
    for c in pattern:
        if not plain and c == "\\":
            plain = True
            continue
        if not plain and c in "*?":
            out.append(STAR if c == "*" else ANY)
        else:
            out += c.encode("utf-8", "surrogatepass")
        plain = False
    return out


def rule_globs(rule: str) -> list[list[int]]:
    """A rule as elements: the host itself, or anything and a dot before it; then the path and anything."""
    host, _, path = rule.partition("/")
    rest = list(f"{host}{SEPARATOR}/{path}".encode()) + [STAR]
    return [rest, [STAR, *b".", *rest]]


class Automaton:
    """Shift-And masks of many globs, each to match a whole line of bytes.

    State j of a glob means that its first j bytes or ANYs are matched. ANY takes
    one code point: it enters on a leading byte and stays on the bytes that follow.
    """

    def __init__(self, globs: list[list[int]]):
        sizes = [1 + sum(e != STAR for e in g) for g in globs]
        bits = sum(sizes)
        self.words = max(1, -(-bits // 64))
        enter, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        begin, final = np.zeros(self.words * 64, bool), []
        lead = (np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)
        at = 0
        for g in globs:
            begin[at] = True
            for e in g:
                if e == STAR:
                    stay[:, at] = True
                    continue
                at += 1
                if e == ANY:
                    enter[lead, at] = True
                    stay[~lead, at] = True
                else:
                    enter[e, at] = True
            final.append(at)
            at += 1
        self.enter, self.stay, self.begin = self._pack(enter), self._pack(stay), self._pack(begin[None])[0]
        self.final = np.array(final, np.int64)

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def matches(self, lines: list[bytes]) -> np.ndarray:
        """Lines x globs: which globs match which whole lines. Longest lines first, so a step is a run of rows."""
        sizes = np.array([len(x) for x in lines], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(lines[i] for i in order), np.uint8)
        sizes = sizes[order]
        starts = np.cumsum(sizes) - sizes
        state = np.tile(self.begin, (len(lines), 1))
        live = len(lines) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")
        for t, n in enumerate(live.tolist()):
            byte = flat[starts[:n] + t]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.enter[byte]) | (now & self.stay[byte])
        hit = np.empty((len(lines), len(self.final)), bool)
        hit[order] = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        return hit


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lowered; empty where there is none."""
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules=RULES, globs=GLOBS, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    Of the rules that fit, the longest decides; of equally long ones a blocking
    one. Where none fits, the first matching glob decides over host#path, and
    `default` where no glob matches; then `rule` is null. Null URLs and those without
    :// have empty host and path. Rows are judged as they stream by; rules are a
    parameter, not a table. Only page_id and url are read. No rows: none.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block"))
    lines = [g for _, r in ordered for g in rule_globs(r)] + [glob(p) for _, p in globs]
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        automaton = Automaton(lines)
        names = np.array([r for _, r in ordered] + [None] * (len(globs) + 1), object)
        verdicts = np.array([v for v, _ in ordered] + [v for v, _ in globs] + [default], object)
        n = len(ordered)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = automaton.matches([f"{h}{SEPARATOR}{p}".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths)])
            fits = np.concatenate([hit[:, :2 * n:2] | hit[:, 1:2 * n:2], hit[:, 2 * n:], np.ones((len(hosts), 1), bool)], axis=1)
            first = fits.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[first].tolist(), pa.string()), pa.array(verdicts[first].tolist(), pa.string())], schema=schema)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).mapInArrow(
        run, "page_id bigint, host string, path string, rule string, verdict string")
