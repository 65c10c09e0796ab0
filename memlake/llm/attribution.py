"""Token counts of fields and sections from one encoding of the whole text.

A text is encoded once. The bytes of its tokens give every token's characters;
characters belong to sections, and a token counts for the section that holds its
characters. Tokens that cross a boundary follow a stated rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.base import by_row
from memlake.llm.bpe import Codec, load_ranks

SECTIONS = "array<struct<name:string,start:int,end:int>>"
RULES = ("largest", "first", "shared")
OUTSIDE = "outside"
PART_CHARS = 200_000
_RESULT = ("doc_id bigint, n_tokens bigint, crossing bigint, "
           "sections array<struct<name:string,start:int,end:int,tokens:double>>, outside double")


def from_fields(fields: list[str], separator: str = "\n\n") -> tuple[Column, Column]:
    """Text and sections of a record whose fields are written one after the other; null fields are empty.

    The separator follows every field but the last and belongs to no section.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, sections = F.lit(0), []
    for name, text in zip(fields, texts):
        sections.append(F.struct(F.lit(name).alias("name"), at.alias("start"), (at + F.length(text)).alias("end")))
        at = at + F.length(text) + len(separator)
    return F.concat_ws(separator, *texts), F.array(*sections).cast(SECTIONS)


def with_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """`docs` with the rows of a table (doc_id, name, start, end) as a list of sections, by start, end and name.

    Joined by doc_id; a document without sections has an empty list. Sections of one
    document come together, so they are as bounded as its text.
    """
    lists = (sections.select("doc_id", F.struct("start", "end", "name").alias("s")).groupBy("doc_id")
             .agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["name"].alias("name"), s["start"].alias("start"), s["end"].alias("end"))).alias("sections")))
    return docs.select("doc_id", "text").join(lists.withColumn("sections", F.col("sections").cast(SECTIONS)), "doc_id", "left")


def line_lengths(text: str) -> list[tuple[int, int]]:
    """Places of the lines of a text, each with its line end."""
    size = np.array([len(x) for x in text.split("\n")], np.int64) + 1
    ends = np.cumsum(size)
    ends[-1] -= 1
    return [(a, b) for a, b in zip((ends - size + (np.arange(len(size)) == len(size) - 1)).tolist(), ends.tolist()) if b > a]


def token_spans(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token; a token that is part of a character's bytes has that character."""
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1]


def owners(length: int, sections: list[tuple[int, int]]) -> np.ndarray:
    """The section of each character, -1 outside; where sections overlap, the one that is listed first."""
    out = np.full(length, -1, np.int64)
    for i in range(len(sections) - 1, -1, -1):
        a, b = sections[i]
        out[max(0, a):max(0, b)] = i
    return out


def allocate(first: np.ndarray, last: np.ndarray, owner: np.ndarray, n: int, rule: str) -> tuple[np.ndarray, float, int]:
    """Tokens of each of n sections, tokens outside, and how many tokens cross a boundary.

    largest: the section (or the outside) with most of the token's characters, of equals the one that comes first in the token;
    first: where its first character lies; shared: each by its share of the characters.
    """
    count = np.zeros(n + 1)
    if not len(first):
        return count[:n], 0.0, 0
    change = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
    cross = change[first] != change[last]
    whole = first if rule == "first" else first[~cross]
    count += np.bincount(owner[whole] % (n + 1), minlength=n + 1)
    if rule != "first":
        for a, b in zip(first[cross].tolist(), last[cross].tolist()):
            own = owner[a:b + 1]
            kinds, at, size = np.unique(own, return_index=True, return_counts=True)
            if rule == "shared":
                count[kinds % (n + 1)] += size / len(own)
            else:
                count[kinds[np.lexsort((at, -size))[0]] % (n + 1)] += 1
    return count[:n], float(count[n]), int(cross.sum())


class Encoder:
    """Whole-text encoding; of very long texts, parts that end where no match of the pattern can go on are encoded in turn.

    A part that stays very long (one run of blanks or letters without such a place)
    is cut into the pattern's matches first, which the library's own pattern engine has no stack for.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("attribution", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks, self.pattern, self.codec = ranks, pattern, None
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def token_sizes(self, text: str) -> np.ndarray:
        """Bytes of each token of the text."""
        return np.concatenate([self.sizes[self._ids(p)] for p in parts(text)] or [np.zeros(0, np.int64)])

    def _ids(self, part: str):
        if len(part) <= 2 * PART_CHARS:
            return self.encoding.encode_ordinary(part)
        if self.codec is None:
            self.codec = Codec(self.ranks, self.pattern)
        return np.frombuffer(self.codec.encode([part])[0], "<u4")


def parts(text: str, size: int = PART_CHARS):
    """The text in parts of at least `size` characters, cut between a letter and a blank that a letter follows.

    The pattern starts a match at such a blank whatever comes before, so the tokens are those of the whole text.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def attribute(docs: DataFrame, path: str, pattern: str, rule: str = "largest", sections: str | None = "sections") -> DataFrame:
    """(doc_id, n_tokens, crossing, sections with tokens, outside) of every row.

    `docs` has doc_id, text and optionally the column that `sections` names (name, start
    and end in characters); without it, or if it is None, the lines of a text are its sections, named
    by number from 1. Places beyond the text hold nothing, null places are empty, overlapping
    characters belong to the section listed first. Counts always add up to
    n_tokens. Null texts are empty and have no tokens; repeated rows are counted again. Only
    these columns are read; the vocabulary is read on the driver and broadcast.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    own = sections is not None and sections in docs.columns
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crossing", pa.int64()), ("sections", pa.list_(pa.struct([
        ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.float64())]))), ("outside", pa.float64())])

    def each(rows):
        encoder = Encoder(ranks.value, pattern)
        for doc_id, text, *given in rows:
            if own:
                named = [(s["name"], s["start"] or 0, s["end"] or 0) for s in given[0] or () if s is not None]
            else:
                named = [(str(i), a, b) for i, (a, b) in enumerate(line_lengths(text), 1)]
            sizes = encoder.token_sizes(text)
            first, last = token_spans(text.encode("utf-8", "surrogatepass"), sizes) if len(sizes) else (sizes, sizes)
            count, outside, crossing = allocate(first, last, owners(len(text), [s[1:] for s in named]), len(named), rule)
            yield (doc_id, len(sizes), crossing, [{"name": n, "start": a, "end": b, "tokens": c} for (n, a, b), c in zip(named, count.tolist())], outside)
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, *([F.col(sections).cast(SECTIONS).alias("sections")] if own else []))
    return rows.mapInArrow(by_row(each, schema), _RESULT)
