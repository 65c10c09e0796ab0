"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.config import (DEFAULT, EMOTION_PATTERN, ENTITY_PATTERN, PLACEHOLDER_NAMES,
                            RELATIONS, UNKNOWN_PREFIX, MemoryConfig)

# Sentence ends, and the marks that may trail a chunk.
SENTENCE_END = "。！？；!?\n"
CHUNK_STOPS = "。"
CLOSING_MARKS = "”』〉\"'"
CHUNK_END_MARKS = "。！？”』〉\"'"


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def squeeze(col: Column) -> Column:
    """Text without any white space, for layout-blind comparison."""
    return F.regexp_replace(col, r"\s+", "")


def same_text(a: Column, b: Column) -> Column:
    return squeeze(a) == squeeze(b)


def sentences(col: Column) -> Column:
    """Array of trimmed, non-blank sentences, each keeping its end mark."""
    parts = F.split(col, f"(?<=[{SENTENCE_END}])")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


def numbered(sents: Column) -> Column:
    """`[i] sentence` lines, counted from 1."""
    lines = F.transform(sents, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s))
    return F.array_join(lines, "\n")


def pick_sentences(sents: Column, indices: Column) -> Column:
    """Join sentences by 1-based index; indices out of range are ignored."""
    ok = F.filter(indices, lambda i: (i >= 1) & (i <= F.size(sents)))
    return F.array_join(F.transform(ok, lambda i: F.get(sents, i.cast("int") - 1)), "")


def stub(event_id: Column, text: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    return F.concat(F.lit("["), event_id, F.lit("] "), F.substring(text, 1, cfg.stub_chars), F.lit("…"))


def term_hits(text: Column, terms) -> Column:
    """How many of the given terms occur in the text, ignoring case."""
    low = F.lower(text)
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(low, F.lit(term.lower())).cast("int")
    return total


def hard_intent(text: Column) -> Column:
    return (
        F.when(text.rlike(f"(?i){ENTITY_PATTERN}"), "entity_trace")
        .when(text.rlike(f"(?i){EMOTION_PATTERN}"), "emotion")
        .otherwise("fact")
    )


def bad_name(name: Column) -> Column:
    """A name of digits only, blank, or a placeholder word."""
    return name.rlike(r"^[0-9]+$") | (strip(name) == "") | F.lower(name).isin(*PLACEHOLDER_NAMES)


def clean_name(name: Column, role_id: Column) -> Column:
    return F.when(bad_name(name), F.concat(F.lit(UNKNOWN_PREFIX), F.right(role_id, F.lit(4)))).otherwise(name)


def fingerprint(ids: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(ids)), "|")


def insight(relation: Column, conclusion: Column) -> Column:
    """`[relation] conclusion`; unknown relations count as NONE, which yields no insight."""
    rel = F.upper(F.coalesce(relation, F.lit("NONE")))
    rel = F.when(rel.isin(*RELATIONS), rel).otherwise("NONE")
    return F.when(rel != "NONE", F.concat(F.lit("["), rel, F.lit("] "), conclusion))


def act_text(summaries: Column, raw: Column, limit: int = 4000) -> Column:
    pick = lambda k: F.nullif(summaries[k], F.lit(""))
    return F.substring(F.coalesce(pick("L2"), pick("L1"), raw), 1, limit)


def tail(col: Column, n: int) -> Column:
    return F.right(col, F.lit(n))


def trim_markers(text: Column, start: str, end: str) -> Column:
    """Text between two markers; a missing marker leaves that side open."""
    at = F.locate(start, text)
    body = F.when(at > 0, F.substr(text, at + len(start))).otherwise(text)
    stop = F.expr("1") * F.instr(body, F.lit(end))
    body = F.when(stop > 0, F.substr(body, F.lit(1), stop - 1)).otherwise(body)
    return strip(F.replace(body, F.lit("\r\n"), F.lit("\n")))
