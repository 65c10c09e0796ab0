"""Parsing a column of raw model answers into structs, with a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.text import strip
from memlake.functions.vectors import let

# The text keys worth saving from an answer that is not valid JSON.
SALVAGE_KEYS = ("remaining_shadow", "summary", "logical_gaps", "content")
_BAD = "_bad"


def _fence(raw: Column) -> Column:
    inner = F.regexp_extract(raw, r"(?is)```(?:json)?\s*\n?(.*?)```", 1)
    return strip(F.when(raw.rlike(r"(?is)```(?:json)?\s*\n?(.*?)```"), inner).otherwise(raw))


def _tidy(text: Column) -> Column:
    return strip(F.regexp_replace(text, r",\s*([\]}])", "$1"))


def _outer(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    opened = F.instr(text, F.lit("{"))
    closed = F.length(text) - F.instr(F.reverse(text), F.lit("}")) + 1
    return F.when((opened > 0) & F.contains(text, F.lit("}")) & (closed > opened),
                  F.substr(text, opened, closed - opened + 1))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def _struct_type(schema: str) -> str:
    return "struct<" + ", ".join(": ".join(part.split()) for part in schema.split(",")) + ">"


def _salvage(text: Column, schema: str) -> Column:
    """Struct rebuilt from `"key": "value"` pairs of the known text keys."""
    fields = []
    for name in _names(schema):
        if name in SALVAGE_KEYS:
            got = F.regexp_extract_all(text, F.lit(f'(?s)"{name}"\\s*:\\s*"(.*?)"\\s*(?:,|\\}})'), F.lit(1))
            fields.append(F.replace(F.get(got, F.lit(0)), F.lit('\\"'), F.lit('"')).alias(name))
        else:
            fields.append(F.lit(None).alias(name))
    return F.struct(*fields).cast(_struct_type(schema))


def response_parse(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Add `stage` and `parsed`; `stage` names the first reading that worked.

    `schema` is a flat list such as "summary string, char_count int". Each
    reading is tried only when the one before failed, in one narrow pass of
    built-in expressions.
    """
    names = _names(schema)
    read = lambda c: F.from_json(F.when(F.startswith(c, F.lit("{")), c), f"{schema}, {_BAD} string",
                                 {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    found = lambda stage, value: F.struct(F.lit(stage).alias("stage"), value.alias("parsed"))
    plain = lambda p: F.struct(*[p[n].alias(n) for n in names]).cast(_struct_type(schema))
    none = F.lit(None).cast(_struct_type(schema))

    def attempt(text: Column, stage: str, other) -> Column:
        return let(text, lambda c: let(read(c), lambda p: F.when(
            p.isNotNull() & p[_BAD].isNull(), found(stage, plain(p))).otherwise(other(c))))

    def salvage(c: Column) -> Column:
        def judge(p: Column) -> Column:
            any_set = p[names[0]].isNotNull()
            for n in names[1:]:
                any_set = any_set | p[n].isNotNull()
            return F.when(any_set, found("salvaged", p)).otherwise(found("rejected", none))
        return let(_salvage(c, schema), judge)

    outcome = attempt(
        _tidy(_fence(F.col(col))), "clean", lambda c: attempt(
            _tidy(F.regexp_replace(c, r"[\x00-\x1f]", " ")), "controls", lambda d: attempt(
                _tidy(_outer(d)), "braces", salvage)))
    return df.withColumn("_o", outcome).withColumns({"stage": F.col("_o.stage"), "parsed": F.col("_o.parsed")}).drop("_o")


def response_reject(parsed: DataFrame, col: str) -> DataFrame:
    """Answers nothing could be read from, with the reason."""
    return parsed.filter(F.col("stage") == "rejected").withColumn(
        "reason", F.when(strip(F.coalesce(F.col(col), F.lit(""))) == "", "empty").otherwise("no_json"))


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("append").partitionBy("task_type").parquet(path)
