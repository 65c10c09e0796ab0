"""Columns parsed from enrichment answers: summary ladders and role lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.config import EMOTIONS
from memlake.functions import affect
from memlake.functions.text import strip

_TEXT = "name string, role_id string, entity_type string, importance string"
_SNAP = "snapshot struct<l1_mention: string, l2_interaction: string, l3_decision: string>"
ROLES = ("array<struct<" + ", ".join(f.replace(" ", ": ") for f in _TEXT.split(", ")) + ", "
         + _SNAP.replace("snapshot ", "snapshot: ") + ", emotion: map<string,string>>>")


def summary_parse(raw: Column) -> Column:
    """Level map of a JSON object: keys `L<digits>` with non-blank text, trimmed."""
    m = F.from_json(raw, "map<string,string>")
    named = F.map_filter(m, lambda k, v: k.rlike(r"^L[0-9]+$") & v.isNotNull())
    return F.map_filter(F.transform_values(named, lambda _, v: strip(v)), lambda _, v: F.length(v) > 0)


def role_names(raw: Column) -> Column:
    """Names of a JSON array of strings or objects, trimmed, each once, order kept."""
    items = F.from_json(raw, "array<string>")
    name = lambda s: F.when(F.startswith(s, F.lit("{")), F.get_json_object(s, "$.name")).otherwise(s)
    names = F.transform(items, lambda s: strip(name(s)))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def role_parse(df: DataFrame, key: str, raw: str) -> DataFrame:
    """One row per full role entry; bad numbers count as 0, unknown importance as C."""
    rows = df.select(key, F.posexplode(F.from_json(F.col(raw), ROLES)).alias("pos", "r")).filter(F.col("r").isNotNull())
    num = {e: F.coalesce(F.expr(f"try_cast(r.emotion['{e}'] as double)"), F.lit(0.0)) for e in EMOTIONS}
    imp = F.coalesce("r.importance", F.lit("C"))
    out = rows.select(
        key, "pos", "r.role_id", F.coalesce("r.name", F.lit("")).alias("name"),
        F.coalesce("r.entity_type", F.lit("person")).alias("entity_type"),
        F.when(imp.isin("S", "A", "B", "C", "D"), imp).otherwise("C").alias("importance"),
        "r.snapshot.*", *[c.alias(e) for e, c in num.items()])
    return out.withColumns({"arousal": affect.arousal(F.col), "valence": affect.valence(F.col)})
