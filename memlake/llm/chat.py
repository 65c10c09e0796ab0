"""Chat formatting: layouts recognised by fingerprints of their field paths, one canonical form, one template.

Each known layout is declared as the nested field paths it has and how they give
turns. The fingerprint of a table's schema, or of every JSON record on its own,
is the hash of those of its paths that any layout knows; equal hashes select the
mapping. Everything is column expressions: no Python runs on the rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role; the fields that are not empty are joined by a blank line."""
    role: str
    fields: tuple[str, ...]

    def paths(self) -> tuple[str, ...]:
        return self.fields


@dataclass(frozen=True)
class Each:
    """One turn for each element of an array of objects, roles renamed where a new name is given."""
    array: str
    role: str
    text: str
    rename: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> tuple[str, ...]:
        return f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"


@dataclass(frozen=True)
class Row:
    """The record itself is one turn of a conversation."""
    role: str
    text: str
    also: tuple[str, ...] = ()

    def paths(self) -> tuple[str, ...]:
        return self.role, self.text, *self.also


@dataclass(frozen=True)
class Layout:
    name: str
    steps: tuple[Said | Each | Row, ...]

    def paths(self) -> frozenset[str]:
        return frozenset(p for s in self.steps for p in s.paths())


LAYOUTS = (
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout("shared", (Each("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),)),
    Layout("instruction", (Said("user", ("instruction",)), Said("assistant", ("output",)))),
    Layout("instruction_input", (Said("user", ("instruction", "input")), Said("assistant", ("output",)))),
    Layout("instruction_system", (Said("system", ("system",)), Said("user", ("instruction", "input")), Said("assistant", ("output",)))),
    Layout("prompt_completion", (Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("prompt_response", (Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout("question_answer", (Said("user", ("question",)), Said("assistant", ("answer",)))),
    Layout("turn_rows", (Row("role", "text", ("conv_id", "turn")),)),
)


def vocabulary(layouts=LAYOUTS) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths()})


def fingerprint(paths, layouts=LAYOUTS) -> str:
    """Hash of the known ones among the paths; others, such as ids and scores, do not count."""
    known = set(vocabulary(layouts))
    return hashlib.sha256("\n".join(sorted(known.intersection(paths))).encode()).hexdigest()


def schema_paths(schema: T.DataType, prefix: str = "") -> set[str]:
    """Paths of all leaves: a.b inside objects, a[] for arrays."""
    if isinstance(schema, T.StructType):
        return {p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix + "[]")
    return {prefix}


def select_layout(paths, layouts=LAYOUTS) -> Layout | None:
    """The layout whose fingerprint the paths have."""
    wanted = fingerprint(paths, layouts)
    return next((x for x in layouts if fingerprint(x.paths(), layouts) == wanted), None)


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts])


def _renamed(role: Column, names: dict[str, str]) -> Column:
    for old, new in sorted(names.items()):
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(items: Column, names: dict[str, str]) -> Column:
    return F.transform(items, lambda e: _turn(_renamed(e["role"], names), e["text"]))


def _turns(layout: Layout, get, elements) -> Column:
    """Array of turns; `get` gives a field as text, `elements` an array of (role, text) texts."""
    parts = []
    for s in layout.steps:
        if isinstance(s, Said):
            turn = F.array(_turn(F.lit(s.role), _joined([F.coalesce(get(f), F.lit("")) for f in s.fields])))
            parts.append(F.when(turn[0]["text"] == "", F.array().cast(f"array<{TURN}>")).otherwise(turn) if s.role == "system" else turn)
        elif isinstance(s, Row):
            parts.append(F.array(_turn(get(s.role), get(s.text))))
        else:
            parts.append(F.coalesce(_listed(elements(s), s.rename), F.array().cast(f"array<{TURN}>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def canonical_table(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """The columns of `df` with `layout` and `turns`, by the fingerprint of its schema.

    Columns that no layout names are ignored by the fingerprint and kept. An
    unknown schema raises ValueError, since it holds for every row.
    """
    layout = select_layout(schema_paths(df.schema), layouts)
    if layout is None:
        raise ValueError(f"no layout has the paths {sorted(set(vocabulary(layouts)).intersection(schema_paths(df.schema)))}")

    def elements(s: Each):
        return F.transform(F.coalesce(F.filter(s.array, lambda e: e.isNotNull()), F.array()), lambda e: F.struct(
            e[s.role].cast("string").alias("role"), e[s.text].cast("string").alias("text")))
    return df.withColumns({"layout": F.lit(layout.name), "turns": _turns(layout, lambda f: F.col(f).cast("string"), elements)})


def canonical_records(df: DataFrame, raw: str, layouts=LAYOUTS) -> DataFrame:
    """The columns of `df` with `fingerprint`, `layout` and `turns`, each JSON record in `raw` by its own paths.

    A field of the wrong kind (a text where an array is meant) is not its path.
    A record that is null, no JSON, or of no known layout, also one that has the
    fields of two, keeps its row with a null layout and no turns. A null field is
    present and an empty text.
    """
    record = F.try_parse_json(F.col(raw))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(record, path, "variant"))

    def has(path: str) -> Column:
        if "[]." in path:
            array, name = path.split("[].")
            inner = kind(f"$.{array}")
            return inner.startswith("ARRAY<OBJECT<") & inner.rlike(rf"[<\s]{name}: ")
        return kind(f"$.{path}").isNotNull() & ~kind(f"$.{path}").rlike("^(ARRAY|OBJECT)<")
    known = [F.when(has(p), F.lit(p)) for p in vocabulary(layouts)]
    out = df.withColumn("fingerprint", F.when(record.isNotNull(), F.sha2(F.concat_ws("\n", *known), 256)))

    def get(name):
        return F.try_variant_get(record, f"$.{name}", "string")

    def elements(s: Each):
        items = F.try_variant_get(record, f"$.{s.array}", "array<variant>")
        return F.transform(items, lambda e: F.struct(
            F.try_variant_get(e, f"$.{s.role}", "string").alias("role"), F.try_variant_get(e, f"$.{s.text}", "string").alias("text")))
    name, turns = F.lit(None).cast("string"), F.array().cast(f"array<{TURN}>")
    for layout in layouts:
        mine = F.col("fingerprint") == fingerprint(layout.paths(), layouts)
        name = F.when(mine, F.lit(layout.name)).otherwise(name)
        turns = F.when(mine, _turns(layout, get, elements)).otherwise(turns)
    return out.withColumns({"layout": name, "turns": turns})


def escape(text: Column) -> Column:
    """No control string can stand in the result: a backslash more between < and |."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: percent codes for %, <, and line ends."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame, key: str = "conv_id", order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """(key, formatted, spans): one text for each conversation, and where its turns and loss lie in it.

    `turns` has rows of key, order columns, role and text. Turns follow the order
    columns, nulls first, ties by role and text; repeated rows are turns like any
    other. Null roles and texts are empty; rows with a null key are one conversation.
    A span is [begin, end) of a turn in code points and, for assistants, [loss_begin,
    loss_end) of its text. A conversation is one value of the result, so one task
    puts it together; its running lengths come from the same sort. No rows: none.
    """
    head = F.concat(F.lit(START), escape_role(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"))
    rows = turns.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)],
        F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"), head.alias("_head"))
    rows = rows.withColumn("_piece", F.concat("_head", escape(F.col("_text")), F.lit(END)))
    line = Window.partitionBy("_key").orderBy(*[F.col(f"_order{i}").asc_nulls_first() for i in range(len(order))], "_role", "_text")
    size = F.length("_piece").cast("bigint")
    begin = F.coalesce(F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    loss = F.col("_role") == "assistant"
    rows = rows.withColumn("_begin", begin).select(
        "_key", "_begin", "_piece", (F.col("_begin") + size).alias("_end"),
        F.when(loss, F.col("_begin") + F.length("_head")).alias("_loss_begin"),
        F.when(loss, F.col("_begin") + size - len(END)).alias("_loss_end"))
    all_turns = rows.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_begin", "_end", "_loss_begin", "_loss_end", "_piece"))).alias("_t"))
    return all_turns.select(
        F.col("_key").alias(key), F.array_join(F.transform("_t", lambda t: t["_piece"]), "").alias("formatted"),
        F.transform("_t", lambda t: F.struct(t["_begin"].alias("begin"), t["_end"].alias("end"),
                                             t["_loss_begin"].alias("loss_begin"), t["_loss_end"].alias("loss_end"))).alias("spans"))


def read_back(texts: DataFrame) -> DataFrame:
    """The rows of `texts` with `turns` (role and text as they were) and `loss_text`, both taken from the formatted text alone and its spans."""
    pieces = F.split("formatted", END.replace("|", r"\|"), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece):
        rest = F.substring(piece, len(START) + 1, 2_147_483_647)
        role = F.substring_index(rest, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(rest, F.length(role) + 2)).alias("text"))

    def loss(z):
        at, to = z["spans"]["loss_begin"] - z["spans"]["begin"], z["spans"]["loss_end"] - z["spans"]["begin"]
        return F.when(at.isNull(), F.lit("")).otherwise(unescape(F.substr(z["_pieces"], (at + 1).cast("int"), (to - at).cast("int"))))
    cut = texts.withColumn("_pieces", pieces)
    return cut.withColumns({
        "turns": F.transform("_pieces", turn),
        "loss_text": F.array_join(F.transform(F.arrays_zip("_pieces", "spans"), loss), "")}).drop("_pieces")
