"""Role registry: resolution, focus, pools, reports."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from memlake.functions import ids, text as tx
from memlake.operators.ordered import BLOCK_CHARS, text_blocks
from memlake.session import checkpointed, short_batches

BLOCK_NAMES = 100_000
PART_ROWS = 20_000
SLICE_ROWS = 256
OUT_ROWS = 8192


def name_index(role: DataFrame) -> DataFrame:
    """Each name (priority 0) and alias (priority 1) with its role."""
    own = role.select(F.col("name").alias("key"), F.lit(0).alias("priority"), "role_id")
    alias = role.select(F.explode("aliases").alias("key"), F.lit(1).alias("priority"), "role_id")
    return own.unionByName(alias).groupBy("key").agg(F.min(F.struct("priority", "role_id")).alias("m")).select(
        "key", F.col("m.role_id").alias("role_id"))


def role_resolve(extracted: DataFrame, role: DataFrame) -> DataFrame:
    """Registry id of each extracted (`given_id`, `name`): id, then name, then alias, else a new id.

    New ids are a hash of the name, so the same name gives one role in any order.
    """
    by_id = role.select(F.col("role_id").alias("given_id"), F.col("role_id").alias("_by_id"))
    by_name = name_index(role).select(F.col("key").alias("name"), F.col("role_id").alias("_by_name"))
    staged = extracted.join(by_id, "given_id", "left").join(by_name, "name", "left")
    fresh = ids.content_id("ROL-", F.col("name"))
    known = F.coalesce("_by_id", "_by_name")
    return staged.withColumns({
        "role_id": F.coalesce(known, fresh), "is_new": known.isNull(),
        "clean_name": F.when(known.isNull(), tx.clean_name(F.col("name"), fresh)).otherwise(F.col("name")),
        "is_suspicious": known.isNull() & tx.bad_name(F.col("name")),
    }).drop("_by_id", "_by_name")


def role_pool_backfill(names: DataFrame, role: DataFrame, pool: DataFrame) -> DataFrame:
    """Names of an event turned into role entries, each role once, in order.

    The pool holds the rich entries of the same input; a role without one gets
    an empty entry, an unknown name stands for itself.
    """
    keyed = names.withColumn("name", tx.strip(F.col("name"))).filter(F.col("name") != "")
    lookup = name_index(role).select(F.col("key").alias("name"), "role_id")
    resolved = keyed.join(lookup, "name", "left").withColumn("role_id", F.coalesce("role_id", "name"))
    once = resolved.groupBy("event_id", "role_id").agg(F.min(F.struct("pos", "name")).alias("m")).select(
        "event_id", "role_id", F.col("m.pos").alias("pos"), F.col("m.name").alias("name"))
    return once.join(pool, ["event_id", "role_id"], "left").withColumn(
        "importance", F.coalesce("importance", F.lit("C"))).withColumn("from_pool", F.col("arousal").isNotNull())


def focus_roles(texts: DataFrame, role: DataFrame, core_role: str | None = None,
                block_names: int = BLOCK_NAMES, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, role_id), each once, where a role name or alias occurs in a text of the query, ignoring case.

    Distinct names go to the tasks in blocks of about `block_names`, dealt by hash:
    one automaton for each finds all of its names in a single pass over the texts.
    The roles of the found names join afterwards. A name of very many roles, or in very many
    queries, is cut into parts of `part_rows` on either side, which meet part by part. Null
    texts hold no name; null and empty names occur nowhere.
    """
    names = role.select("role_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select(
        "role_id", F.lower("name").alias("name")).filter(F.length("name") > 0).distinct()
    owned = checkpointed(names.groupBy("name").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("role_parts")))
    texts = texts.select("query_id", F.lower("text").alias("text"))
    held = texts.filter(F.length("text") > 0)
    passes = max(1, -(-owned.count() // block_names))
    hits = None
    for i in range(passes):
        part = owned if passes == 1 else owned.filter(F.pmod(F.xxhash64("name"), F.lit(passes)) == i)
        some = _by_automaton(held, [r.name for r in part.select("name").toLocalIterator()])
        hits = some if hits is None else hits.unionByName(some)
    found = _owners(checkpointed(hits.distinct()), names, owned, part_rows)
    if core_role:
        found = found.unionByName(texts.select("query_id", F.lit(core_role).alias("role_id")))
    return found.distinct()


def _owners(hits: DataFrame, names: DataFrame, owned: DataFrame, part_rows: int) -> DataFrame:
    """The roles of found names; both sides of a hot name are cut, and each part meets every part of the other side."""
    asked = hits.groupBy("name").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("query_parts"))
    size = checkpointed(asked.join(owned, "name"))
    own = lambda c, parts: F.pmod(F.xxhash64(c), F.col(parts).cast("long")).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = hits.join(size, "name").withColumn("a", own("query_id", "query_parts")).select("query_id", "name", "a", every("role_parts").alias("b"))
    right = names.join(size, "name").withColumn("b", own("role_id", "role_parts")).select("role_id", "name", "b", every("query_parts").alias("a"))
    return left.join(right, ["name", "a", "b"]).select("query_id", "role_id")


def _by_automaton(texts: DataFrame, names: list[str]) -> DataFrame:
    """(query_id, name) for every name that a text holds, once a text.

    Texts are looked at and found names given back a slice at a time, so neither long
    texts nor texts of many names fill a task; names are kept once, as an Arrow array.
    """
    spark = texts.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(pa.array(names, pa.string()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        known = shared.value
        words = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at in range(len(known)):
            words.add_word(known[at].as_py(), at)
        words.make_automaton()
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                rows, found = array("i"), array("i")
                for row, text in enumerate(part.column("text")):
                    held = {at for _, at in words.iter(text.as_py())} if len(words) else ()
                    found.extend(held)
                    rows.extend([row] * len(held))
                    if len(found) >= OUT_ROWS:
                        yield _named(part, rows, known, found)
                        rows, found = array("i"), array("i")
                if found:
                    yield _named(part, rows, known, found)

    return texts.select(F.col("query_id").cast("string").alias("query_id"), "text").mapInArrow(scan, "query_id string, name string")


def _named(part: pa.RecordBatch, rows: array, names: pa.Array, found: array) -> pa.RecordBatch:
    at = lambda places: pa.array(np.frombuffer(places, np.int32))
    return pa.RecordBatch.from_arrays([part.column("query_id").take(at(rows)).cast(pa.string()), names.take(at(found))], names=["query_id", "name"])


def entity_hint(focus: DataFrame, role: DataFrame) -> DataFrame:
    """Names and aliases of the focus roles of a query as one string, each once, in role order."""
    words = focus.join(role, "role_id").select(
        "query_id", "role_id", F.posexplode(F.concat(F.array("name"), F.col("aliases"))).alias("i", "word"))
    first = words.filter("word <> ''").groupBy("query_id", "word").agg(F.min(F.struct("role_id", "i")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "word")))
    return first.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["word"]), " ").alias("hint"))


def role_words(event_role: DataFrame, role: DataFrame) -> DataFrame:
    """Entity text of each role entry: id, name, aliases."""
    return event_role.select("event_id", "pos", "role_id").join(
        role.select("role_id", F.array_join(F.concat(F.array("name"), F.col("aliases")), " ").alias("n")), "role_id", "left"
    ).withColumn("words", F.concat_ws(" ", "role_id", "n"))


def _entity_words(event_role: DataFrame, role: DataFrame, leaves: DataFrame | None) -> DataFrame:
    """Role words of each event in the order (`via`, `pos`); abstract events have those of their leaves."""
    words = role_words(event_role, role)
    own = words.select("event_id", F.lit("").alias("via"), "pos", "words")
    if leaves is None:
        return own
    return own.unionByName(leaves.join(words, "event_id").select(
        F.col("root").alias("event_id"), F.col("event_id").alias("via"), "pos", "words"))


def entity_text(event: DataFrame, event_role: DataFrame, role: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Entity-band text of events; abstract events use the roles of their leaves, others fall back to their id.

    One value an event, whatever its leaves; `entity_blocks` gives rows of bounded size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("via", "pos", "words")))
    text = _entity_words(event_role, role, leaves).groupBy("event_id").agg(F.array_join(F.transform(ordered, lambda s: s["words"]), " ").alias("t"))
    return event.select("event_id").join(text, "event_id", "left").select(
        "event_id", F.coalesce(F.nullif("t", F.lit("")), F.col("event_id")).alias("entity_text"))


def entity_blocks(event: DataFrame, event_role: DataFrame, role: DataFrame, leaves: DataFrame | None = None,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`entity_text` in rows of bounded size (`event_id`, `block_no`, `entity_text`), cut between roles.

    Blocks joined by a blank in their order give the whole text. An event of
    very many leaves is sorted and joined by many tasks.
    """
    words = _entity_words(event_role, role, leaves)
    order = [F.col("via"), F.col("pos"), F.col("words")]
    blocks = text_blocks(words, ["event_id"], order, "words", block_chars).filter("text <> ''")
    return event.select("event_id").join(blocks, "event_id", "left").select(
        "event_id", F.coalesce("block_no", F.lit(0)).alias("block_no"), F.coalesce("text", "event_id").alias("entity_text"))


def query_valence(queries: DataFrame, focus: DataFrame, event_role: DataFrame) -> DataFrame:
    """Mean valence of the focus entries of a query, 0 without any."""
    per_role = event_role.groupBy("role_id").agg(F.sum("valence").alias("s"), F.count("valence").alias("n"))
    mean = focus.join(per_role, "role_id").groupBy("query_id").agg((F.sum("s") / F.sum("n")).alias("valence"))
    return queries.select("query_id").join(mean, "query_id", "left").na.fill(0.0, ["valence"])
