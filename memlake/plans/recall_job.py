"""Recall from question to block: routes, search, bypass, scores, cuts, compression, prefixes, and what recall changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.config import DEFAULT, EMOTION_TERMS, ENTITY_TERMS, FACT_TERMS, MemoryConfig
from memlake.functions import scoring, text as tx, vectors
from memlake.operators import graph, recall, roles, search
from memlake.operators.cells import CellIndex
from memlake.operators.ordered import first_per_key
from memlake.plans import recall_block as rb
from memlake.session import written
from memlake.sources import lake

BANDS = ("act", "emo", "ent")
BYPASS_ROUTE = 9
_MARK = "\u001f"
_PLACED = ("query_id", "event_id", "out_position", "is_anchor", "score")
#: Where the text of a row of a block is: the place of its first level (0 for the raw text), how many levels below, and the text's key.
_TEXT_AT = ("at", "depth", "stub", *recall.TEXT_KEY)


@dataclass(frozen=True)
class Memory:
    """Tables of the memory; each may be arbitrarily large."""

    event: DataFrame                     # event rows with coverage, flags, and summaries and text or, with `texts`, their lengths
    event_role: DataFrame
    timeline: DataFrame
    vector: DataFrame                    # event_id, act, emo, ent
    pool: DataFrame | None = None        # event_id of the active pool; None restricts nothing
    prefixes: DataFrame | None = None    # event_id, prefix_id, pos: split tails and what came before
    leaves: DataFrame | None = None      # root, event_id: what abstract events rest on
    index: CellIndex | None = None       # a cell index of `vector`; searches then open only the cells they need
    texts: DataFrame | None = None       # the texts of events that have only lengths (`recall.without_texts`)

    def vectors_of(self, ids: DataFrame) -> DataFrame | CellIndex:
        return self.vector.join(ids, "event_id", "left_semi") if self.index is None else self.index.restricted(ids)


@dataclass(frozen=True)
class Recalled:
    hits: DataFrame        # query_id, event_id, distance, route
    granted: DataFrame     # queries that got a second, unrestricted search
    block: DataFrame       # query_id, event_id, out_position, is_anchor, score, text
    log: DataFrame         # query_id, event_ids
    timeline: DataFrame    # timeline after reinforcement
    silent: DataFrame      # events that fall silent


def prepare(questions: DataFrame, role: DataFrame, event_role: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Focus roles, and the questions (`query_id`, `text`, `shadow`) with entity hint, mean valence and band weights."""
    focus = roles.focus_roles(questions, role)
    full = F.concat_ws("\n", F.nullif("shadow", F.lit("")), "text")
    blend = scoring.intent_blend(*[tx.term_hits(full, terms) for terms in (ENTITY_TERMS, EMOTION_TERMS, FACT_TERMS)])
    asked = (questions.join(roles.entity_hint(focus, role), "query_id", "left")
             .join(roles.query_valence(questions, focus, event_role).withColumnRenamed("valence", "query_valence"), "query_id", "left")
             .na.fill({"hint": "", "query_valence": 0.0, "shadow": ""}))
    return focus, asked.withColumns({n: c for n, c in blend.items()})


def encode_routes(asked: DataFrame, dim: int, arousal: float = 0.3, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """(query_id, route, act, emo, ent): each route's texts as vectors; the entity band takes the hint where the route has one."""
    valence = asked.select("query_id", "query_valence")
    return search.route_texts(asked.select("query_id", "text", "shadow", "hint"), cfg).join(valence, "query_id").select(
        "query_id", "route", vectors.hash_embed(F.col("search_text"), dim).alias("act"),
        vectors.emo_query(F.col("query_valence"), F.lit(arousal), dim).alias("emo"), vectors.hash_embed(F.col("entity_text"), dim).alias("ent"))


def search_routes(encoded: DataFrame, events: DataFrame | CellIndex, weights: DataFrame, n: int, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """(query_id, route, event_id, score, distance): rank fusion of the bands for every route, all in one scan of the events.

    `weights` has a row per query with w_act, w_emo and w_ent; a band takes part where its weight is above zero.
    """
    on = lambda b: F.when(F.col(f"w_{b}") > 0, F.col(b)).alias(b)
    keyed = encoded.join(weights, "query_id").select(F.concat_ws(_MARK, "query_id", "route").alias("query_id"), *[on(b) for b in BANDS])
    part = F.split("query_id", _MARK)
    return search.fused_topk(keyed, events, n, BANDS, cfg).select(
        F.get(part, F.lit(0)).alias("query_id"), F.get(part, F.lit(1)).cast("int").alias("route"), "event_id", "score",
        F.greatest(F.lit(0.0), 1 - F.col("score")).alias("distance"))


def find(asked: DataFrame, encoded: DataFrame, memory: Memory, cfg: MemoryConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Union of all routes over the active pool and, for queries whose best score is low and whose minute has a grant left, of a search over all visible events."""
    seen = lake.visible_events(memory.event).select("event_id")
    active = seen if memory.pool is None else search.active_pool_semi(seen, memory.pool)
    weights = asked.select("query_id", *[f"w_{b}" for b in BANDS])
    hits = written(search_routes(encoded, memory.vectors_of(active), weights, cfg.n_results, cfg), "hits")
    top = hits.groupBy("query_id").agg(F.max("score").alias("best_score"))
    granted = search.bypass_grants(asked.select("query_id", "asked_at").join(top, "query_id", "left").na.fill(0.0, ["best_score"]), cfg)
    granted = written(granted, "granted")
    if granted.isEmpty():
        return search.union_hits(hits), granted
    widest = first_per_key(encoded.filter("route < 2").join(granted.select("query_id"), "query_id", "left_semi"), ["query_id"], [F.col("route").desc()], 1).drop("rn")
    second = search_routes(widest.withColumn("route", F.lit(BYPASS_ROUTE)), memory.vectors_of(seen), weights, cfg.n_results, cfg)
    return search.union_hits(hits.unionByName(second)), granted


def compressed(scored: DataFrame, event: DataFrame, event_role: DataFrame, focus: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """(query_id, event_id, position, score, chars, and where the text is): the first cut at 1.2 redlines, then the block under the redline.

    All by the lengths of the texts; `event` has these in the place of texts (`recall.without_texts`).
    """
    first = rb.tiered_rows(scored, event, event_role, focus, cfg)
    first = recall.budget_prefix(first, int(cfg.redline * cfg.intermediate_factor))
    level = F.when(F.col("at") > 0, F.slice("names", F.col("at"), F.size("names"))).otherwise(F.array("level"))
    sizes = F.when(F.col("at") > 0, F.slice("sizes", F.col("at"), F.size("sizes"))).otherwise(F.array("text_len"))
    # an event that comes several times in a block has each of its scores with each of its rows
    scores = F.collect_list(F.struct("score")).over(Window.partitionBy("query_id", "event_id"))
    block = first.select("query_id", "event_id", "position", level.alias("levels"), sizes.alias("sizes"), "at", scores.alias("scores"), *recall.TEXT_KEY)
    kept = recall.block_plan(block, cfg.redline, cfg).filter("kept")
    size = F.get("sizes", F.col("depth"))
    kept = kept.withColumn("chars", F.when(F.col("stub"), recall.stub_chars(size, cfg)).otherwise(size)).withColumn(
        "position", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    return kept.select("query_id", "event_id", "position", F.explode("scores").alias("s"), "chars", *_TEXT_AT).select(
        "query_id", "event_id", "position", "s.score", "chars", *_TEXT_AT)


def placed_texts(rows: DataFrame, texts: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Finished rows with their texts: a level or the raw text, or the stub of one."""
    found = recall.with_texts(rows, texts)
    body = F.when(F.col("at") > 0, F.get("bodies", F.col("at") - 1 + F.col("depth"))).otherwise(F.col("content_raw"))
    text = F.when(F.col("stub"), recall.stub_text(body, cfg)).otherwise(body)
    return found.withColumn("text", text).withColumn("text", F.when(F.col("cut"), recall.stub_text(F.col("text"), cfg)).otherwise(F.col("text"))).select(
        *_PLACED, "text")


def recall_job(asked: DataFrame, encoded: DataFrame, focus: DataFrame, memory: Memory, as_of: Column, cfg: MemoryConfig = DEFAULT) -> Recalled:
    """The whole of recall for many questions at once.

    Hits, scores and blocks (some 60 rows a query) are written once, since later steps use them several times;
    texts are in none of them, they join the finished rows.

    `asked` has query_id, asked_at, query_valence and band weights; `encoded`
    their routes as vectors. A block is never above the redline before prefixes
    are put in front of its rows, and these are cut to stubs before it grows beyond.
    """
    hits, granted = find(asked, written(encoded, "encoded"), memory, cfg)
    hits = written(hits, "union")
    valued = hits.join(asked.select("query_id", "query_valence"), "query_id")
    event, texts = (memory.event, memory.texts) if memory.texts is not None else recall.without_texts(memory.event)
    src = rb.RecallInput(valued, event, memory.event_role, memory.timeline, focus, memory.leaves, texts)
    scored = rb.score_candidates(src, as_of, cfg).select("query_id", "event_id", "score")
    block = written(compressed(written(scored, "scored"), event, memory.event_role, focus, cfg), "block")
    if memory.prefixes is None:
        rows = block.withColumnRenamed("position", "out_position").withColumns({"is_anchor": F.lit(True), "cut": F.lit(False)})
    else:
        chain = graph.prefix_chain(memory.prefixes, lake.visible_events(event), block.select("event_id").distinct(), cfg)
        shortest = F.get("sizes", F.size("sizes") - 1)
        lengths = event.select(F.col("event_id").alias("prefix_id"), F.coalesce(shortest, "raw_size").alias("chars"),
                               F.when(shortest.isNotNull(), F.size("sizes")).otherwise(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("stub"), *recall.TEXT_KEY)
        chain = chain.drop("depth").join(lengths, "prefix_id")
        plan = recall.prefix_plan(block, chain, cfg.redline, cfg)
        mine = plan.filter("is_anchor").join(block.select("query_id", "event_id", *_TEXT_AT), ["query_id", "event_id"])
        lent = plan.filter(~F.col("is_anchor")).join(chain.select("root", F.col("prefix_id").alias("event_id"), *_TEXT_AT), ["root", "event_id"])
        rows = mine.select(*_PLACED, "cut", *_TEXT_AT).unionByName(lent.select(*_PLACED, "cut", *_TEXT_AT))
    log = lake.recall_log_rows(rows.withColumnRenamed("out_position", "position"))
    return Recalled(hits, granted, placed_texts(rows, texts, cfg), log, rb.reinforced_timeline(rows, memory.timeline, as_of, cfg), rb.newly_silent(src, as_of, cfg))
