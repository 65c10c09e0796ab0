"""The mining loop: find a frequent set, make it an abstract event, rewrite the log, repeat; and what that changes elsewhere."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from memlake.config import DEFAULT, MARK_FAILED, MARK_INCOHERENT, MARK_NOOP, MemoryConfig
from memlake.functions import vectors
from memlake.operators import graph, mining
from memlake.session import checkpointed
from memlake.sources import lake

Gate = Callable[[DataFrame], DataFrame]
IDS = "event_id string"


@dataclass
class Mined:
    abstract: DataFrame      # abstract_id, members, support, round
    fired: DataFrame         # fingerprint, abstract_event_id
    log: DataFrame           # the rewritten recall log
    rounds: int


@dataclass
class Effects:
    """What new abstract events change in the other tables."""
    event: DataFrame         # abstract_id, abstraction_level, n_sources, content_raw, ...
    edges: DataFrame         # parent, child: the given edges with the new ones
    coverage: DataFrame      # event_id, abstract_coverage
    shadow: DataFrame        # event_id, asf
    marked: DataFrame        # event_id of basic members, to be marked as abstracted


def all_coherent(subsets: DataFrame) -> DataFrame:
    """Default gate input: every member belongs to the narrative."""
    return subsets.withColumns({"coherent": F.col("subset"), "excluded": F.array().cast("array<string>")})


def thresholds(made: int, cfg: MemoryConfig) -> tuple[int, int]:
    """Least size and support of the next set; support rises after several abstracts and never falls, both are at least 2."""
    support = max(2, cfg.min_support)
    if made > cfg.escalate_after:
        support = max(support, cfg.escalated_support)
    return max(2, cfg.min_size), support


def ordered_candidates(recent: DataFrame, fired: DataFrame, as_of: Column, min_size: int, min_support: int, cfg: MemoryConfig) -> DataFrame:
    """Unfired closed sets of the recent transactions."""
    big = recent.filter(F.size("event_ids") >= min_size)
    return mining.fired_anti(mining.closed_itemsets(big, as_of, min_size, min_support, cfg.support_decay), fired)


def _leaves_of(members: DataFrame, leaves: DataFrame) -> DataFrame:
    """(subset_id, event_id): members that are abstract give their leaves, others stand for themselves."""
    below = leaves.select(F.col("root").alias("member"), F.col("event_id").alias("_leaf"))
    return members.join(below, "member", "left").select("subset_id", F.coalesce("_leaf", "member").alias("event_id")).distinct()


def mine_abstracts(log: DataFrame, fired: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT,
                   partition: Gate = all_coherent, known: DataFrame | None = None,
                   abstract_leaves: DataFrame | None = None, alive: DataFrame | None = None,
                   evidence: DataFrame | None = None, recent_k: int | None = None, dup_recent_k: int | None = None,
                   max_rounds: int | None = None) -> Mined:
    """Rounds of mining until one brings nothing new.

    A round looks at the newest `recent_k` transactions (under load, the smaller
    window that `monitor.load_limits` gives), which stay the same rows however often
    they are rewritten, so they are cut out once. Its first candidate that passes the
    checks becomes an abstract event; the driver sees that one candidate per round
    and nothing else. The whole log is rewritten at the end in one pass.

    `known` (event_id, create_time) are the abstract events so far and
    `abstract_leaves` (root, event_id) what they rest on, for the duplicate check;
    `alive` are the event ids that exist and are not tombstoned: a set counts with its
    living members only; `evidence` are the basic events with text. All of them grow
    with each new abstract, which can be a member, a duplicate or shadow of the next.
    """
    spark = log.sparkSession
    log = log.select("recall_id", "created_at", "event_ids")
    recent = checkpointed(lake.newest(log, recent_k or cfg.recent_k, ["created_at", "recall_id"]))
    fired = fired.select("fingerprint", "abstract_event_id")
    leaves = abstract_leaves if abstract_leaves is not None else spark.createDataFrame([], "root string, event_id string")
    made: list[tuple] = []
    rounds = 0
    for rounds in range(1, (max_rounds or cfg.max_rounds) + 1):
        size, support = thresholds(len(made), cfg)
        if recent.filter(F.size("event_ids") >= size).limit(support).count() < support:
            break
        cand = checkpointed(ordered_candidates(recent, fired, as_of, size, support, cfg))
        marks, pick = _first_good(cand, size, cfg, partition, leaves, known, alive, evidence, dup_recent_k)
        fired = fired.unionByName(marks)
        if pick is None:
            break
        members = sorted(pick.kept)
        abstract_id = "ABS-" + pick.fingerprint_md5
        made.append((abstract_id, members, float(pick.support), rounds))
        fired = checkpointed(fired.unionByName(spark.createDataFrame(
            [(pick.fingerprint, abstract_id)], "fingerprint string, abstract_event_id string")))
        recent = checkpointed(mining.replace_subsets(recent, [(abstract_id, members)]))
        fresh = spark.createDataFrame([(abstract_id,)], IDS)
        if alive is not None:
            alive = alive.select("event_id").unionByName(fresh)
        if known is not None or evidence is not None:
            rest = _leaves_of(spark.createDataFrame([(abstract_id, m) for m in members], "subset_id string, member string"), leaves)
            leaves = checkpointed(leaves.select("root", "event_id").unionByName(rest.withColumnRenamed("subset_id", "root")))
        if known is not None:
            known = known.select("event_id", "create_time").unionByName(
                fresh.select("event_id", (as_of + F.make_dt_interval(secs=F.lit(rounds) / 1000)).alias("create_time").cast(known.schema["create_time"].dataType)))
    abstract = spark.createDataFrame(made, "abstract_id string, members array<string>, support double, round int")
    return Mined(abstract, fired, mining.replace_subsets(log, [(m[0], m[1]) for m in made]), rounds)


def _living(cand: DataFrame, alive: DataFrame) -> DataFrame:
    """Candidates reduced to their living members."""
    found = cand.select("fingerprint", F.explode("subset").alias("event_id")).join(
        alive.select("event_id"), "event_id", "left_semi").groupBy("fingerprint").agg(F.collect_set("event_id").alias("_in"))
    none = F.array().cast("array<string>")
    return cand.join(found, "fingerprint", "left").withColumn(
        "subset", F.array_sort(F.coalesce("_in", none))).drop("_in")


def _first_good(cand: DataFrame, min_size: int, cfg: MemoryConfig, partition: Gate, leaves, known, alive, evidence, dup_recent_k):
    """The first acceptable candidate as a row, and marks for the ones passed over before it."""
    ranked = cand.withColumns({"_n": F.size("subset"), "_s": F.round("support", 9)})
    staged = ranked if alive is None else _living(ranked, alive)
    gated = mining.coherence_gate(partition(staged), cfg).withColumns({"dup_of": F.lit(None).cast("string"), "rests": F.lit(True)})
    if known is not None:
        below = _leaves_of(cand.select(F.col("fingerprint").alias("subset_id"), F.explode("subset").alias("member")), leaves)
        dup = graph.narrative_dedupe(below, leaves, known, cfg, dup_recent_k).select(
            F.col("subset_id").alias("fingerprint"), F.col("matched_id").alias("_dup"))
        gated = gated.join(dup, "fingerprint", "left").withColumn("dup_of", F.col("_dup")).drop("_dup")
    if evidence is not None:
        texts = _leaves_of(gated.select(F.col("fingerprint").alias("subset_id"), F.explode("kept").alias("member")), leaves).join(
            evidence.select("event_id"), "event_id", "left_semi").select(F.col("subset_id").alias("fingerprint"), F.lit(True).alias("_on")).distinct()
        gated = gated.join(texts, "fingerprint", "left").withColumn("rests", F.col("_on").isNotNull()).drop("_on")
    enough = F.size("subset") >= min_size
    good = F.col("dup_of").isNull() & enough & F.col("passed") & F.col("rests")
    best = gated.filter(good).orderBy(F.col("_n").desc(), F.col("_s").desc(), "fingerprint").limit(1).select(
        "fingerprint", F.md5("fingerprint").alias("fingerprint_md5"), "kept", "support", "_n", "_s").collect()
    bad = gated.filter(~good)
    if best:
        b, n, s = best[0], F.col("_n"), F.col("_s")
        bad = bad.filter((n > b._n) | ((n == b._n) & ((s > b._s) | ((s == b._s) & (F.col("fingerprint") < b.fingerprint)))))
    # partitions that name strangers or leave members out are failed answers, not incoherent ones
    reason = F.coalesce("dup_of", F.when(~enough, MARK_NOOP).when(~F.col("is_valid"), MARK_FAILED).when(~F.col("passed"), MARK_INCOHERENT).otherwise(MARK_NOOP))
    return bad.select("fingerprint", reason.alias("abstract_event_id")), (best[0] if best else None)


def effects(mined: Mined, nodes: DataFrame, edges: DataFrame, coverage: DataFrame, shadow: DataFrame, vector: DataFrame,
            as_of: Column, dim: int, cfg: MemoryConfig = DEFAULT) -> Effects:
    """The new abstract events as rows, and coverage, shadowing and marks after all of them.

    `nodes` has event_id, is_abstract, level, create_time, content_raw, is_tombstoned
    and ptsd_immune; `vector` event_id and act of `dim` values. Levels rise one above
    the highest member; members that are new abstracts themselves come first, so
    their levels are found round by round from the few rows of `mined.abstract`.
    """
    spark = nodes.sparkSession
    made = sorted(mined.abstract.collect(), key=lambda r: r["round"])
    members = mined.abstract.select(F.col("abstract_id").alias("subset_id"), F.explode("members").alias("member"))
    known = {r.member: r.level for r in members.select("member").distinct().join(
        nodes.select(F.col("event_id").alias("member"), "level"), "member").collect()}
    for r in made:
        known[r.abstract_id] = 1 + max((known.get(m, 0) or 0 for m in r.members), default=0)
    grown = spark.createDataFrame([(r.abstract_id, known[r.abstract_id]) for r in made], "event_id string, level int").select(
        "event_id", F.lit(True).alias("is_abstract"), "level", as_of.alias("create_time"), F.lit("").alias("content_raw"),
        F.lit(False).alias("is_tombstoned"), F.lit(False).alias("ptsd_immune"))
    columns = grown.columns
    shell = nodes.select(*columns).unionByName(grown)
    all_edges = edges.select("parent", "child").unionByName(members.select(F.col("subset_id").alias("parent"), F.col("member").alias("child")))
    evidence = checkpointed(graph.evidence_collect(shell, all_edges, members))
    built = graph.abstract_build(members, shell, evidence).withColumnRenamed("subset_id", "abstract_id")
    covered = graph.coverage_increment(shell, all_edges, members, coverage.select("event_id", "abstract_coverage").unionByName(
        grown.select("event_id", F.lit(0.0).alias("abstract_coverage"))), cfg)
    texts = built.select(F.col("abstract_id").alias("event_id"), F.coalesce("content_raw", F.lit("")).alias("text"))
    full = nodes.select(*columns).unionByName(grown.drop("content_raw").join(
        texts.withColumnRenamed("text", "content_raw"), "event_id").select(*columns))
    acts = vector.select("event_id", F.col("act").cast("array<double>").alias("act")).unionByName(
        texts.select("event_id", vectors.hash_embed(F.col("text"), dim).alias("act")))
    leaves = evidence.select(F.col("subset_id").alias("root"), "event_id").distinct()
    shaded = graph.asf_propagate(full, leaves, acts, shadow, cfg)
    marked = members.join(nodes.filter("not is_abstract").select(F.col("event_id").alias("member")), "member", "left_semi").select(
        F.col("member").alias("event_id")).distinct()
    return Effects(built, all_edges, covered, shaded, marked)
