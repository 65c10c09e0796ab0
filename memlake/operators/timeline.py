"""Role timelines: building, forgetting, digest, rolling affect, event weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.config import DEFAULT, EMOTIONS, MemoryConfig
from memlake.functions import affect, libm, scoring
from memlake.functions.vectors import let
from memlake.operators.ordered import ROWS_PER_SLOT, SLOT, first_per_key, global_position, running_total, with_preceding
from memlake.operators.scans import affine


def primary_role(core_role: str | None = None) -> Column:
    """S and A roles, and the core user in single mode."""
    out = F.col("importance").isin("S", "A")
    return out | (F.col("role_id") == core_role) if core_role else out


def snapshot_pick(primary: Column, primary_first: str = "l3_decision",
                  default_first: str = "l2_interaction") -> Column:
    """First non-empty snapshot on the route of the role."""
    def route(*fields: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in dict.fromkeys(fields)], F.lit(""))
    return F.when(primary, route(primary_first, "l3_decision", "l2_interaction", "l1_mention")).otherwise(
        route(default_first, "l2_interaction", "l1_mention", "l3_decision"))


def timeline_update(event_role: DataFrame, cfg: MemoryConfig = DEFAULT, core_role: str | None = None) -> DataFrame:
    """One timeline row per role of each basic event; abstract events give none."""
    src = event_role.filter(~F.col("is_abstract")) if "is_abstract" in event_role.columns else event_role
    weight = affect.unit(F.col("arousal"))
    keep = [c for c in ("n",) if c in src.columns]
    return src.select(
        "role_id", "event_id", *keep, "create_time", "importance", "arousal", "valence",
        snapshot_pick(primary_role(core_role)).alias("role_summary"),
        weight.alias("memory_weight"),
        affect.base_forgetting(weight, cfg).alias("forgetting_factor"),
        affect.base_forgetting(weight, cfg).alias("base_forgetting_factor"))


def timeline_filter(timeline: DataFrame, min_weight: float | None, limit: int) -> DataFrame:
    """Oldest `limit` entries per role, optionally above a memory weight."""
    src = timeline if min_weight is None else timeline.filter(F.col("memory_weight") >= min_weight)
    return first_per_key(src, ["role_id"], [F.col("create_time"), F.col("event_id")], limit)


def history_limit(timeline: DataFrame, n: int, history: str = "oldest") -> DataFrame:
    order = [F.col("create_time"), F.col("event_id")]
    if history == "latest":
        order = [c.desc() for c in order]
    return first_per_key(timeline, ["role_id"], order, n)


def forgetting_scores(timeline: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT,
                      zero_factor: str = "as_one") -> DataFrame:
    """Both readings of the retention score; the penalised one depends on age and weight."""
    eff = scoring.effective_forgetting(F.col("forgetting_factor"), F.col("last_accessed_time"), as_of, cfg, zero_factor)
    kept = scoring.retention(F.col("create_time"), as_of, cfg)
    return timeline.withColumn("effective", eff).withColumn("retention", kept).withColumns({
        "is_silenced": F.col("effective") < cfg.silence_threshold,
        "score_plain": F.lit(1.0),
        "score_penalised": scoring.penalised_score(F.col("memory_weight"), F.col("retention")) * F.col("effective"),
    })


def fifo_penalty(timeline: DataFrame, capacity: int) -> DataFrame:
    """Flag the oldest entries of each role until the rest fits the capacity."""
    length = F.length("role_summary").cast("long")
    newest_first = [F.col("create_time").desc(), F.col("event_id").desc()]
    out = running_total(timeline, ["role_id"], newest_first, length, "chars_to_newest")
    return out.withColumn("is_penalised", F.col("chars_to_newest") > capacity)


def timeline_top(timeline: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT,
                 capacity: int | None = None) -> DataFrame:
    """The best-scored entries of each role, at most `timeline_top` of them."""
    flagged = fifo_penalty(timeline, cfg.role_capacity if capacity is None else capacity)
    score = F.when(F.col("is_penalised"), scoring.penalised_score(
        F.col("memory_weight"), scoring.retention(F.col("create_time"), as_of, cfg))).otherwise(F.lit(1.0))
    return first_per_key(flagged.withColumn("score", score), ["role_id"],
                         [F.col("score").desc(), F.col("create_time"), F.col("event_id")], cfg.timeline_top)


def timeline_digest(timeline: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT,
                    capacity: int | None = None) -> DataFrame:
    """Top entries of each role as `[time] (importance) text` lines in time order."""
    line = F.concat(F.lit("["), F.date_format("create_time", "yyyy-MM-dd HH:mm"), F.lit("] ("),
                    F.col("importance"), F.lit(") "), F.col("role_summary"))
    return (
        timeline_top(timeline, as_of, cfg, capacity)
        .groupBy("role_id").agg(F.array_sort(F.collect_list(F.struct("create_time", "event_id", line.alias("line")))).alias("l"))
        .select("role_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("digest")))


def role_text_volume(timeline: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    return timeline.groupBy("role_id").agg(F.sum(F.length("role_summary")).alias("chars")).withColumn(
        "over_capacity", F.col("chars") > cfg.role_capacity)


def rolling_affect(timeline: DataFrame, cfg: MemoryConfig = DEFAULT, history: str = "oldest") -> DataFrame:
    """Decayed rolling valence, arousal and energy of each timeline row.

    `history='oldest'` weighs the role's first rows before the entry, `latest`
    the rows directly before it; both look at `affect_history` rows at most.
    """
    n, lam = cfg.affect_history, cfg.affect_decay_per_hour
    base = timeline.select("role_id", "event_id", "create_time", "arousal", "valence")
    past = F.struct("create_time", "event_id", "arousal", "valence")
    if history == "oldest":
        # at most n rows per role; the detail side is the large one and may be split on skew
        firsts = (history_limit(base, n).groupBy("role_id")
                  .agg(F.array_sort(F.collect_list(past)).alias("_h")))
        staged = base.join(firsts, "role_id").withColumn("_h", F.filter(
            "_h", lambda h: (h["create_time"] < F.col("create_time")) |
            ((h["create_time"] == F.col("create_time")) & (h["event_id"] < F.col("event_id")))))
    else:
        prior = Window.partitionBy("role_id", SLOT).orderBy("create_time", "event_id").rowsBetween(-n, -1)
        staged = (with_preceding(base, ["role_id"], ["create_time", "event_id"], n)
                  .withColumn("_h", F.collect_list(past).over(prior)).filter(~F.col("_carried")))
    def add(acc: Column, h: Column) -> Column:
        w = F.exp(F.lit(-lam) * scoring.age_hours(h["create_time"], F.col("create_time")))
        return let(w, lambda x: F.struct((acc["w"] + x).alias("w"), (acc["v"] + h["valence"] * x).alias("v"),
                                         (acc["a"] + h["arousal"] * x).alias("a")))

    start = F.struct(F.lit(1.0).alias("w"), F.col("valence").alias("v"), F.col("arousal").alias("a"))
    return staged.withColumn("_s", F.aggregate("_h", start, add)).select(
        "role_id", "event_id", (F.col("_s.v") / F.col("_s.w")).alias("rolling_valence"),
        (F.col("_s.a") / F.col("_s.w")).alias("rolling_arousal"), F.col("_s.a").alias("energy"))


def event_affect(event: DataFrame, event_role: DataFrame) -> DataFrame:
    """Affective energy and mean valence per event; 0 without roles."""
    per = event_role.groupBy("event_id").agg(
        F.least(F.max("arousal"), F.lit(1.0)).alias("affective_energy"), F.avg("valence").alias("event_valence"))
    return event.select("event_id").join(per, "event_id", "left").na.fill(0.0)


def accumulated_energy(timeline: DataFrame, cfg: MemoryConfig = DEFAULT, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """(role_id, event_id, create_time, energy, triggers): decayed sum of arousal over the whole history of each role.

    An entry triggers when it lifts the energy over the limit, that is when what
    was left of the earlier ones did not reach it. A null arousal adds nothing.
    """
    order = ["create_time", "event_id"]
    src = timeline.select("role_id", *order, F.coalesce("arousal", F.lit(0.0)).alias("arousal"))
    before = Window.partitionBy("role_id", SLOT).orderBy(*order)
    gap = F.coalesce(scoring.age_hours(F.lag("create_time").over(before), F.col("create_time")), F.lit(0.0))
    timed = with_preceding(src, ["role_id"], order, 1, rows_per_slot).withColumn("_gap", gap).filter(~F.col("_carried")).drop("_carried", SLOT)
    decay = F.exp(F.lit(-cfg.affect_decay_per_hour) * F.col("_gap"))
    out = affine(timed, ["role_id"], order, decay, F.col("arousal"), "energy", rows_per_slot=rows_per_slot)
    return out.select("role_id", *reversed(order), "energy", (
        (F.col("energy") > cfg.energy_trigger) & (F.col("energy") - F.col("arousal") <= cfg.energy_trigger)).alias("triggers"))


def capacity_silence(timeline: DataFrame, as_of: Column, load: Column, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Entries by rank of their effective weight over the whole store; those behind the surviving share are silent.

    The share falls from `surviving_share` without load to `surviving_share_loaded`
    at the highest load. Ties end with role and event.
    """
    strained = F.least(F.greatest((load - 1) / (cfg.load_max - 1), F.lit(0.0)), F.lit(1.0))
    share = F.lit(cfg.surviving_share) - F.lit(cfg.surviving_share - cfg.surviving_share_loaded) * strained
    eff = scoring.effective_forgetting(F.col("forgetting_factor"), F.col("last_accessed_time"), as_of, cfg, exp=libm.exp)
    rows = timeline.select("role_id", "event_id", libm.rounded(eff, 9).alias("effective"))
    placed = global_position(rows, [F.col("effective").desc(), F.col("role_id"), F.col("event_id")], "place")
    return placed.withColumn("is_silent", F.col("place") > F.floor(F.lit(timeline.count()) * share))


def activation_energy(role_energy: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    return role_energy.groupBy("event_id").agg(
        F.least(F.max("energy") * cfg.energy_gain, F.lit(1.0)).alias("activation_energy"))


def emo_features(event_role: DataFrame) -> DataFrame:
    """The eleven affect scalars of each event."""
    return event_role.groupBy("event_id").agg(
        F.avg("valence").alias("valence"), F.max("arousal").alias("arousal"), F.sum("energy").alias("energy"),
        *[F.max(e).alias(e) for e in EMOTIONS])


def immune_flag(event_role: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    return event_role.groupBy("event_id").agg((F.max("arousal") > cfg.immune_arousal).alias("ptsd_immune"))


def role_timeline_join(event_role: DataFrame, timeline: DataFrame) -> DataFrame:
    """Roles of events with their timeline entry; no entry means forgotten."""
    entry = timeline.select("role_id", "event_id", "forgetting_factor", "memory_weight", "last_accessed_time")
    return event_role.join(entry, ["role_id", "event_id"], "left").withColumn(
        "is_forgotten", F.col("forgetting_factor").isNull())


def _effective(joined: DataFrame, as_of: Column, cfg: MemoryConfig, zero_factor: str) -> Column:
    return F.when(~F.col("is_forgotten"), scoring.effective_forgetting(
        F.col("forgetting_factor"), F.col("last_accessed_time"), as_of, cfg, zero_factor))


def event_weight(event_role: DataFrame, timeline: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT,
                 zero_factor: str = "as_one", leaves: DataFrame | None = None) -> DataFrame:
    """Strongest memory among the most important roles of each basic event.

    With `leaves` (root, event_id), abstract events come as well and weigh as much as their strongest leaf.
    """
    joined = role_timeline_join(event_role, timeline)
    best = F.max(F.struct(scoring.importance_rank(F.col("importance")).alias("rank"),
                          F.coalesce(_effective(joined, as_of, cfg, zero_factor), F.lit(0.0)).alias("eff")))
    immune = F.max(F.col("arousal")) > cfg.immune_arousal
    basic = joined.groupBy("event_id").agg(best.alias("b"), immune.alias("ptsd_immune")).select(
        "event_id", F.when(F.col("ptsd_immune"), F.lit(cfg.factor_cap)).otherwise(F.col("b.eff")).alias("w_i"))
    return basic if leaves is None else basic.unionByName(abstract_weight(basic, leaves))


def event_standing(event_role: DataFrame, timeline: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT,
                   zero_factor: str = "as_one") -> DataFrame:
    """Weight, silence and mean valence of each event from one join and one aggregation."""
    joined = role_timeline_join(event_role, timeline)
    eff = joined.withColumn("_eff", _effective(joined, as_of, cfg, zero_factor))
    best = F.max(F.struct(scoring.importance_rank(F.col("importance")).alias("rank"), F.coalesce("_eff", F.lit(0.0)).alias("eff")))
    weak = F.coalesce(F.col("_eff") < cfg.silence_threshold, F.lit(True))
    return eff.groupBy("event_id").agg(
        best.alias("b"), (F.max("arousal") > cfg.immune_arousal).alias("ptsd_immune"),
        F.bool_and(weak).alias("is_silent"), F.avg("valence").alias("event_valence")).select(
        "event_id", F.when(F.col("ptsd_immune"), F.lit(cfg.factor_cap)).otherwise(F.col("b.eff")).alias("w_i"),
        "is_silent", "event_valence")


def abstract_weight(leaf_weight: DataFrame, leaves: DataFrame) -> DataFrame:
    """An abstract event weighs as much as its strongest leaf."""
    return leaves.join(leaf_weight, "event_id", "left").groupBy(F.col("root").alias("event_id")).agg(
        F.coalesce(F.max("w_i"), F.lit(0.0)).alias("w_i"))


def silence_check(event_role: DataFrame, timeline: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT,
                  zero_factor: str = "as_one") -> DataFrame:
    """Events that all of their roles have forgotten."""
    joined = role_timeline_join(event_role, timeline)
    weak = F.coalesce(_effective(joined, as_of, cfg, zero_factor) < cfg.silence_threshold, F.lit(True))
    return joined.groupBy("event_id").agg(F.bool_and(weak).alias("is_silent"))


def reinforce(timeline: DataFrame, recalled: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Timeline with stronger entries for the recalled events."""
    hit = recalled.select("event_id").distinct().withColumn("_hit", F.lit(True))
    on = F.col("_hit").isNotNull()
    return timeline.join(hit, "event_id", "left").withColumns({
        "forgetting_factor": F.when(on, scoring.reinforced(F.col("forgetting_factor"), cfg)).otherwise(F.col("forgetting_factor")),
        "last_accessed_time": F.when(on, as_of).otherwise(F.col("last_accessed_time")),
    }).drop("_hit")


def conflict_pairs(timeline: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Pairs of one role's first entries whose valences clash.

    Only the first `conflict_top` entries of a role count, and a clash needs
    opposite signs, so positive rows meet negative rows instead of all pairs.
    """
    first = history_limit(timeline, cfg.conflict_top).select(
        "role_id", "event_id", "rn", "valence", F.substring("role_summary", 1, 80).alias("summary"))
    side = lambda df, p: df.select("role_id", *[F.col(c).alias(f"{p}_{c}") for c in ("event_id", "rn", "valence", "summary")])
    pos, neg = side(first.filter("valence > 0"), "p"), side(first.filter("valence < 0"), "q")
    clash = pos.join(neg, "role_id").filter(F.col("p_valence") * F.col("q_valence") < cfg.conflict_product)
    lead = F.col("p_rn") < F.col("q_rn")
    pick = lambda a, b: F.when(lead, F.col(a)).otherwise(F.col(b))
    return clash.select(
        "role_id", pick("p_event_id", "q_event_id").alias("event_a"), pick("q_event_id", "p_event_id").alias("event_b"),
        pick("p_summary", "q_summary").alias("summary_a"), pick("q_summary", "p_summary").alias("summary_b"),
        F.round(F.abs(F.col("p_valence") - F.col("q_valence")), 3).alias("sentiment_delta"))
