"""Forgetting, ranking and load arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from memlake.config import DEFAULT, IMPORTANCE_BOOST, IMPORTANCE_RANK, MemoryConfig
from memlake.functions import libm, vectors

DAY_US = 86400.0 * 1e6
HOUR_US = 3600.0 * 1e6
LN2 = 0.693  # fixed value: the reference semantics use three digits, not ln(2)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column, as_of: Column) -> Column:
    return F.greatest((micros(as_of) - micros(ts)) / F.lit(DAY_US), F.lit(0.0))


def age_hours(ts: Column, as_of: Column) -> Column:
    return F.greatest((micros(as_of) - micros(ts)) / F.lit(HOUR_US), F.lit(0.0))


def half_life(age: Column, days: float, exp: Callable[[Column], Column] = F.exp) -> Column:
    return exp(F.lit(-LN2) * age / F.lit(days))


def importance_rank(imp: Column) -> Column:
    out = F.lit(0)
    for name, rank in IMPORTANCE_RANK.items():
        out = F.when(imp == name, rank).otherwise(out)
    return out


def importance_boost(imp: Column) -> Column:
    out = F.lit(0.0)
    for name, boost in IMPORTANCE_BOOST.items():
        out = F.when(imp == name, boost).otherwise(out)
    return out


def stored_factor(factor: Column, zero_factor: str = "as_one") -> Column:
    """A stored factor of 0 reads as 1 by default; `as_zero` keeps it."""
    if zero_factor == "as_zero":
        return F.coalesce(factor, F.lit(1.0))
    return F.coalesce(F.nullif(factor, F.lit(0.0)), F.lit(1.0))


def effective_forgetting(factor: Column, last_access: Column, as_of: Column,
                         cfg: MemoryConfig = DEFAULT, zero_factor: str = "as_one", exp: Callable[[Column], Column] = F.exp) -> Column:
    return stored_factor(factor, zero_factor) * half_life(age_days(last_access, as_of), cfg.half_life_days, exp)


def retention(create_time: Column, as_of: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    return half_life(age_days(create_time, as_of), cfg.half_life_days)


def penalised_score(memory_weight: Column, retained: Column) -> Column:
    return memory_weight * 0.4 + retained * 0.6


def reinforced(factor: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    return F.least(F.greatest(factor, F.lit(1.0)) * cfg.reinforce, F.lit(cfg.factor_cap))


def w_eff(w: Column, asf: Column) -> Column:
    kept = F.least(F.greatest(asf, F.lit(0.0)), F.lit(0.999999))
    return F.greatest(w * (1 - kept), F.lit(1e-6))


def sample_key(u: Column, weight: Column) -> Column:
    """Weighted-sampling key; the largest keys form the sample."""
    return F.pow(u, 1.0 / weight)


def coverage_weight(coverage: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    return F.when(coverage > 0, F.exp(F.lit(-cfg.coverage_decay) * coverage)).otherwise(F.lit(1.0))


def factor_modifier(weight: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    return 1 + cfg.factor_alpha * libm.log10(1 + F.greatest(weight, F.lit(0.0)).cast("double"))


def clamp(col: Column, lo: float, hi: float) -> Column:
    lo, hi = min(lo, hi), max(lo, hi)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col))


def quality_signal(a: Column, b: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    """Blend of both quality signals; a missing side drops out."""
    w = min(max(cfg.quality_weight, 0.0), 1.0)
    return F.coalesce(F.lit(w) * a + F.lit(1 - w) * b, a, b, F.lit(cfg.cap_neutral))


def quality_cap(signal: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    return clamp(cfg.cap_base + cfg.cap_sensitivity * (signal - cfg.cap_neutral), cfg.cap_floor, cfg.cap_ceiling)


def adjusted_limit(base: Column, floor: Column, load: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    share = (load - 1.0) / (cfg.load_max - 1.0)
    floor = F.greatest(floor, F.lit(1))
    return F.greatest(F.floor(base - (base - floor) * share), floor).cast("long")


def load_of(ratio: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    return clamp(F.coalesce(ratio, F.lit(1.0)), 1.0, cfg.load_max)


def tier_offset(best_rank: Column, has_focus: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    base = cfg.default_offset
    return (
        F.when(~has_focus, base)
        .when(best_rank >= IMPORTANCE_RANK["A"], base - cfg.primary_shift)
        .when(best_rank == IMPORTANCE_RANK["B"], base)
        .otherwise(base + cfg.minor_shift)
    )


def hybrid_parts(cos: Column, create_time: Column, as_of: Column, boost: Column, arousal: Column,
                 activation: Column, cfg: MemoryConfig = DEFAULT) -> dict[str, Column]:
    decay = half_life(age_days(create_time, as_of), cfg.recall_half_life_days)
    total = 0.50 * cos + 0.15 * decay + 0.20 * boost + 0.10 * arousal + 0.05 * activation
    return {"time_decay": decay, "role_boost": boost, "total": total}


def prototype_signal(vec: Column, prototypes: Sequence[Sequence[float]]) -> Column:
    """The best cosine of a vector to a few given ones, a small matrix that is part of the plan; 0 where none points the same way."""
    unit = [[x / (math.hypot(*p) or 1.0) for x in p] for p in prototypes]
    if not unit:
        return F.lit(0.0)
    best = F.array_max(F.transform(F.lit(unit), lambda p: vectors.dot(p, vec)))
    size = vectors.norm(vec)
    return F.when(vec.isNotNull() & (F.size(vec) == len(unit[0])) & (size > 0), F.greatest(best / size, F.lit(0.0))).otherwise(F.lit(0.0))


def intent_blend(ent: Column, emo: Column, fact: Column, cfg: MemoryConfig = DEFAULT,
                 likeness: tuple[Column, Column, Column] | None = None) -> dict[str, Column]:
    """Softmax over three signals, then a convex mix of the weight triples.

    With `likeness` (a `prototype_signal` for each of the three intents) each signal
    gets `intent_prototype_weight` times its own. It should be a column by then, as it is used many times.
    """
    if likeness is not None:
        ent, emo, fact = (s + cfg.intent_prototype_weight * p for s, p in zip((ent, emo, fact), likeness))
    t = cfg.intent_temperature if cfg.intent_temperature > 0 else 1.0
    scores = [ent / t, emo / t, (fact + cfg.intent_fact_baseline) / t]
    top = F.greatest(*scores)
    exps = [F.exp(s - top) for s in scores]
    total = exps[0] + exps[1] + exps[2]
    a_ent, a_emo, a_fact = [e / total for e in exps]
    mixed = [a_ent * cfg.weights_entity[i] + a_emo * cfg.weights_emotion[i] + a_fact * cfg.weights_fact[i]
             for i in range(3)]
    norm = mixed[0] + mixed[1] + mixed[2]
    label = (F.when((scores[0] >= scores[1]) & (scores[0] >= scores[2]), "blend:entity")
             .when(scores[1] >= scores[2], "blend:emotion").otherwise("blend:fact"))
    return {"w_act": mixed[0] / norm, "w_emo": mixed[1] / norm, "w_ent": mixed[2] / norm, "label": label}


def budget(length: Column, cfg: MemoryConfig = DEFAULT, roles: int = 2,
           multiplier: float = 1.0, abstract: bool = False) -> dict[str, Column]:
    """Character budgets of every derived text for a raw text of this length."""
    n = length.cast("double")
    t = cfg.compress_target
    level = lambda x, low: F.greatest(F.floor(x), F.lit(low)).cast("int")
    if abstract:
        out = {"total": level(n * t, cfg.fuse_min_chars)}
        out["L1"] = out["total"]
    else:
        ratio = t + (1 - t) * F.exp(-n / 500.0)
        out = {"total": level(n * ratio * multiplier, 60)}
        out["L1"] = level(out["total"] * cfg.summary_share, cfg.fuse_min_chars)
    for k in range(2, cfg.max_levels + 1):
        out[f"L{k}"] = level(out[f"L{k - 1}"] * cfg.summary_decay, cfg.fuse_min_chars)
    total = out["total"]
    out["snap_L3"] = level(total * cfg.snapshot_share / roles, 30)
    out["snap_L2"] = level(out["snap_L3"] * cfg.snapshot_decay, 15)
    out["snap_L1"] = level(out["snap_L2"] * cfg.snapshot_decay, 10)
    out["wp"] = level(total * cfg.wp_share / roles, 10)
    out["decoration"] = level(total * cfg.decoration_share, 10)
    return out
