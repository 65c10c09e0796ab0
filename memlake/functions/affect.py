"""Emotion arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from memlake.config import DEFAULT, EMOTIONS, MemoryConfig


def unit(col: Column) -> Column:
    return F.least(F.greatest(F.coalesce(col, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def arousal(emotion) -> Column:
    """Largest of the seven arousing dimensions; trust does not arouse."""
    return F.greatest(*[unit(emotion(e)) for e in EMOTIONS if e != "trust"])


def valence(emotion) -> Column:
    plus = unit(emotion("joy")) + unit(emotion("trust"))
    minus = sum((unit(emotion(e)) for e in ("fear", "sadness", "disgust")), unit(emotion("anger")))
    return (plus - minus) / (plus + minus + 1e-6)


def base_forgetting(memory_weight: Column, cfg: MemoryConfig = DEFAULT, valence: Column | None = None, alpha: float = 0.0,
                    power: Callable[[Column, Column], Column] = F.pow) -> Column:
    """100 times the weight to the power gamma; with `alpha` (0 to 0.5) a negative valence makes it last longer."""
    plain = F.lit(100.0) * power(memory_weight, F.lit(cfg.arousal_gamma))
    if valence is None or not alpha:
        return plain
    return plain * (1 + F.lit(min(max(alpha, 0.0), 0.5)) * F.greatest(F.lit(0.0), -F.coalesce(valence, F.lit(0.0))))


def habituated(strength: Column, recalls: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    """An emotion's strength after a number of recalls: each takes a share of what is left, the event itself stays."""
    return strength * F.pow(F.lit(1 - cfg.habituation), recalls.cast("double"))


def mood_modifier(event_valence: Column, query_valence: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    prod = event_valence * query_valence
    return F.when(prod > 0, 1 + cfg.mood_beta * prod).otherwise(F.lit(1.0))
